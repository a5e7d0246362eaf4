"""Index configuration: named indexes with their paths and glob patterns, read strictly from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

DEFAULT_PATH = ".skein/config.yaml"
DEFAULT_LOCK = ".skein/daemon.lock"


@dataclass(frozen=True)
class SourceConfig:
    kind: tuple[str, ...] = ()
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class IndexConfig:
    index_path: str | None = None
    markdown: tuple[str, ...] = ()
    yaml: tuple[str, ...] = ()
    source: SourceConfig = SourceConfig()


@dataclass(frozen=True)
class DaemonConfig:
    lock_file: str = DEFAULT_LOCK


@dataclass(frozen=True)
class Config:
    index: dict[str, IndexConfig] = field(default_factory=dict)
    daemon: DaemonConfig = DaemonConfig()


def _fields(value, allowed: tuple[str, ...], where: str) -> dict:
    value = {} if value is None else value
    if not isinstance(value, dict):
        raise ValueError(f"{where}: a mapping is expected")
    if unknown := sorted(map(str, set(value) - set(allowed))):
        raise ValueError(f"{where}: unknown key {unknown[0]!r}")
    return value


def _strings(value, where: str) -> tuple[str, ...]:
    value = [] if value is None else value
    if not isinstance(value, list):
        raise ValueError(f"{where}: a list is expected")
    return tuple(map(str, value))


def parse(text: str) -> Config:
    """The configuration of a YAML text; unknown keys raise ValueError, missing lists are empty."""
    try:
        root = _fields(yaml.safe_load(text), ("index", "daemon"), "config")
    except yaml.YAMLError as e:
        raise ValueError(f"config: {e}") from e
    indexes = {}
    named = root.get("index") or {}
    if not isinstance(named, dict):
        raise ValueError("index: a mapping is expected")
    for name, value in named.items():
        one = _fields(value, ("index_path", "markdown", "yaml", "source"), f"index {name}")
        source = _fields(one.get("source"), ("kind", "include"), f"index {name} source")
        indexes[str(name)] = IndexConfig(
            one.get("index_path"), _strings(one.get("markdown"), "markdown"), _strings(one.get("yaml"), "yaml"),
            SourceConfig(_strings(source.get("kind"), "kind"), _strings(source.get("include"), "include")),
        )
    daemon = _fields(root.get("daemon"), ("lock_file",), "daemon")
    return Config(indexes, DaemonConfig(daemon.get("lock_file") or DEFAULT_LOCK))


def load(base_dir: str, path: str = DEFAULT_PATH) -> Config:
    file = Path(base_dir, path)
    if not file.is_file():
        raise FileNotFoundError(f"no configuration at {file}")
    return parse(file.read_text(encoding="utf-8"))
