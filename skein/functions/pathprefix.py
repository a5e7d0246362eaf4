"""Path-prefix scoping: a directory or file and everything below it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(prefix: str | None) -> str | None:
    """None for no restriction; a leading slash raises, one trailing slash goes."""
    if prefix is None or not prefix.strip():
        return None
    prefix = prefix.strip()
    if prefix.startswith("/"):
        raise ValueError(f"path prefix must be relative: {prefix}")
    return prefix.removesuffix("/") or None


def under(path: Column, prefix: str | None) -> Column:
    p = normalise(prefix)
    return F.lit(True) if p is None else (path == p) | path.startswith(p + "/")
