"""Glob patterns as regular expressions, for listings on the driver and for path columns of any size."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that a scan never enters below its root.
PRUNED = (".git", "node_modules", "target", "build", ".cache")
_MAGIC = re.compile(r"[*?\[\]{}\\]")


def to_regex(glob: str) -> str:
    """An anchored regular expression: * and ? stay within a segment, ** crosses segments, [..] and {a,b} as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            many = glob.startswith("*", i)
            i += many
            out.append(".*" if many else "[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 1)
            if end < 0:
                raise ValueError(f"unclosed [ in {glob!r}")
            body = glob[i:end]
            no, body = ("^/", body[1:]) if body[:1] in "!^" else ("", body)
            out.append("[" + no + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end + 1
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            if c == "\\" and i < len(glob):
                c, i = glob[i], i + 1
            out.append(re.escape(c))
    if depth:
        raise ValueError(f"unclosed {{ in {glob!r}")
    return "^(?:" + "".join(out) + ")$"


def regexes(patterns: Iterable[str]) -> list[str]:
    """The patterns' expressions. `**/` also stands for no directory: a pattern with it has a variant with every one removed."""
    out = []
    for p in patterns:
        if os.path.isabs(p):
            raise ValueError(f"absolute pattern: {p}")
        out.append(to_regex(p))
        if "**/" in p:
            out.append(to_regex(p.replace("**/", "")))
    return list(dict.fromkeys(out))


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a relative path matches any of the patterns."""
    return reduce(lambda a, b: a | b, (path.rlike(r) for r in regexes(patterns)), F.lit(False))


def pruned(path: Column) -> Column:
    """Whether a relative path lies in a directory that scans never enter."""
    return path.rlike("(^|/)(" + "|".join(map(re.escape, PRUNED)) + ")/")


def static_prefix(pattern: str) -> str:
    """The leading directories of a pattern that hold no glob syntax."""
    parts = pattern.split("/")
    n = next((k for k, p in enumerate(parts[:-1]) if _MAGIC.search(p)), len(parts) - 1)
    return "/".join(parts[:n])


def walk_roots(patterns: Iterable[str]) -> list[str]:
    """Directories to scan, relative to the base: static prefixes, without those inside another one."""
    found = sorted({os.path.normpath(p) if (p := static_prefix(x)) else "" for x in patterns})
    return [r for r in found if not any(o != r and (o == "" or r.startswith(o + "/")) for o in found)]


def resolve(base_dir: str, patterns: Iterable[str]) -> list[str]:
    """Relative paths of the regular files that match, distinct and sorted; unreadable or missing directories are skipped."""
    patterns = list(patterns)
    tests = [re.compile(r) for r in regexes(patterns)]
    out = set()
    for root in walk_roots(patterns):
        for folder, dirs, files in os.walk(os.path.join(base_dir, root)):
            dirs[:] = [d for d in dirs if d not in PRUNED]
            for name in files:
                full = os.path.join(folder, name)
                rel = os.path.relpath(full, base_dir).replace(os.sep, "/")
                if any(t.match(rel) for t in tests) and os.path.isfile(full):
                    out.add(rel)
    return sorted(out)
