"""Command line over a configured directory: index, query, list; daemon keeps the indexes up to date; mcp serves the tools on stdin and stdout."""

from __future__ import annotations

import argparse
import fcntl
import sys
from pathlib import Path

from skein.functions.render import hit_lines, index_lines, reindex_line
from skein.plans import tools
from skein.plans.search import DEFAULT_TOP, SearchIndex
from skein.session import local_session
from skein.sources.config import DEFAULT_PATH, load
from skein.streaming.maintain import stop_when_idle
from skein.streaming.watch import Keeper


def keep(spark, directory: str, config_path: str, lock: str | None, idle: float) -> int:
    """One keeper for a directory, until nothing has used it for `idle` seconds."""
    path = Path(directory, lock or load(directory, config_path).daemon.lock_file)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w") as held:
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            print("a daemon is running already")
            return 1
        keeper = Keeper(spark, lambda: load(directory, config_path), lambda config: SearchIndex(spark, directory, config), f"{directory}/.skein/watch")
        query = keeper.start(on_pass=lambda name, stats: print(reindex_line(name, stats), flush=True))
        stop_when_idle(query, lambda: keeper.last_used, keeper.busy, idle)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("-d", "--dir", default=".")
    p.add_argument("--config", default=DEFAULT_PATH)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("name")
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("query")
    q.add_argument("-n", "--top-n", type=int, default=DEFAULT_TOP)
    q.add_argument("--query-syntax", default=None)
    q.add_argument("--path-prefix", default=None)
    q.add_argument("--full-text", action="store_true")
    d = sub.add_parser("daemon")
    d.add_argument("--lock", default=None)
    d.add_argument("--idle", type=float, default=600.0)
    sub.add_parser("mcp")
    a = p.parse_args(argv)
    if a.command == "daemon":
        return keep(local_session(), a.dir, a.config, a.lock, a.idle)
    index = SearchIndex(local_session(), a.dir, load(a.dir, a.config))
    if a.command == "index":
        print(reindex_line(a.name, index.reindex(a.name)))
    elif a.command == "list":
        print("\n".join(r["line"] for r in index_lines(index.list_indexes()).collect()) or "no indexes configured")
    elif a.command == "mcp":
        for line in tools.serve(index, sys.stdin):
            print(line, flush=True)
    else:
        found = index.search(a.name, a.query, a.top_n, a.query_syntax, a.path_prefix, a.full_text)
        print("\n\n".join(r["rendered"] for r in hit_lines(found).orderBy("rank").collect()) or "no matches")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
