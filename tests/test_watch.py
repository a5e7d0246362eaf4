import io
import json
import os

from skein import __main__ as cli
from skein.plans.search import SearchIndex
from skein.plans.tools import serve
from skein.sources.config import parse
from skein.streaming import maintain, watch

CONFIG = "index: {i: {index_path: idx, markdown: ['**/*.md']}}"


def test_a_source_reports_what_changed(spark, tmp_path):
    base, state = tmp_path / "base", str(tmp_path / "state")
    (base / "build").mkdir(parents=True)
    (base / "a.md").write_text("# A\nplum\n")
    (base / "b.md").write_text("# B\npear\n")
    config = parse(CONFIG).index["i"]
    source = watch.ChangeSource(spark, str(base), config, state)
    kinds = lambda df: {(r["path"], r["kind"]) for r in df.collect()}
    assert kinds(source.poll()) == {("a.md", "create"), ("b.md", "create")}
    assert source.poll() is None
    (base / "a.md").write_text("# A\nplum jam\n")
    os.utime(base / "a.md", (2e9, 2e9))
    (base / "b.md").unlink()
    (base / "c.md").write_text("# C\nfig\n")
    (base / "build" / "d.md").write_text("# D\nnot watched\n")
    source = watch.ChangeSource(spark, str(base), config, state)  # a restart loses nothing
    assert kinds(source.poll()) == {("a.md", "modify"), ("b.md", "delete"), ("c.md", "create")}
    query = maintain.drained(source.stream().withWatermark("ts", "1 second")).writeStream.outputMode("complete").format("memory").queryName("drained").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r["path"]: r["n"] for r in spark.sql("select path, n from drained").collect()} == {"a.md": 2, "b.md": 2, "c.md": 1}


def test_a_keeper_debounces_requests_reloads_and_scans(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text("# A\nplum\n")
    text, now, passes = [CONFIG], [0.0], []
    keeper = watch.Keeper(spark, lambda: parse(text[0]), lambda c: SearchIndex(spark, str(tmp_path), c), str(tmp_path / ".skein" / "watch"), clock=lambda: now[0])
    assert keeper.tick()["i"].added == 1
    (tmp_path / "b.md").write_text("# B\npear\n")
    assert keeper.tick() == {}  # the change is fresh
    now[0] = 1.5
    assert keeper.tick()["i"].added == 1
    assert keeper.tick() == {}
    assert keeper.search("i", "plum", syntax="text").count() == 1 and keeper.last_used == 1.5 and not keeper.busy()
    keeper.search("i", "pear", syntax="text")
    assert list(keeper.tick()) == ["i"] and keeper.tick() == {}  # two requests, one pass
    text[0] = "index: {i: {index_path: idx, markdown: ['**/*.md']}, j: {index_path: idy, markdown: ['a.md']}}"
    assert sorted(keeper.tick()) == ["i", "j"]
    text[0] = "index: ["
    now[0] = 400.0
    assert sorted(keeper.tick()) == ["i", "j"]  # a periodic scan; a broken configuration changes nothing
    monkeypatch.setattr(watch, "files", None)
    assert sorted(keeper.tick()) == ["i", "j"]  # what was lost is found by a full scan
    monkeypatch.undo()
    reindex = keeper.index.reindex
    monkeypatch.setattr(keeper.index, "reindex", lambda name: 1 / 0 if name == "j" else passes.append(name) or reindex(name))
    keeper.request("j")
    assert keeper.tick() == {}
    monkeypatch.undo()
    assert "j" in keeper.tick()


def test_messages_and_commands(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.md").write_text("# A\nplum jam\n")
    (tmp_path / ".skein").mkdir()
    (tmp_path / ".skein" / "config.yaml").write_text(CONFIG)
    index = SearchIndex(spark, str(tmp_path), parse(CONFIG))
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"index": "i", "query": "plum", "syntax": "text"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"index": "i"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "other"},
    ]
    got = [json.loads(x) for x in serve(index, [*map(json.dumps, asked), "{", ""])]
    assert [x.get("id") for x in got] == [1, 2, 3, 4, 5, None]
    assert {t["name"] for t in got[1]["result"]["tools"]} == {"search", "list_indexes", "reindex", "health"}
    assert got[2]["result"]["structuredContent"]["hits"][0]["location"] == "a.md:1" and not got[2]["result"]["isError"]
    assert got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    run = lambda *args: (cli.main(["-d", str(tmp_path), *args]), capsys.readouterr().out.strip())
    assert run("index", "i") == (0, "i: +0 added, 0 changed, 0 removed (1 docs)")
    assert run("list") == (0, "i: 1 docs")
    assert "plum jam" in run("query", "i", "plum", "--query-syntax", "text")[1]
    assert run("query", "i", "zzz", "--query-syntax", "text")[1] == "no matches"
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(asked[0]) + "\n"))
    assert json.loads(run("mcp")[1])["id"] == 1
    assert run("daemon", "--idle", "0")[0] == 0
