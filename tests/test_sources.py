import random
import re
from hashlib import sha256
from types import SimpleNamespace
from urllib.parse import unquote

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.sources import comments, files, globs, markdown
from skein.sources.config import load, parse


def sections(text):
    return [(c.heading_path, c.text, c.start_line) for c in markdown.chunks(text)]


def test_sections_have_breadcrumbs_and_lines():
    got = sections("intro\n\n# Usage\nhow\n\n## Indexing\nrun it\n# Empty\n# After\nend\n")
    assert got == [([], "intro", 1), (["Usage"], "how", 3), (["Usage", "Indexing"], "run it", 6), (["Empty"], "", 8), (["After"], "end", 9)]


def test_headings_in_code_quotes_and_lists_do_not_split():
    got = sections("# A\n```\n# no\n```\n> # quoted\n\n- # item\n\nB\n===\nx\n")
    assert [g[0] for g in got] == [["A"], ["B"]]
    assert "# no" in got[0][1] and "quoted" in got[0][1]


def test_front_matter():
    got = markdown.chunks("---\nscope: a\nnone: null\n---\n\n# T\nbody\n")
    assert [(c.heading_path, c.text, c.start_line) for c in got] == [(["frontmatter"], "scope: a\nnone: null", 1), (["T"], "body", 6)]
    assert all(c.frontmatter == {"scope": "a", "none": None} for c in got)
    assert list(got[0].frontmatter) == ["scope", "none"]
    assert markdown.frontmatter_json(got[0].frontmatter) == '{"scope": "a", "none": null}'
    assert [c.frontmatter for c in markdown.chunks("---\n- a\n---\nx")] == [{}, {}]
    assert [c.frontmatter for c in markdown.chunks("---\na: [\n---\nx")] == [{}, {}]
    assert [c.heading_path for c in markdown.chunks("---\nunclosed: 1\n# H\n")][-1] == ["H"]
    assert [c.text for c in markdown.chunks("---\na: 1\n---\n")] == ["a: 1"]


def test_inline_text_and_rules():
    assert sections("**bold** _it_ `c` [t](u)\n\n---\n\nx")[0][1] == 'bold it "c" "t" (u)\n\n***\n\nx'


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#- \n>`*ab=1._[]()<", max_size=80))
def test_any_text_is_chunked_with_sane_lines(text):
    got = markdown.chunks(text)
    n = text.count("\n") + 1
    assert all(1 <= c.start_line <= n for c in got)
    assert [c.start_line for c in got] == sorted(c.start_line for c in got)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="/*\n \"'ab{}()\\", max_size=60), st.sampled_from(["java", "pascal"]))
def test_any_source_gives_comments(text, kind):
    assert all(body.strip() and 1 <= line <= text.count("\n") + 1 for body, line in comments.extract(kind, text))


def test_c_like_comments():
    src = '// one\n// two\nint a = 1; // tail\nString s = "// no";\n/**\n * doc\n * more\n */\nint b; /* in */\n\n//\n// last'
    assert comments.extract("Java", src) == [("one\ntwo", 1), ("tail", 3), ("doc\nmore", 5), ("in", 9), ("last", 12)]
    assert comments.extract("go", "/* open") == [("open", 1)]
    assert comments.extract("rust", "// a\n\n// b") == [("a", 1), ("b", 3)]


def test_pascal_comments():
    src = "{ one }\n(* two *) x := 'it''s { no }';\n// three\n\n// four"
    assert comments.extract("pascal", src) == [("one", 1), ("two", 2), ("three\nfour", 3)]
    with pytest.raises(ValueError, match="unknown"):
        comments.extract("cobol", "")


def test_globs(tmp_path):
    for p in ("a.md", "doc/b.md", "doc/sub/c.md", "doc/node_modules/d.md", "src/X.java"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    at = lambda *p: globs.resolve(str(tmp_path), p)
    assert at("**/*.md") == ["a.md", "doc/b.md", "doc/sub/c.md"]
    assert at("doc/**/*.md", "doc/*.md") == ["doc/b.md", "doc/sub/c.md"]
    assert at("doc/?.md") == ["doc/b.md"] and at("*.{md,txt}") == ["a.md"] and at("none/*.md") == [] and at() == []
    assert at("src/[A-Z].java") == ["src/X.java"]
    with pytest.raises(ValueError, match="absolute"):
        at("/etc/*")
    assert globs.walk_roots(["doc/**/*.md", "doc/sub/*.md", "src/x/*.java"]) == ["doc", "src/x"]


def test_config(tmp_path):
    c = parse("index:\n  docs:\n    markdown: ['**/*.md']\n    source: {kind: [java], include: ['src/**']}\n")
    assert c.index["docs"].markdown == ("**/*.md",) and c.index["docs"].yaml == () and c.index["docs"].source.kind == ("java",)
    for bad in ("indexes: {}", "index: {a: {mark: []}}", "daemon: {lock: x}", "index: {a: {markdown: x}}", "index: ["):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(FileNotFoundError):
        load(str(tmp_path))


def test_a_scan_opens_only_matching_files(spark, tmp_path):
    for name in ("doc/a.md", "doc/sub/b [1].md", "node_modules/x/c.md", "doc/.git/d.md", "doc/big.bin", "e.yaml", "doc/bucket=1/f.md", "doc/other=2/g.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# T\nx\n")
    config = parse("index: {i: {index_path: idx, markdown: ['**/*.md'], yaml: ['*.yaml']}}").index["i"]
    got = files.scan(spark, str(tmp_path), config)
    want = ["doc/a.md", "doc/bucket=1/f.md", "doc/other=2/g.md", "doc/sub/b [1].md", "e.yaml"]
    assert sorted(r["path"] for r in got.collect()) == want and {r["checksum"] for r in got.collect()} == {sha256(b"# T\nx\n").hexdigest()}
    assert sorted(unquote(f).split(f"{tmp_path}/")[1] for f in got.inputFiles()) == want
    assert sorted((r["path"], r["category"], r["chunk_no"], r["text"]) for r in files.chunked(got).collect()) == [(p, "yaml", 0, "# T\nx") if p == "e.yaml" else (p, "markdown", 0, "x") for p in want]


def test_comment_lines_of_three_slashes_keep_the_third():
    assert comments.extract("rust", "/// doc\n//// more\n") == [("/ doc\n// more", 1)]


def test_plain_text_costs_no_pattern(monkeypatch):
    monkeypatch.setattr(markdown, "re", SimpleNamespace(Match=re.Match))
    assert markdown.inline("plain words (of one) line") == "plain words (of one) line" and markdown.inline("a  \n b") == "a\nb"


def test_line_breaks_lose_their_blanks():
    rng = random.Random(6)
    for _ in range(20000):
        text = "".join(rng.choices("a \t\\\n", k=rng.randint(0, 12)))
        assert markdown.unpadded(text) == re.sub(r"[ \t]*(?: {2,}|\\)?\n[ \t]*", "\n", text), repr(text)


def test_small_files_go_out_together():
    names = ["path", "category", "kind", "content"]
    texts = [f"# H{i}\n" + "word " * (i % 7 * 20000) for i in range(60)] + [None, ""]
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(62)]), pa.array(["markdown"] * 62), pa.array([None] * 62, pa.string()), pa.array([t and t.encode() for t in texts], pa.binary())], names=names)
    out = list(files._chunks(iter([rows])))
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(str(i), "markdown", *c) for i, t in enumerate(texts) if t for c in files.parse("markdown", None, t)] and 5 < len(out) < 30
