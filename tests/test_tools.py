from skein.plans.search import SearchIndex
from skein.plans.tools import call
from skein.sources.config import parse


def test_tools(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nk: v\n---\n# A\nplum jam\n")
    index = SearchIndex(spark, str(tmp_path), parse("index: {docs: {index_path: idx, markdown: ['*.md']}}"))
    assert call(index, "reindex")["content"] == "docs: +1 added, 0 changed, 0 removed (2 docs)"
    assert call(index, "list_indexes")["content"] == call(index, "health")["content"] == "docs: 2 docs"
    got = call(index, "search", {"index": "docs", "query": "plum", "syntax": "text"})
    assert got["content"].startswith("a.md:4 [A]\nplum jam") and got["structured"]["hits"][0]["frontmatter"] == {"k": "v"}
    assert call(index, "search", {"index": "docs", "query": "zzz", "syntax": "text"})["content"] == "no matches"
    for arguments in ({}, {"index": "docs"}, {"index": "none", "query": "x"}, {"index": "docs", "query": "(a", "syntax": "raw"}, {"index": "docs", "query": "a", "path_prefix": "/x"}):
        assert call(index, "search", arguments)["is_error"]
    assert call(index, "nothing")["is_error"]
    empty = SearchIndex(spark, str(tmp_path), parse("index: {}"))
    assert call(empty, "list_indexes")["content"] == "no indexes configured"
