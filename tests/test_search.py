import random
import threading

import pytest
from pyspark.sql import functions as F

from skein.functions import pathprefix, rawquery, render
from skein.functions.embed import HashingEmbedder, basic_tokens, embed_column, wordpiece
from skein.operators import postings
from skein.operators.snapshot import EmbeddingDrift, SnapshotStore
from skein.functions.analysis import WORDS, near_count, near_positions, text_tokens
from skein.plans.search import SearchIndex, Syntax, search, text_leg
from skein.sources.config import parse
from skein.sources.files import analysed

CHUNKS = "path string, chunk_no int, heading_path array<string>, text string, start_line int, frontmatter_json string, embedding array<float>"


def corpus(spark, rows):
    return analysed(spark.createDataFrame([(p, 0, h, t, 1, None, v) for p, h, t, v in rows], CHUNKS))


def paths(df):
    return [r["path"] for r in df.orderBy("rank").collect()]


class Fixed:
    model_id, dimensions = "fixed", 2

    def __init__(self, vector=(1.0, 0.0)):
        self.vector = vector

    def embed_batch(self, texts):
        if self.vector is None:
            raise RuntimeError("no model")
        return [list(self.vector) for _ in texts]


@pytest.fixture(scope="module")
def ranked(spark):
    return corpus(spark, [("a", [], "term term term", [0.9, 0.43589]), ("b", [], "term x", [0.0, 1.0]), ("d", [], "term v w x y", [1.0, 0.0])]).cache()


def test_modes_rank_as_expected(ranked):
    assert paths(search(ranked, "term", syntax="text")) == ["a", "b", "d"]
    assert paths(search(ranked, "term", syntax="vector", embedder=Fixed())) == ["d", "a", "b"]
    assert paths(search(ranked, "term", embedder=Fixed())) == ["a", "d", "b"]
    assert paths(search(ranked, "zzz", embedder=Fixed())) == ["d", "a", "b"]


def test_hybrid_degrades_and_vector_needs_an_embedder(ranked):
    assert paths(search(ranked, "term")) == paths(search(ranked, "term", embedder=Fixed(None))) == ["a", "b", "d"]
    with pytest.raises(OSError):
        search(ranked, "term", syntax="vector")
    assert Syntax.of(" RAW ") is Syntax.RAW and Syntax.of(None) is Syntax.of("x") is Syntax.of("") is Syntax.HYBRID


def test_headings_count_double_and_can_be_asked(spark):
    c = corpus(spark, [("a", ["mango"], "filler words here", None), ("b", ["other"], "mango words here", None)])
    assert paths(search(c, "mango", syntax="text")) == ["a", "b"]
    assert paths(search(c, "heading_text:mango", syntax="raw")) == ["a"]
    assert paths(search(c, "mango", syntax="raw")) == ["b"]


def test_prefix_filters_before_ranking(spark):
    c = corpus(spark, [("doc/a.md", [], "kiwi kiwi kiwi", [1.0, 0.0]), ("src/b.md", [], "kiwi and other words", [0.0, 1.0])])
    assert paths(search(c, "kiwi", 1, "text", "src")) == ["src/b.md"]
    assert paths(search(c, "kiwi", 1, "vector", "src/", embedder=Fixed())) == ["src/b.md"]
    df = spark.createDataFrame([(p,) for p in ("doc/deploy", "doc/deploy/setup.md", "doc/deployment.md", "doc/control/setup.md")], "path string")
    assert df.where(pathprefix.under(F.col("path"), "doc/deploy/")).count() == 2 and df.where(pathprefix.under(F.col("path"), " ")).count() == 4
    with pytest.raises(ValueError):
        pathprefix.normalise("/doc")


@pytest.mark.parametrize("query", ["C++ (notes)", "C++ (notes", 'a "b', "x:y", "*", "~"])
def test_text_queries_take_any_symbol(spark, query):
    c = corpus(spark, [("a", [], "C++ (notes) a b x y here.", None)])
    assert len(paths(search(c, query, syntax="text"))) == (0 if query in "*~" else 1)


RAW = [("1", "alpha beta gamma"), ("2", "beta alpha gamma"), ("3", "alpha delta"), ("4", "reindex corpus")]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ('"alpha beta"', "1"), ('"alpha gamma"~1', "12"), ("alpha AND beta", "12"), ("alpha && NOT beta", "3"), ("+alpha -delta", "12"), ("delta || corpus", "34"), ("(alpha delta) AND gamma", "12"),
        ("re*ex", "4"), ("corp*", "4"), ("corpis~1", "4"), ("/al.*a/", "123"), ("text:[delta TO gamma]", "123"), ("text:{delta TO gamma}", ""), ("*:*", "1234"), ("path:3", "3"), ("nofield:x", ""), ("!alpha", ""), ("alpha^2 corpus", "1234"),
    ],
)
def test_raw_queries(spark, query, want):
    c = corpus(spark, [(p, [], t, None) for p, t in RAW])
    assert "".join(sorted(paths(search(c, query, 10, "raw")))) == want


@pytest.mark.parametrize("query", ['"open', "(a", "a)", "AND a", "a OR", "*x", "[a b]", "", "a^"])
def test_invalid_raw_queries(query):
    with pytest.raises(rawquery.QueryError):
        rawquery.parse(query)


def test_snippets(spark):
    long = "filler " * 180 + "needle here. " + "more " * 100
    c = corpus(spark, [("a", ["thing"], long, [1.0, 0.0]), ("b", [], "short needle", None)])
    got = {r["path"]: r for r in search(c, "needle", syntax="text").collect()}
    assert got["a"]["truncated"] and "**needle**" in got["a"]["text"] and len(got["a"]["text"]) <= 350 and got["b"]["text"] == "short needle" and not got["b"]["truncated"]
    for kwargs in ({"query": "needle", "syntax": "text", "full_text": True}, {"query": "thing", "syntax": "text"}, {"query": "needle", "syntax": "vector", "embedder": Fixed()}):
        r = next(r for r in search(c, **kwargs).collect() if r["path"] == "a")
        assert r["text"] == long and not r["truncated"]


def test_rendering(spark):
    c = corpus(spark, [("a.md", ["H", "I"], "word", None)])
    r = render.hit_lines(search(c, "word", syntax="text")).collect()[0]["rendered"]
    assert r.startswith("a.md:1 [H / I] (0.") and r.endswith("\nword")


CONFIG = "index:\n  all:\n    index_path: idx\n    markdown: ['doc/**/*.md']\n    yaml: ['doc/*.yaml']\n    source: {kind: [java], include: ['src/**']}\n"


def test_incremental_passes(spark, tmp_path):
    for p, t in (("doc/guide.md", "---\nscope: billing\n---\n# Guide\nmango text\n"), ("doc/data.yaml", "key:\n  papaya: 1\n"), ("src/Main.java", "// header\n\n// guava note\nclass Main {}\n"), ("doc/empty.md", ""), ("src/x.py", "# no")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    index = SearchIndex(spark, str(tmp_path), parse(CONFIG))
    stats = index.reindex("all")
    assert (stats.added, stats.changed, stats.removed, stats.docs) == (3, 0, 0, 5)
    assert not index.reindex("all").any_change
    hit = index.search("all", "mango", syntax="text").collect()[0]
    assert (hit["location"], hit["frontmatter_json"]) == ("doc/guide.md:4", '{"scope": "billing"}')
    assert index.search("all", "guava", syntax="text").collect()[0]["location"] == "src/Main.java:3"
    assert index.search("all", "class", syntax="text").collect() == []
    (tmp_path / "doc/guide.md").write_text("# Guide\nkiwi text\n")
    (tmp_path / "doc/data.yaml").unlink()
    stats = index.reindex("all")
    assert (stats.added, stats.changed, stats.removed, stats.docs) == (0, 1, 1, 3)
    assert index.search("all", "mango papaya", syntax="text").collect() == [] and len(index.search("all", "kiwi", syntax="text").collect()) == 1
    assert [tuple(r) for r in index.list_indexes().collect()] == [("all", 3)]
    with pytest.raises(ValueError, match="unknown index"):
        index.search("other", "x")
    again = SearchIndex(spark, str(tmp_path), parse(CONFIG), HashingEmbedder(8))
    stats = again.reindex("all")
    assert (stats.added, stats.changed) == (0, 2)
    assert len(again.search("all", "kiwi", syntax="vector").collect()) == 3
    with pytest.raises(EmbeddingDrift, match="drift"):
        SearchIndex(spark, str(tmp_path), parse(CONFIG), HashingEmbedder(16))
    assert SnapshotStore(spark, f"{tmp_path}/idx").manifest().writes > 5


def test_embedding_batches_and_pieces(spark):
    seen = []

    class Counting(HashingEmbedder):
        def embed_batch(self, texts):
            seen.append(len(texts))
            return super().embed_batch(texts)

    df = spark.createDataFrame([(f"t{i}",) for i in range(70)], "text string").coalesce(1)
    out = df.select(embed_column(HashingEmbedder(4), F.col("text")).alias("e")).collect()
    assert len(out) == 70 and all(len(r["e"]) == 4 for r in out)
    Counting(4).embed_batch(["a"])
    assert seen == [1]
    vocab = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "."])}
    assert wordpiece("Unaffable. xyz", vocab) == [1, 3, 4, 5, 6, 0, 2] and wordpiece("un " * 600, vocab)[-1] == 2 and len(wordpiece("un " * 600, vocab)) == 512
    assert basic_tokens("A-b c.") == ["a", "-", "b", "c", "."]


def test_postings_score_as_the_chunk_table(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    c = corpus(spark, [(f"{'ab'[i % 2]}/{i:03}", [rng.choice(vocab)] if i % 3 else [], " ".join(rng.choices(vocab, k=rng.randint(0, 25))), None) for i in range(200)])
    store = SnapshotStore(spark, f"{tmp_path}/idx")
    store.write(c, c.select("path", F.lit("x").alias("checksum")), None, None, 1)
    chunks = store.table("chunks")
    for query, prefix in (("w1", None), ("w2 w7 w29 nowhere", None), ("w3 w4", "a"), ("nowhere", None)):
        want = [(r["path"], round(r["score"], 9)) for r in text_leg(chunks, query, 20, prefix).collect()]
        assert [(r["path"], round(r["score"], 9)) for r in store.ranked(text_tokens(query), 20, prefix).collect()] == want
    plan = store.ranked(["w1"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_proximity_counts_as_by_windows(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([([rng.choice(["of", "the", "a", "off", "o.f"]) for _ in range(rng.randint(0, 25))],) for _ in range(300)], "t array<string>")
    asked = [(w, s) for w in (["of", "the"], ["of", "of"], ["of", "the", "a"], ["o.f", "a"]) for s in (0, 1, 2, 3)]
    unlike = [F.sum((near_count(F.col("t"), w, s) != F.size(near_positions(F.col("t"), w, s))).cast("int")) for w, s in asked]
    assert set(df.select(*unlike).first()) == {0}
    wide = near_count(F.col("t"), list("abcdefgh"), 12)
    assert df.where(wide != 0).count() == 0
    plan = df.select(near_count(F.col("t"), ["of", "the"], 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_postings_count_a_chunk_in_its_row(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p/{i}", ["h h", "x"] if i % 2 else [], " ".join(rng.choices(["a", "b", "Zz", "ü"], k=i % 40)), None) for i in range(80)]
    c = corpus(spark, rows)
    want = {(f, t, r["path"]): (r[f].count(t), len(r[f])) for r in c.collect() for f in postings.FIELDS for t in r[f]}
    table = postings.postings(c)
    assert {(r["field"], r["term"], r["path"]): (r["tf"], r["length"]) for r in table.collect()} == want and table.count() == len(want)
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    postings.write(c, f"{tmp_path}/small")
    assert len(list((tmp_path / "small/postings").glob("*/*.parquet"))) <= postings.BUCKETS


def test_the_store_sorts_text_without_tokens(spark, tmp_path):
    c = corpus(spark, [(f"{i:03}", [], f"word{i} It's", None) for i in range(20)])
    store = SnapshotStore(spark, f"{tmp_path}/idx")
    store.write(c.withColumn("text_tokens", F.raise_error(F.lit("carried through the sort")).cast("array<string>")), c.select("path", F.lit("x").alias("checksum")), None, None, 1, pattern=WORDS)
    assert {tuple(r["text_tokens"]) for r in store.table("chunks").collect()} == {(f"word{i}", "it's") for i in range(20)}


def test_readers_always_see_a_whole_index(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/idx")
    c = corpus(spark, [("a", [], "one", None)])
    files = c.select("path", F.lit("x").alias("checksum"))
    store.write(c, files, None, None, 1)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            m = SnapshotStore(spark, f"{tmp_path}/idx").manifest()
            seen.append(m.version if m else None)

    reader = threading.Thread(target=read)
    reader.start()
    held = store.table("chunks")
    for _ in range(2):
        store.write(c, files, None, None, 1)
    stop.set()
    reader.join()
    assert None not in seen and seen == sorted(seen) and held.count() == 1
    with pytest.raises(OSError):
        store.commit(store.manifest())


def test_a_term_beyond_the_reach_of_passages_leaves_the_text_whole(spark):
    c = corpus(spark, [("a", [], "filler. " * 1500 + "needle", None), ("b", [], "needle. " + "filler. " * 1500, None)])
    got = {r["path"]: (r["truncated"], len(r["text"])) for r in search(c, "needle", syntax="text").collect()}
    assert got["a"] == (False, 12006) and got["b"][0] and got["b"][1] < 350


def test_symbols_are_tokens_of_their_own():
    assert basic_tokens("a€b ≤c ☃d+e") == ["a", "€", "b", "≤", "c", "☃", "d", "+", "e"]
