"""Searches over a chunk table, and the index API on top: search, reindex, list_indexes, health."""

from __future__ import annotations

import logging
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import pathprefix, rawquery
from skein.functions.analysis import SIMPLE, location, text_tokens
from skein.functions.embed import Embedder, embed_column, embedded_text
from skein.functions.snippet import snippet
from skein.operators import bm25, fusion, vector
from skein.operators.snapshot import ReindexStats, SnapshotStore, delta, upserted
from skein.sources import files as sources
from skein.sources.config import Config

log = logging.getLogger(__name__)
DEFAULT_TOP = 5
KEY = ["path", "chunk_no"]


class Syntax(Enum):
    TEXT = "text"
    RAW = "raw"
    VECTOR = "vector"
    HYBRID = "hybrid"

    @classmethod
    def of(cls, name: str | None) -> Syntax:
        """Case-insensitive; anything unknown, null or blank is HYBRID."""
        return next((s for s in cls if s.value == (name or "").strip().lower()), cls.HYBRID)


def text_leg(chunks: DataFrame, query: str, n: int, prefix: str | None = None, pattern: str = SIMPLE) -> DataFrame:
    """KEY and score of the n best rows for a TEXT query. The prefix filters before ranking; statistics stay collection-wide."""
    terms = text_tokens(query, pattern)
    if not terms:
        return chunks.select(*KEY, F.lit(0.0).alias("score")).where("false")
    rows = chunks.where(pathprefix.under(F.col("path"), prefix) & bm25.any_term(terms))
    return bm25.top(rows.select(*KEY, bm25.text_scores(chunks, terms).alias("score")), "score", n, *KEY)


def raw_leg(chunks: DataFrame, query: str, n: int, prefix: str | None = None, pattern: str = SIMPLE) -> DataFrame:
    match, score = rawquery.compiled(chunks, query, pattern)
    rows = rawquery.matching(chunks.where(pathprefix.under(F.col("path"), prefix)), match, score, *KEY)
    return bm25.top(rows, "score", n, *KEY)


def vector_leg(chunks: DataFrame, query: list[float], n: int, prefix: str | None = None) -> DataFrame:
    rows = chunks.where(pathprefix.under(F.col("path"), prefix))
    return vector.nearest(rows.select(*KEY, "embedding"), "embedding", query, n, *KEY).select(*KEY, "score")


def hybrid_leg(chunks: DataFrame, query: str, query_vector: list[float] | None, n: int, prefix: str | None = None, pattern: str = SIMPLE, vectors: DataFrame | None = None) -> DataFrame:
    """Both legs fused; without a query vector the text leg alone. vectors: KEY and embedding, where the chunks don't hold them; texts aren't joined with them."""
    if query_vector is None:
        return text_leg(chunks, query, n, prefix, pattern)
    d = fusion.depth(n)
    text = fusion.ranked(text_leg(chunks, query, d, prefix, pattern), "text_rank", F.desc("score"), *KEY)
    vec = fusion.ranked(vector_leg(chunks if vectors is None else vectors, query_vector, d, prefix), "vec_rank", F.desc("score"), *KEY)
    return fusion.fused(text, vec, KEY, n).select(*KEY, "score")


def hits(chunks: DataFrame, ranked: DataFrame, order: list, query: str, syntax: Syntax, full_text: bool, pattern: str = SIMPLE) -> DataFrame:
    """The ranked keys with their stored columns: only the top rows' texts are fetched (a broadcast of at most n keys)."""
    numbered = fusion.ranked(ranked, "rank", *order)
    rows = chunks.join(F.broadcast(numbered), KEY)
    if syntax is Syntax.RAW:
        terms = rawquery.terms_by_field(rawquery.parse(query, pattern)).get(bm25.TEXT, [])
    else:
        terms = text_tokens(query, pattern)
    found = reduce(lambda a, b: a | b, (F.array_contains(bm25.TEXT, t) for t in terms), F.lit(False))
    shown, cut = snippet(F.col("text"), terms, found, full_text or syntax is Syntax.VECTOR)
    return rows.select(
        F.col("rank").cast("int").alias("rank"), "path", "chunk_no", "heading_path", shown.alias("text"), F.col("score").cast("float").alias("score"), "start_line",
        cut.alias("truncated"), "frontmatter_json", location(F.col("path"), F.col("start_line")).alias("location"),
    ).orderBy("rank")


def search(chunks: DataFrame, query: str, top_n: int = DEFAULT_TOP, syntax: str | Syntax | None = None, path_prefix: str | None = None, full_text: bool = False, embedder: Embedder | None = None, pattern: str = SIMPLE, store: SnapshotStore | None = None) -> DataFrame:
    """The hits of a query over a chunk table, best first; with the store that the table is of, text is looked up in its postings."""

    def text_ranked(n: int) -> DataFrame:
        terms = text_tokens(query, pattern)
        return store.ranked(terms, n, path_prefix) if store and terms else text_leg(chunks, query, n, path_prefix, pattern)

    mode = syntax if isinstance(syntax, Syntax) else Syntax.of(syntax)
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    order = [F.desc("score"), *KEY]
    if mode is Syntax.VECTOR:
        if embedder is None:
            raise OSError("VECTOR search needs an embedder")
        ranked = vector_leg(chunks, embedder.embed_batch([query])[0], top_n, path_prefix)
    elif mode is Syntax.RAW:
        ranked = raw_leg(chunks, query, top_n, path_prefix, pattern)
    elif mode is Syntax.TEXT:
        ranked = text_ranked(top_n)
    else:
        q = None
        if embedder is not None:
            try:  # here and now: a failing embedder must not surface at the action
                q = embedder.embed_batch([query])[0]
            except Exception as e:  # noqa: BLE001
                log.warning("no vector leg: %s", e)
        if q is None:
            ranked = text_ranked(top_n)
        else:
            d = fusion.depth(top_n)
            text = fusion.ranked(text_ranked(d), "text_rank", F.desc("score"), *KEY)
            vec = fusion.ranked(vector_leg(chunks, q, d, path_prefix), "vec_rank", F.desc("score"), *KEY)
            ranked = fusion.fused(text, vec, KEY, top_n)
            order = [F.desc("score"), F.asc_nulls_last("text_rank"), F.asc_nulls_last("vec_rank")]
    return hits(chunks, ranked, order, query, mode, full_text, pattern)


class SearchIndex:
    """Named indexes of a configuration below a base directory."""

    def __init__(self, spark: SparkSession, base_dir: str, config: Config, embedder: Embedder | None = None, pattern: str = SIMPLE):
        self.spark, self.base, self.config, self.embedder, self.pattern = spark, base_dir.rstrip("/"), config, embedder, pattern
        self.stores = {name: SnapshotStore(spark, self._root(name)) for name in config.index}
        for s in self.stores.values():
            s.check_drift(embedder.model_id if embedder else None)

    def _root(self, name: str) -> str:
        path = self.config.index[name].index_path or f".skein/index/{name}"
        return path if path.startswith("/") or ":" in path else f"{self.base}/{path}"

    def _store(self, name: str) -> SnapshotStore:
        if name not in self.stores:
            raise ValueError(f"unknown index: {name}")
        return self.stores[name]

    def reindex(self, name: str) -> ReindexStats:
        """One incremental pass: only files whose checksum differs are parsed; a stale index is rewritten in full."""
        store = self._store(name)
        model, dims = (self.embedder.model_id, self.embedder.dimensions) if self.embedder else (None, None)
        stale = store.is_stale(model, dims)
        found = sources.scan(self.spark, self.base, self.config.index[name])
        known = store.known_checksums()
        known = found.select("path", "checksum").where("false") if known is None else known
        states = delta(known, found.select("path", "checksum")).cache()
        try:
            todo = F.col("state").isin("added", "changed", "same") if stale else F.col("state").isin("added", "changed")
            counts = states.agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("added", "changed", "removed", "same"))).first()
            total = counts["added"] + counts["changed"] + (counts["same"] if stale else 0)
            if not total and not counts["removed"] and not stale:
                return ReindexStats(0, 0, 0, store.count())
            changed = counts["changed"] + (counts["same"] if stale else 0)
            fresh = sources.analysed(sources.chunked(found.join(states.where(todo).select("path"), "path", "left_semi")), self.pattern)
            fresh = fresh.withColumn("embedding", embed_column(self.embedder, embedded_text(F.col("heading"), F.col("text"))) if self.embedder else F.lit(None).cast("array<float>"))
            gone = states.where("state <> 'same'") if not stale else states
            old_chunks, old_files = store.table("chunks"), store.table("files")
            files = states.where("state <> 'removed'").select("path", "checksum")
            fresh = fresh.drop(bm25.TEXT, bm25.HEADING)  # the store makes them
            chunks = fresh if stale or old_chunks is None or old_files is None else upserted(old_chunks, fresh, gone)
            store.write(chunks, files, model, dims, total + counts["removed"], self.pattern)
            return ReindexStats(counts["added"], changed, counts["removed"], store.count())
        finally:
            states.unpersist()

    def search(self, name: str, query: str, top_n: int = DEFAULT_TOP, syntax: str | None = None, path_prefix: str | None = None, full_text: bool = False) -> DataFrame:
        chunks = self._store(name).table("chunks")
        if chunks is None:
            self.reindex(name)
            chunks = self._store(name).table("chunks")
        return search(chunks, query, top_n, syntax, path_prefix, full_text, self.embedder, self.pattern, self._store(name)).withColumn("index_name", F.lit(name))

    def list_indexes(self) -> DataFrame:
        rows = [(name, s.count()) for name, s in sorted(self.stores.items())]
        return self.spark.createDataFrame(rows, "index_name string, docs long")

    health = list_indexes
