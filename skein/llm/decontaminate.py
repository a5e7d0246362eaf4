r"""Benchmark decontamination: spaced-seed hashing, DataFrame functions only.

Texts become tokens, runs of letters and digits in lower case. A seed is a fixed mask over SPAN consecutive tokens that ignores
some positions, so a substituted word at an ignored position still leaves a hit. The hashes of every seed of every document meet
those of the benchmark in one equality join; a hit names a diagonal (document position - item position). Every diagonal is then
verified on whole token arrays: where the best window of at most WINDOW tokens has at least MATCH percent equal tokens, the document
contains the item.

The masks are complete for the promise: however 4 of a window's 16 tokens are substituted, one of the masks fits somewhere between them
(the tests enumerate all 1,820 placements; found by a greedy search over masks). Items with fewer than SPAN tokens
have one seed more, their whole token run. So items shorter than a window are found where they occur verbatim, and with
substitutions where a mask fits between them. A text that holds only a part of an item contains
it if a whole window lies in that part.

Plan: documents are read once for seeds, without a shuffle: the benchmark's seeds are broadcast if their counted number is at most
BROADCAST_ROWS, otherwise both sides are shuffled by hash. Only documents with hits are read again for verification. Hot
items or hashes only make more hits, linear in the text.

Defined results: null and empty texts and items have no tokens and no hits; very long texts are cut nowhere, their seeds are made and
verified over the whole text; rows that
share a doc_id are judged together (a hit of any of them is the id's); null ids take no part; repeated rows give one result;
extra columns are ignored by `contamination` and kept by `decontaminated`; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._common import stored

#: The masks' positions that count.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 2, 7, 11))
SPAN, WINDOW, MATCH = 12, 16, 75
#: Rows of 24 bytes that may be broadcast.
BROADCAST_ROWS = 1_000_000


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(h: Column, masks: tuple) -> Column:
    """The hashes under every mask at every token, one mask after the other, size(h) of each; those that stick out at the end are of no use."""
    at = F.sequence(F.lit(0), F.size(h) - 1)
    one = lambda k, mask: F.transform(at, lambda i: F.xxhash64(F.lit(k), *(F.get(h, i + j) if j else F.get(h, i) for j in mask)))
    return F.when(F.size(h) > 0, F.concat(*(one(k, m) for k, m in enumerate(masks))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched (equal tokens on the best diagonal), overlap (its length), best (equal tokens of its best window)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("item")).where("item_id is not null").distinct())

    # At most SPAN - 1 values.
    short = sorted(r["n"] for r in items.select(F.size("item").alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())
    masks = (*MASKS, *(tuple(range(n)) for n in short))

    def exploded(df: DataFrame, name: str, *keep: str) -> DataFrame:
        cut = df.select(*keep, F.size(name).alias("m"), seeds(F.col(name), masks).alias("s"))
        # posexplode would add a filter on the array's size, which is pushed down and computes the tokens anew for every seed.
        return cut.select(*keep, "m", F.posexplode_outer("s").alias("p", "seed")).where("seed is not null")

    span = F.get(F.array(*(F.lit(max(m) + 1) for m in masks)), F.floor(F.col("p") / F.col("m")).cast("int"))
    whole = (F.col("p") < len(MASKS) * F.col("m")) | (F.col("m") == span)
    keys = exploded(items, "item", "item_id").where((F.col("p") % F.col("m") + span <= F.col("m")) & whole)
    keys = keys.select("item_id", (F.col("p") % F.col("m")).alias("q"), "seed").distinct()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("key"), token_hashes(F.col("text")).alias("h"))
    hits = exploded(hashed, "h", "doc_id", "key").join(_small(stored(keys)), "seed")
    hits = stored(hits.select("doc_id", "key", "item_id", (F.col("p") % F.col("m") - F.col("q")).alias("diagonal")).distinct())

    ids = stored(hits.select("doc_id").distinct())
    cand = docs.join(_small(ids), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("key"), token_hashes(F.col("text")).alias("h")).dropDuplicates(["doc_id", "key"])
    pairs = hits.join(cand, ["doc_id", "key"]).join(_small(items), "item_id")
    low, high = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.size("item"), F.size("h") - F.col("diagonal"))
    equal = F.transform(F.sequence(low, high - 1), lambda p: (F.get("h", p + F.col("diagonal")) == F.get("item", p)).cast("int"))
    pairs = pairs.select("doc_id", "item_id", equal.alias("e"), F.least(F.lit(WINDOW), F.size("item")).alias("w")).where(F.size("e") >= F.col("w"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("e") - F.col("w") + 1), lambda j: F.aggregate(F.slice("e", j, F.col("w")), F.lit(0), lambda a, x: a + x)))
    pairs = pairs.select("doc_id", "item_id", "w", F.aggregate("e", F.lit(0), lambda a, x: a + x).alias("matched"), F.size("e").alias("overlap"), best.alias("best"))
    top = pairs.where(F.col("best") * 100 >= F.col("w") * MATCH).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "overlap", "best")).alias("t"))
    return top.select("doc_id", "item_id", *(F.col(f"t.{c}").cast("long").alias(c) for c in ("matched", "overlap", "best")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that contain a benchmark item; all columns stay."""
    bad = stored(contamination(docs, benchmark).select("doc_id").distinct())
    return docs.join(_small(bad), "doc_id", "left_anti").select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items)


def _sql() -> str:
    mask = lambda k, v: f"'{k} ' || " + " || ' ' || ".join(f"{v}[i + {j + 1}]" for j in MASKS[k])
    cut = lambda table, key, v: " UNION ALL ".join(
        f"SELECT {key}, i, {mask(k, v)} AS seed FROM (SELECT {key}, {v}, unnest(range(0, len({v}) - {max(MASKS[k])})) AS i FROM {table})" for k in range(len(MASKS))
    )
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS h FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
ds AS ({cut("d", "doc_id", "h")}), bs AS ({cut("b", "item_id", "w")}),
runs AS (SELECT doc_id, h, i, h[i + 1] AS head FROM (SELECT doc_id, h, unnest(range(0, len(h))) AS i FROM d) WHERE (SELECT min(len(w)) FROM b WHERE len(w) > 0) < {SPAN}),
hits AS (
  SELECT doc_id, item_id, ds.i - bs.i AS g FROM ds JOIN bs USING (seed)
  UNION
  SELECT doc_id, item_id, i FROM runs JOIN b ON head = w[1] AND len(w) < {SPAN} AND h[i + 1:i + len(w)] = w),
e AS (
  SELECT doc_id, item_id, least({WINDOW}, len(w)) AS n,
    list_transform(range(greatest(0, -g), least(len(w), len(h) - g)), lambda p: CAST(h[p + g + 1] = w[p + 1] AS INTEGER)) AS e
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
m AS (
  SELECT doc_id, item_id, n, list_sum(e) AS matched, len(e) AS overlap, list_max(list_transform(range(1, len(e) - n + 2), lambda j: list_sum(e[j:j + n - 1]))) AS best
  FROM e WHERE len(e) >= n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, overlap DESC, best DESC) AS k FROM m WHERE best * 100 >= n * {MATCH})
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(overlap AS BIGINT) AS overlap, CAST(best AS BIGINT) AS best FROM r WHERE k = 1"""


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE_SQL = {"op1_decontaminate": _sql()}
