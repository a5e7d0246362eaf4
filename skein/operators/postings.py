"""Inverted index tables: postings by term, so that a text query reads its own terms and no other text.

Three Parquet tables: postings (bucket, field, term, path, chunk_no, tf, length), terms (bucket, field, term, df) and fields (field, rows, mean).
The first two are partitioned by a hash of the term and sorted by term within a file: a query names the buckets of its terms, so partition
pruning and row-group statistics leave the rest unread. A large index has several files a bucket, by path, so the postings of a word that every
text has don't gather in one."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import pathprefix
from skein.operators import bm25

#: Buckets of terms, and the tokens that a file of postings is made for.
BUCKETS, TOKENS = 64, 4_000_000
KEY = ["path", "chunk_no"]
FIELDS = {bm25.TEXT: 1.0, bm25.HEADING: bm25.HEADING_BOOST}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(chunks: DataFrame) -> DataFrame:
    """bucket, field, term, path, chunk_no, tf, length of every distinct term of a field of a chunk.

    A chunk's terms are counted in its own row: sorted, each run of equal tokens is a term. Nothing is shuffled."""
    field = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.sort_array(f).alias("tokens")) for f in FIELDS))).alias("f")
    each = chunks.select(*KEY, field).select(*KEY, "f.field", "f.tokens", F.size("f.tokens").alias("length"))
    last = F.zip_with("tokens", F.slice("tokens", 2, F.size("tokens")), lambda a, b: F.when(~a.eqNullSafe(b), a))
    runs = F.array_compact(F.transform(last, lambda t, i: F.when(t.isNotNull(), F.struct(t.alias("term"), i.alias("end")))))
    ends = each.where("length > 0").select(*KEY, "field", "length", runs.alias("runs"))
    before = F.concat(F.array(F.lit(-1)), F.slice("runs.end", 1, F.size("runs") - 1))
    terms = F.explode(F.zip_with("runs", before, lambda r, b: F.struct(r["term"].alias("term"), (r["end"] - b).alias("tf")))).alias("t")
    return ends.select(*KEY, "field", "length", terms).select(bucket(F.col("t.term")).alias("bucket"), "field", "t.term", *KEY, "t.tf", "length")


def write(chunks: DataFrame, root: str) -> None:
    """The three tables below root."""
    spark = chunks.sparkSession
    field = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(f).alias("n")) for f in FIELDS))).alias("f")
    stats = chunks.select(field).select("f.*").groupBy("field").agg(F.count(F.when(F.col("n") > 0, 1)).alias("rows"), (F.sum("n") / F.greatest(F.count(F.when(F.col("n") > 0, 1)), F.lit(1))).alias("mean"))
    stats.write.mode("overwrite").parquet(f"{root}/fields")
    total = sum(r["rows"] * (r["mean"] or 0) for r in spark.read.parquet(f"{root}/fields").collect())
    # One file a task, of a bucket and a share of the paths: none is sorted beyond a task's memory however large the index.
    writers = max(1, math.ceil(total / BUCKETS / TOKENS))
    place = F.col("bucket") * writers + F.pmod(F.xxhash64("path"), F.lit(writers)).cast("int")
    dealt = postings(chunks).repartitionById(BUCKETS * writers, place).sortWithinPartitions("bucket", "term")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    counts = spark.read.parquet(f"{root}/postings").groupBy("bucket", "field", "term").agg(F.count("*").alias("df"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/terms")


def of_terms(table: DataFrame, terms: list[str]) -> DataFrame:
    """The table's rows of the terms; the buckets are constants, which prunes partitions."""
    return table.where(reduce(lambda a, b: a | b, ((F.col("bucket") == bucket(F.lit(t))) & (F.col("term") == t) for t in terms), F.lit(False)))


def ranked(spark: SparkSession, root: str, terms: list[str], n: int, prefix: str | None = None) -> DataFrame:
    """KEY and score of the n best chunks for the terms: the same score as over the chunk table."""
    stats = {r["field"]: r for r in spark.read.parquet(f"{root}/fields").collect()}
    df = {(r["field"], r["term"]): r["df"] for r in of_terms(spark.read.parquet(f"{root}/terms"), terms).collect()}
    rows = of_terms(spark.read.parquet(f"{root}/postings"), terms).where(pathprefix.under(F.col("path"), prefix))
    score = F.lit(0.0)
    for field, boost in FIELDS.items():
        for term in terms:
            if (field, term) in df:
                s = bm25.FieldStats(stats[field]["rows"], stats[field]["mean"], {term: df[field, term]})
                points = boost * bm25.idf(s, term) * bm25.saturation(F.col("tf"), F.col("length"), s.mean)
                score = F.when((F.col("field") == field) & (F.col("term") == term), points).otherwise(score)
    return bm25.top(rows.groupBy(*KEY).agg(F.sum(score).alias("score")), "score", n, *KEY)
