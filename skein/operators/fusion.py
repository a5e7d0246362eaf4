"""Reciprocal rank fusion of a text leg and a vector leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, OVERFETCH, LEAST_DEPTH = 60, 4, 40


def depth(n: int) -> int:
    return max(OVERFETCH * n, LEAST_DEPTH)


def ranked(leg: DataFrame, name: str, *order) -> DataFrame:
    """The leg's rows, at most depth(n) of them, with their 1-based rank."""
    return leg.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def fused(text: DataFrame, vector: DataFrame, key: list[str], n: int) -> DataFrame:
    """key, score, text_rank, vec_rank of the n best; ties: text hits in their order, then vector-only hits in theirs."""
    both = text.select(*key, "text_rank").join(vector.select(*key, "vec_rank"), key, "full")
    part = lambda c: F.coalesce(1.0 / (K + F.col(c).cast("double")), F.lit(0.0))
    return both.withColumn("score", part("text_rank") + part("vec_rank")).orderBy(F.desc("score"), F.asc_nulls_last("text_rank"), F.asc_nulls_last("vec_rank")).limit(n)
