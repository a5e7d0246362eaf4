"""Exact cosine search: every row scores itself in built-in expressions, the top rows are taken per partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(column: Column, query: list[float]) -> Column:
    """Cosine to a query vector; 0 where either has no length, null where the row has no vector."""
    size = math.sqrt(sum(x * x for x in query))
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = F.sqrt(dot(column, column)) * size
    return F.when(column.isNull(), None).when(norm == 0, 0.0).otherwise(dot(column, q) / norm)


def scaled(cos: Column) -> Column:
    """(1 + cosine) / 2, the score of VECTOR hits."""
    return (cos + 1) / 2


def nearest(rows: DataFrame, column: str, query: list[float], n: int, *ties: str) -> DataFrame:
    """The n rows with the best scaled cosine; rows without a vector aren't candidates. Filters go before this."""
    scored = rows.where(F.col(column).isNotNull()).withColumn("score", scaled(cosine(F.col(column), query)))
    return scored.orderBy(F.desc("score"), *ties).limit(n)
