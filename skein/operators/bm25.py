"""BM25 over text and heading fields.

Two map-side passes and no shuffle of documents: one aggregate brings the field statistics and each term's document frequency to the
driver (a few numbers), then every row scores itself and the top rows are taken per partition (TakeOrderedAndProject).
Statistics are those of the whole collection, whatever path prefix a query has."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, HEADING_BOOST = 1.2, 0.75, 2.0
TEXT, HEADING = "text_tokens", "heading_tokens"


@dataclass(frozen=True)
class FieldStats:
    """Rows that have the field, their mean length, and the document frequency of each term."""

    rows: int
    mean: float
    df: dict[str, int]


def collection_stats(chunks: DataFrame, fields: dict[str, Iterable[str]]) -> dict[str, FieldStats]:
    """Statistics of token columns for the given terms, in one pass. Rows without tokens don't have the field."""
    aggs = []
    plan = {f: list(dict.fromkeys(t)) for f, t in fields.items()}
    for f, terms in plan.items():
        some = F.size(f) > 0
        aggs += [F.count(F.when(some, 1)).alias(f"{f}|rows"), F.coalesce(F.sum(F.when(some, F.size(f))), F.lit(0)).alias(f"{f}|sum")]
        aggs += [F.count(F.when(F.array_contains(f, t), 1)).alias(f"{f}|{i}") for i, t in enumerate(terms)]
    row = chunks.agg(*aggs).first() if aggs else {}
    return {f: FieldStats(row[f"{f}|rows"], row[f"{f}|sum"] / max(row[f"{f}|rows"], 1), {t: row[f"{f}|{i}"] for i, t in enumerate(terms)}) for f, terms in plan.items()}


def idf(stats: FieldStats, term: str) -> Column:
    n = stats.df.get(term, 0)
    return F.log(F.lit(1.0) + (F.lit(float(stats.rows)) - n + 0.5) / (F.lit(float(n)) + 0.5))


def saturation(tf: Column, length: Column, mean: float) -> Column:
    tf = tf.cast("double")
    return tf / (tf + K1 * (1 - B + B * length.cast("double") / max(mean, 1e-9)))


def term_frequency(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def term_score(field: str, term: str, stats: FieldStats, boost: float = 1.0) -> Column:
    tf = term_frequency(F.col(field), term)
    return F.when(F.array_contains(field, term), boost * idf(stats, term) * saturation(tf, F.size(field), stats.mean)).otherwise(0.0)


def any_term(terms: list[str], fields: Iterable[str] = (TEXT, HEADING)) -> Column:
    asked = F.array(*map(F.lit, terms))
    return reduce(lambda a, b: a | b, (F.arrays_overlap(F.col(f), asked) for f in fields))


def text_scores(chunks: DataFrame, terms: list[str], heading: bool = True) -> Column:
    """The TEXT score: terms over text, and over headings with HEADING_BOOST."""
    boosts = {TEXT: 1.0} | ({HEADING: HEADING_BOOST} if heading else {})
    stats = collection_stats(chunks, dict.fromkeys(boosts, terms))
    return reduce(lambda a, b: a + b, (term_score(f, t, stats[f], b) for f, b in boosts.items() for t in terms), F.lit(0.0))


def top(rows: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(score), *ties).limit(n)
