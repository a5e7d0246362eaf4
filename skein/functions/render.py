"""Rendering of hits, counts and statistics as text and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.analysis import breadcrumb, location


def score_text(score: Column) -> Column:
    return F.format_string("%.5f", score)


def hit_lines(hits: DataFrame, scores: bool = True) -> DataFrame:
    """rank, rendered: location, heading, score and marker, then the text and the front matter."""
    heading = breadcrumb(F.col("heading_path"))
    head = F.concat(location(F.col("path"), F.col("start_line")), F.when(heading != "", F.concat(F.lit(" ["), heading, F.lit("]"))).otherwise(""))
    if scores:
        head = F.concat(head, F.lit(" ("), score_text(F.col("score")), F.lit(")"))
    marker = F.when(F.col("truncated"), " [snippet]").otherwise("")
    front = F.when(F.col("frontmatter_json").isNotNull(), F.concat(F.lit("\nfrontmatter: "), F.col("frontmatter_json"))).otherwise("")
    return hits.select("rank", F.concat(head, marker, F.lit("\n"), F.col("text"), front).alias("rendered"))


def hit_json(hits: DataFrame) -> DataFrame:
    """rank, json: one structured hit a row."""
    fields = F.struct(location(F.col("path"), F.col("start_line")).alias("location"), breadcrumb(F.col("heading_path")).alias("heading"), "score", "text", "truncated", F.col("frontmatter_json").alias("frontmatter"))
    return hits.select("rank", F.to_json(fields).alias("json"))


def index_lines(counts: DataFrame) -> DataFrame:
    return counts.orderBy("index_name").select(F.format_string("%s: %d docs", "index_name", "docs").alias("line"))


def reindex_line(name: str, stats) -> str:
    return f"{name}: +{stats.added} added, {stats.changed} changed, {stats.removed} removed ({stats.docs} docs)"
