"""Corpus files as chunks: scan, checksum, decode, parse. Files are read and parsed where they lie in the cluster."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.analysis import SIMPLE, breadcrumb, tokens
from skein.sources import comments, globs, markdown
from skein.sources.config import IndexConfig

CHUNK = T.StructType([
    T.StructField("chunk_no", T.IntegerType(), False),
    T.StructField("heading_path", T.ArrayType(T.StringType(), False), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("start_line", T.IntegerType(), False),
    T.StructField("frontmatter_json", T.StringType()),
])
CATEGORIES = ("markdown", "yaml", "source")
#: Bytes of small files whose chunks go out in one Arrow batch.
BATCH = 1 << 20


def parse(category: str, kind: str | None, data: bytes | str) -> list[tuple]:
    """A file's chunks; malformed UTF-8 is replaced, never an error."""
    text = data.decode("utf-8", "replace") if isinstance(data, (bytes, bytearray)) else data
    if category == "markdown":
        return [(i, c.heading_path, c.text, c.start_line, markdown.frontmatter_json(c.frontmatter)) for i, c in enumerate(markdown.chunks(text))]
    if category == "yaml":
        return [(0, [], text.strip(), 1, None)]
    return [(i, [], body, line, None) for i, (body, line) in enumerate(comments.extract(kind or "", text))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of files (.., category, kind, content) behind the columns before these; files go out together up to BATCH bytes, so that memory follows one file."""
    types = [pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string()]
    for batch in batches:
        kept = batch.columns[:-2]
        names = [*batch.schema.names[:-2], *CHUNK.names]
        at, rows, size = [], [], 0

        def packed() -> pa.RecordBatch:
            same = [c.take(pa.array(at, pa.int64())) for c in kept]  # noqa: B023
            return pa.RecordBatch.from_arrays([*same, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)  # noqa: B023

        for i, (category, kind, content) in enumerate(zip(*batch.columns[-3:], strict=True)):
            content = content.as_py()
            found = [] if content is None else parse(category.as_py(), kind.as_py(), content)
            rows += found
            at += [i] * len(found)
            size += len(content or b"")
            if rows and size >= BATCH:
                yield packed()
                at, rows, size = [], [], 0
        if rows:
            yield packed()


def chunked(files: DataFrame) -> DataFrame:
    """Rows (path, category, kind, content) as one row per chunk; files without chunks have none."""
    keep = ["path", "checksum", "category"] if "checksum" in files.columns else ["path", "category"]
    rows = files.select(*keep, F.col("kind").cast("string"), F.col("content").cast("binary"))
    out = rows.mapInArrow(_chunks, T.StructType([*rows.schema.fields[:-2], *CHUNK.fields]))
    return out.select("path", "category", *keep[1:-1], *CHUNK.names)


def analysed(chunks: DataFrame, pattern: str = SIMPLE) -> DataFrame:
    """chunks with heading, text_tokens and heading_tokens."""
    return chunks.withColumn("heading", breadcrumb(F.col("heading_path"))).withColumn("text_tokens", tokens(F.col("text"), pattern)).withColumn("heading_tokens", tokens(F.col("heading"), pattern))


def source_kind(path: Column) -> Column:
    """The comment syntax of a path's extension, null for others."""
    table = F.create_map(*(F.lit(x) for kv in comments.KINDS.items() for x in kv))
    return F.get(F.transform(F.array(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), lambda e: table[e]), 0)


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def categorised(files: DataFrame, config: IndexConfig) -> DataFrame:
    """Rows (path, ..) with their category and kind; of several categories the last in the order of CATEGORIES counts."""
    path = F.col("path")
    kind = source_kind(path)
    source = globs.matches(path, config.source.include) & kind.isin(list(config.source.kind) or [""])
    category = F.when(source, "source").when(globs.matches(path, config.yaml), "yaml").when(globs.matches(path, config.markdown), "markdown")
    out = files.withColumn("category", category).where(F.col("category").isNotNull() & ~globs.pruned(path))
    return out.withColumn("kind", F.when(F.col("category") == "source", kind))


def _plain(base: str) -> str:
    return "/" + base.split(":", 1)[-1].lstrip("/")


def _named(read: DataFrame, base: str, *keep: str) -> DataFrame:
    """The columns of a read of files below base, with their relative paths; `at` is the full one."""
    full = F.regexp_replace(F.col("path"), "^[a-z][a-z0-9+.-]*:/*", "/")
    return read.withColumn("at", F.col("path")).withColumn("p", full).withColumn("path", F.expr(f"substring(p, {len(_plain(base)) + 2})")).select("path", *keep)


def listed(spark: SparkSession, base_dir: str, config: IndexConfig) -> DataFrame | None:
    """path, at, length, modified, category, kind of a configuration's files, None where no root exists; nothing is opened."""
    base = base_dir.rstrip("/")
    patterns = [*config.markdown, *config.yaml, *config.source.include]
    globs.regexes(patterns)  # absolute patterns raise
    jvm = spark.sparkContext._jvm
    roots = []
    for root in globs.walk_roots(patterns):
        where = jvm.org.apache.hadoop.fs.Path(f"{base}/{root}" if root else base)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            roots.append(where.toString())
    if not roots:
        return None
    names = "{" + ",".join(sorted({"*" if "**" in (last := p.rsplit("/", 1)[-1]) or "{" in last or "[" in last else last for p in patterns})) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(roots)
    return categorised(_named(files.withColumn("modified", F.col("modificationTime")), base, "at", "length", "modified"), config)


def scan(spark: SparkSession, base_dir: str, config: IndexConfig) -> DataFrame:
    """path, content, checksum, category, kind of a configuration's files under base_dir (a local path or a URL that Spark reads).

    Only the patterns' static prefixes are listed, first by name alone; then the files that match are read, so what lies in pruned directories
    or is of another kind is never opened. The driver holds the matching names, as Spark's file index does; content is read by executors. Spark doesn't read files of no bytes: they have no
    chunks, and a file that becomes empty counts as removed."""
    base = base_dir.rstrip("/")
    names = listed(spark, base, config)
    found = [] if names is None else [re.sub(r"([{}\[\]*?\\])", r"\\\1", r["at"]) for r in names.select("at").collect()]
    if not found:
        return categorised(spark.createDataFrame([], "path string, content binary, checksum string"), config)
    kept = categorised(_named(spark.read.format("binaryFile").load(found), base, "content"), config)
    return kept.withColumn("checksum", checksum(F.col("content")))
