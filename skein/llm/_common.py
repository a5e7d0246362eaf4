"""Helpers shared by the training-data operators: word hashing on Arrow buffers, stored intermediates, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at a time.
CHUNK_BYTES = 1 << 20
#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20
#: Rows of one file of a small stored table whose size is known about.
ROWS_A_FILE = 20_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.full(1024, 0x9E3779B97F4A7C15, np.uint64)
_POWER[0] = 1
np.multiply.accumulate(_POWER, out=_POWER)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        p = np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)
        p[0] = 1
        _POWER = np.multiply.accumulate(p)
    return _POWER


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about `limit` bytes of text, each with its UTF-8 bytes and row offsets; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
        if arr.null_count:
            arr = arr.fill_null("")
        width = 8 if pa.types.is_large_string(arr.type) else 4
        off = np.frombuffer(arr.buffers()[1], f"i{width}", len(arr) + 1, arr.offset * width).astype(np.int64)
        data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    release()


def word_hashes(data: np.ndarray, off: np.ndarray, step: int = 1 << 18, suffix: bool = False):
    """A 64-bit hash of every word of the rows and the words' offsets by row.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. suffix: also a hash of each word's last 3 bytes."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.uint64)
        return (z, np.zeros(len(off), np.int64), z) if suffix else (z, np.zeros(len(off), np.int64))
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = off[:-1][off[:-1] < off[1:]]
    first[at] = solid[at]
    begins = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[at[at > 0] - 1] = solid[at[at > 0] - 1]
    ends = np.flatnonzero(last) + 1
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + step, "right")))
        lens = ends[i:j] - begins[i:j]
        heads = np.cumsum(lens) - lens
        total = int(lens.sum())
        pos = np.arange(total) - np.repeat(heads, lens)
        src = pos + np.repeat(begins[i:j], lens)
        val = _BYTE[_LOWER[data[src]]] * _powers(int(lens.max()))[pos]
        out[i:j] = np.add.reduceat(val, heads)
        i = j
    words = np.searchsorted(begins, off)
    if not suffix:
        return mix(out), words
    sfx = np.zeros(len(begins), np.uint64)
    for k in (1, 2, 3):
        p = ends - k
        sfx = sfx * np.uint64(257) + np.where(p >= begins, _LOWER[data[np.maximum(p, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return mix(out), words, mix(sfx)


def ngram_hashes(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, and their offsets by row; rows with 1 to n-1 words have one shingle, the whole row."""
    lens = np.diff(off)
    count = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    heads = np.concatenate([[0], np.cumsum(count)])
    total = int(heads[-1])
    start = np.arange(total) - np.repeat(heads[:-1] - off[:-1], count)
    end = np.repeat(off[1:], count)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        ok = start + k < end
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(ok, words[np.minimum(start + k, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(k + 1)).astype(np.uint64))
    return h, heads


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that a Python worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir() + "/skein-shared"
    return root


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: later reads neither recompute nor depend on executors.

    rows: about how many there are at most, for light last stages; a small table then takes few files in place of one a shuffle partition.
    There is a task for every ROWS_A_FILE rows, so large tables keep their partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, salt: Column, small: bool, like: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has few rows a key: by broadcast where right is known to be small, otherwise by a shuffle in which no
    key of left gathers in one task.

    There a key with more than `hot` rows of left is split into parts of about that size, by `salt`, and right's rows go to each part. `hot`
    is a ten-thousandth of left's rows, 500 at least, so the table of hot keys has at most 10,000 rows and is broadcast. like: a stored table
    with about as many rows a key as left; they are counted there, so that left, where it isn't stored, is computed once and not three times."""
    if small:
        return left.join(F.broadcast(right), on, how)
    counted = left if like is None else like
    count = counted.groupBy(*on).agg(F.count("*").alias("rows of the key"))
    n = counted.count()
    hot = max(500, n // 10_000)
    many = stored(count.where(F.col("rows of the key") > hot)) if n > hot else None
    if many is None or many.isEmpty():
        return left.join(right, on, how)
    many = F.broadcast(many.select(*on, F.ceil(F.col("rows of the key") / hot).cast("int").alias("parts of the key")))
    parts = F.coalesce("parts of the key", F.lit(1))
    left = left.join(many, on, "left").withColumn("part of the key", F.pmod(F.xxhash64(salt), parts).cast("int")).drop("parts of the key")
    right = right.join(many, on, "left").withColumn("part of the key", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts of the key")
    return left.join(right, [*on, "part of the key"], how).drop("part of the key")


def frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, as many whole steps of a sixteenth octave as stay within `limit` rows.

    A histogram of at most some hundred steps finds the least count, so no task gathers every partition's best rows."""
    step = F.floor(F.log2(F.col(count)) * 16)
    left, least = limit, None
    for r in sorted(df.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["s"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["s"]
    return df.where(step >= least) if least is not None else df.where("false")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (the smallest node reachable) of the undirected edges a, b; alternating large and small stars.

    Edges are kept as (larger, smaller); each round rewrites them towards the smallest known neighbour and is stored, and the
    rounds end when none changes. A round shuffles the edges by node twice and brings nothing but two sums to the driver.
    rows: a bound on the edges, if known."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)

    def mark(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        return r["n"], r["s"]

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))

    was = mark(e)
    while was[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        large = both.join(least(both), "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct(), 2 * was[0])
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
