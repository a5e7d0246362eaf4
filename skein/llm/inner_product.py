"""Exact top-k inner-product search: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Vectors are made integer, floor(scale * x). One aggregate gives their Gram matrix, whose eigenvectors (the right singular vectors of
all vectors) are the rotation: after it the first coordinates carry most of an inner product. Candidates are range-partitioned by
descending length and packed into blocks of BLOCK vectors; queries into blocks of QUERY_BLOCK, each of which visits every
candidate block (a stated query set against all rows, in blocks; vectors are never paired row by row outside a task).

For a query q with threshold t (its k-th best score among the HEAD longest vectors, a lower bound for its final k-th score):
1. candidates with |q||c| < t are cut; as a block is sorted by length, that is one search;
2. the partial sum over the first rotated coordinates plus |rest of q||rest of c| bounds the product from above; below t: cut;
3. the others' exact integer products are taken, the block's k best kept and t raised to their k-th.
Ties stay in at every step, so the result is exact.

Memory: a task holds one query block and one candidate block at a time. Driver: the Gram matrix and HEAD vectors.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part; shorter
vectors count as padded with zeros; a vec_id given several times counts once, with its least vector; ties go to the smaller
vec_id; with fewer than k other vectors all are returned; an empty table or query set gives an empty result; extra columns
are ignored. Products are exact while |sum| < 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._common import bounded_batches, stored

BLOCK, QUERY_BLOCK, HEAD, GROUP = 4096, 512, 4096, 16


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """rows x dims of a list column, padded with zeros."""
    out = np.zeros((len(column), dims))
    n = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _gram(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            g += m.T @ m
        i, j = np.nonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["i", "j", "v"])

    return run


def _pack(dims: int, size: int):
    """Sorted rows (vec_id, ints) into rows (block, ids, vecs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vecs: list[np.ndarray] = []
        held = made = 0

        def flush():
            nonlocal held, made
            i, v = np.concatenate(ids), np.concatenate(vecs)
            key = (TaskContext.get().partitionId() << 32) + made
            ids.clear()
            vecs.clear()
            held, made = 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["block", "ids", "vecs"])

        for batch in batches:
            i, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            at = 0
            while at < len(i):
                n = min(size - held, len(i) - at)
                ids.append(i[at : at + n])
                vecs.append(v[at : at + n])
                held, at = held + n, at + n
                if held == size:
                    yield flush()
        if held:
            yield flush()

    return run


def best(q_ids: np.ndarray, q: np.ndarray, limit: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int):
    """(query row, candidate id, score) of each query's k best candidates of a block that reach its limit; raises limit in place."""
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    order = np.argsort(-cn, kind="stable")
    c, c_ids, cn = c[order], c_ids[order], cn[order]
    slack = 1e-6 * (1 + qn * (cn[0] if len(cn) else 0))
    out = []
    active = np.flatnonzero(qn * (cn[0] if len(cn) else 0) >= limit - slack)
    if not len(active):
        return out
    head = max(1, q.shape[1] // 4)
    qr, cr = q @ rotation, c @ rotation
    q_rest, c_rest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(cr[:, head:], axis=1)
    for a in range(0, len(active), 64):
        rows = active[a : a + 64]
        for b in range(0, len(c), 1024):
            n = slice(b, min(len(c), b + 1024))
            rows = rows[qn[rows] * cn[b] >= limit[rows] - slack[rows]]  # sorted by length: no later candidate reaches
            if not len(rows):
                break
            bound = qr[rows, :head] @ cr[n, :head].T + np.outer(q_rest[rows], c_rest[n])
            keep = (bound >= (limit[rows] - slack[rows])[:, None]) & (c_ids[n][None, :] != q_ids[rows][:, None])
            if keep.mean() > 0.05:
                score = q[rows] @ c[n].T
                x, y = np.nonzero(keep & (score >= limit[rows][:, None]))
                s = score[x, y]
            else:
                x, y = np.nonzero(keep)
                s = np.einsum("ij,ij->i", q[rows[x]], c[b + y])
                on = s >= limit[rows[x]]
                x, y, s = x[on], y[on], s[on]
            i = c_ids[b + y]
            order = np.lexsort((i, -s, x))
            x, i, s = x[order], i[order], s[order]
            rank = np.arange(len(x)) - np.searchsorted(x, x)
            on = rank < k
            out.append((rows[x[on]], i[on], s[on]))
            last = rank == k - 1
            limit[rows[x[last]]] = np.maximum(limit[rows[x[last]]], s[last])
    return out


def _search(dims: int, rotation: np.ndarray, k: int, head_ids: np.ndarray, head: np.ndarray):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits: dict[int, np.ndarray] = {}  # of the query blocks that this task has met
        for batch in batches:
            for r in range(batch.num_rows):
                block, qi, qv, ci, cv = (batch.column(x)[r] for x in range(5))
                q_ids, c_ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (qi, ci))
                q, c = (np.frombuffer(x.as_buffer()).reshape(-1, dims) for x in (qv, cv))
                limit = limits.get(block.as_py())
                if limit is None:
                    score = q @ head.T
                    score[q_ids[:, None] == head_ids[None, :]] = -np.inf
                    limit = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                    if len(limits) > 64:
                        limits.clear()
                    limits[block.as_py()] = limit
                got = best(q_ids, q, limit, c_ids, c, rotation, k)
                if got:
                    x, i, s = (np.concatenate(z) for z in zip(*got, strict=True))
                    on = s >= limit[x]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[x[on]]), pa.array(i[on]), pa.array(s[on].astype(np.int64))], schema=schema)

    return run


def max_inner_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of vectors (vec_id, embedding) where `queries` holds, the k best other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))
    ints = stored(ints.groupBy("vec_id").agg(F.min("v").alias("v")))
    seen = ints.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    dims = max(seen["d"] or 0, 1)
    gram = np.zeros((dims, dims))
    for i, j, v in ints.select("v").mapInArrow(_gram(dims), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).toArrow().to_pandas().itertuples(index=False):
        gram[i, j] = v
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy()

    length = F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)
    sized = ints.withColumn("length", length)
    top = sized.orderBy(F.desc("length"), "vec_id").limit(HEAD).select("vec_id", "v").toArrow()
    head_ids = top.column("vec_id").to_numpy()
    head = _matrix(top.column("v").combine_chunks(), dims) if len(top) else np.zeros((0, dims))

    def packed(df: DataFrame, rows: int, size: int) -> DataFrame:
        parts = max(1, min(-(-rows // size), 100_000))
        df = df.repartitionByRange(parts, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
        return stored(df.select("vec_id", "v").mapInArrow(_pack(dims, size), "block long, ids binary, vecs binary"))

    asked = sized.where(queries)
    wanted = asked.count()
    groups = max(1, -(-seen["n"] // (BLOCK * GROUP)))
    blocks = packed(sized, seen["n"], BLOCK).withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    ask = packed(asked, wanted, QUERY_BLOCK).select(F.col("block").alias("asked"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    ask = ask.withColumn("g", F.col("g").cast("long"))
    found = ask.join(blocks, "g").select("asked", "q_ids", "q_vecs", "ids", "vecs").mapInArrow(_search(dims, rotation, k, head_ids, head), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_max_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op3_max_inner_product": op3_max_inner_product}
ORACLE_SQL = {
    "op3_max_inner_product": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
