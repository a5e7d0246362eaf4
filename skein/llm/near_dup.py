"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Each document becomes the set of its distinct word shingles. One hash function deals a set's shingles into bins and keeps each
bin's least value; empty bins borrow from bins that a hash of (bin, attempt) names, the same for every document (optimal
densification). Bands of bins are bucket keys.

Candidate pairs never come from all pairs of a bucket:
1. Documents with equal sets are one node (their least doc_id), by an aggregate.
2. Every bucket's least node is joined to its other nodes, a star; each edge is confirmed on full sets.
3. What the stars left apart: where a star's members are in several components, a member x that doesn't link to the centre may still link
   to another member. Such stars are joined by component and get a second centre, the member nearest to the consensus, and its links.
   Near the centre the other pairs are found by how both differ from it (see _by_difference: an exact prefix filter);
   farther away by their exact distances to the centre, which can't differ by more than the threshold as Jaccard distance is a
   metric, by their sizes and by the bins' low bits. These pairs are confirmed too, so no link is lost to the choice of the centre,
   and copies cost no quadratic work.

Components come from alternating large and small stars over the confirmed edges, each round stored.

Defined results: null or empty text has no shingles and links with nothing; documents with fewer words than a shingle have
one shingle, all their words; rows that share a doc_id are versions of one document, each with its own row and n_shingles, and
a link of any version links the id; rows with a null doc_id are returned with component_id null and kept true. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._common import bounded_batches, components, joined, mix, ngram_hashes, stored, text_chunks, word_hashes

BINS = 256
BANDS, ROWS = 25, 5
#: Up to this distance from a star's centre, members are compared by how they differ from the centre.
CLOSE = 0.6
#: Candidate documents up to this number are looked up by broadcast (8 bytes each), more by a shuffle.
BROADCAST_IDS = 500_000


def may_differ(percent: int) -> int:
    """Of BINS two-bit bins, how many may differ in a pair that goes on to its full sets: 4.5 standard deviations above the mean.

    Bands lose a pair at the threshold about as rarely, once in 100,000 times."""
    p = 0.75 * (1 - percent / 100)
    return math.ceil(BINS * p + 4.5 * math.sqrt(BINS * p * (1 - p)))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct shingle hashes, ascending within each row, and their offsets."""
    words, at = word_hashes(data, off)
    h, heads = ngram_hashes(words, at, n)
    for i in range(len(heads) - 1):
        h[heads[i] : heads[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[heads[:-1][heads[:-1] < heads[1:]]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[heads]


def signatures(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """rows x BINS values of one-permutation hashing, densified; rows without shingles keep the largest value."""
    rows, none = len(heads) - 1, np.uint64(0xFFFFFFFFFFFFFFFF)
    x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    sig = np.full(rows * BINS, none, np.uint64)
    np.minimum.at(sig, np.repeat(np.arange(rows), np.diff(heads)) * BINS + (x % np.uint64(BINS)).astype(np.int64), x // np.uint64(BINS))
    sig = sig.reshape(rows, BINS)
    was = sig.copy()
    r, b = np.nonzero((sig == none) & (np.diff(heads) > 0)[:, None])
    attempt = 1
    while len(r):
        other = (mix(np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * 1000003)) % np.uint64(BINS)).astype(np.int64)[b]
        got = was[r, other]
        hit = got != none
        sig[r[hit], b[hit]] = got[hit]
        r, b = r[~hit], b[~hit]
        attempt += 1
    return sig


def _sketch(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in text_chunks(batches, limit=1 << 20):
            h, heads = shingle_sets(data, off, n)
            rows, size = len(heads) - 1, np.diff(heads)
            sums = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
                sums.append((total[heads[1:]] - total[heads[:-1]]).view(np.int64))
            sig = signatures(h, heads)
            bands = np.empty((rows, BANDS), np.uint64)
            for k in range(BANDS):
                key = np.full(rows, k + 1, np.uint64)
                for v in sig[:, k * ROWS : (k + 1) * ROWS].T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v)
                bands[:, k] = key
            low = (mix(sig.ravel()) & np.uint64(3)).reshape(rows, BINS // 32, 32)
            bits = (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)
            some = size > 0
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * x.shape[1])]).astype(np.int32)), pa.array(x[some].ravel().view(np.int64))) for x in (bands, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(size.astype(np.int64)), *map(pa.array, sums), *lists], schema=schema)

    return run


def _sets(n: int):
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in text_chunks(batches):
            h, heads = shingle_sets(data, off, n)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array([raw[8 * i : 8 * j] for i, j in zip(heads[:-1], heads[1:], strict=True)], pa.binary())], schema=schema)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64()), ("size", pa.int64()), ("delta", pa.list_(pa.int64()))])
    for batch in batches:
        both, either, size, delta = [], [], [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            size.append(len(q))
            if len(p) > len(q):
                p, q = q, p
            both.append(int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()))
            either.append(len(p) + len(q) - both[-1])
            delta.append(np.setxor1d(p, q, assume_unique=True).view(np.int64) if both[-1] >= (1 - CLOSE) * either[-1] else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (both, either, size)), pa.array(delta, schema.types[5])], schema=schema)


def compared(pairs: DataFrame, docs: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """The pairs (a, b) with the sizes of their full shingle sets' intersection and union, b's size, and up to distance CLOSE the sets'
    symmetric difference; a row for each version of an id. most: a bound on the ids, if known."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), most)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(_sets(n), "id long, items binary")
    sets = stored(sets.where(F.length("items") > 0))
    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = joined(first, sets.select(F.col("id").alias("a"), F.col("items").alias("x")), ["a"], "inner", F.col("b"), False, like=pairs).select("a", "b", "x", "y")
    return stored(both.mapInArrow(_compare, "a long, b long, both long, either long, size long, delta array<long>"))


def _recentred(stars: DataFrame) -> DataFrame:
    """Of the stars: a, node, n, c, d, delta, against a better centre than a: the member nearest to the consensus.

    Most members share the elements in which a poor centre differs from all of them; the member with most of these and fewest others
    takes its place. Differences to the new centre follow from those to the old one, so no text is read again. Each member's
    exact size n, the new centre c2 and its size, and the members' difference from it come back."""
    near = stars.where("delta is not null")
    own = near.groupBy("a").agg(F.max(F.col("either") + F.col("both") - F.col("size")).alias("n")).select("a", F.col("a").alias("node"), "n", F.array().cast("array<long>").alias("delta"))
    near = stored(near.select("a", F.col("b").alias("node"), F.col("size").alias("n"), "delta").union(own))
    each = near.select("a", "node", F.explode("delta").alias("e"))
    half = near.groupBy("a").agg((F.count("*") / 2).alias("half"))
    major = each.groupBy("a", "e").agg(F.count("*").alias("df")).join(half, "a").where("df > half").select("a", "e")
    shared = each.join(major, ["a", "e"]).groupBy("a", "node").agg(F.count("*").alias("m"))
    far = near.select("a", "node", F.size("delta").alias("d")).join(shared, ["a", "node"], "left").withColumn("far", F.col("d") - 2 * F.coalesce("m", F.lit(0)))
    best = far.groupBy("a").agg(F.min(F.struct("far", "node")).alias("x")).select("a", F.col("x.node").alias("c2"))
    best = best.join(near.select("a", F.col("node").alias("c2"), F.col("n").alias("c"), F.col("delta").alias("own")), ["a", "c2"]).dropDuplicates(["a"])
    differ = F.concat(F.array_except("delta", "own"), F.array_except("own", "delta"))
    return stored(joined(near, stored(best), ["a"], "inner", F.col("node"), False).select("a", "node", "n", "c2", "c", differ.alias("delta")).withColumn("d", F.size("delta").cast("long")))


def _by_difference(near: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one star that may link although one of them, x, doesn't link to the centre c.

    With D(x) the difference of x and c, |x - y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and x, y link if |x - y| <= r (|x| + |y|). As x doesn't
    link to c, |D(x)| > r (|x| + |c|), so D(x) and D(y) must share at least (|D(y)| + r (|c| - |y|)) / 2 elements, which bounds y's
    prefix, and at least |D(x)| - r |x| (1 + 1/t), which bounds that of x. Two sets that share o elements share one among their
    |D| - o + 1 rarest (prefix filter): exact, and copies that differ from the centre each in their own way meet nowhere.

    A pair itself must share at least (|D(x)| + |D(y)| - r (|x| + |y|)) / 2. It meets at its first shared element in the common order, and shares
    no more than this one and what comes after it in either difference (position filter, as exact). What is left is decided on the
    differences themselves, so no sets are read for pairs that don't link."""
    t = percent / 100
    r = (1 - t) / (1 + t)
    out_need = F.greatest(F.lit(1), F.ceil(F.col("d") - r * F.col("n") * (1 + 1 / t) - 1e-6))
    in_need = F.greatest(F.lit(1), F.ceil((F.col("d") + r * (F.col("c") - F.col("n"))) / 2 - 1e-6))
    near = near.where("d > 0").join(label.select("node", "component", "bits"), "node").withColumn("outside", ~_linked(percent))
    # Versions of an id are apart by v.
    near = stored(near.withColumn("need", F.when(F.col("outside"), out_need).otherwise(in_need)).withColumn("v", F.xxhash64("delta")))
    each = near.select("a", "node", "v", "d", "need", F.explode("delta").alias("e"))
    shared = each.groupBy("a", "e").agg(F.count("*").alias("df")).where("df > 1")
    listed = each.join(shared, ["a", "e"]).groupBy("a", "node", "v", "d", "need").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("l"))
    # Elements that no other member has come first in the order; they use up the prefix without meeting anything.
    length = F.col("d") - F.col("need") + 1 - (F.col("d") - F.size("l"))
    prefix = listed.where(length > 0).select("a", "node", "v", F.size("l").alias("all"), F.posexplode(F.slice("l", F.lit(1), length.cast("int"))).alias("at", "x"))
    prefix = prefix.select("a", "node", "v", (F.col("all") - F.col("at")).alias("onwards"), F.col("x.e").alias("e"))
    rows = prefix.join(near.select("a", "node", "v", "component", "n", F.col("d").alias("size"), (2 * F.col("d") / (F.col("n") + F.col("c") + F.col("d"))).alias("d"), "bits", "outside"), ["a", "node", "v"])
    kept = ("node", "v", "component", "n", "d", "bits", "size", "onwards")
    p = rows.where("outside").select("a", "e", *(F.col(c).alias(f"p_{c}") for c in kept))
    q = rows.select("a", "e", *(F.col(c).alias(f"q_{c}") for c in kept))
    must = (F.col("p_size") + F.col("q_size") - r * (F.col("p_n") + F.col("q_n"))) / 2 - 1e-6
    met = p.join(q, (p.a == q.a) & (p.e == q.e) & _possible(percent) & (F.least("p_onwards", "q_onwards") >= must))
    pairs = stored(met.select(p.a.alias("a"), "p_node", "p_v", "q_node", "q_v", must.alias("must")).distinct())
    for side in ("p", "q"):
        pairs = pairs.join(near.select("a", F.col("node").alias(f"{side}_node"), F.col("v").alias(f"{side}_v"), F.col("delta").alias(f"{side}_delta")), ["a", f"{side}_node", f"{side}_v"])
    pairs = pairs.where(F.size(F.array_intersect("p_delta", "q_delta")) >= F.col("must"))
    return pairs.select(F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b")).distinct()


def _possible(percent: int) -> F.Column:
    """Whether p and q may link, from their components, exact sizes, exact distances d to a third set, and the bins' low bits."""
    pairs = [(F.get("p_bits", F.lit(k)), F.get("q_bits", F.lit(k))) for k in range(BINS // 32)]
    differ = sum((F.bit_count((x := a.bitwiseXOR(b)).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for a, b in pairs), F.lit(0))
    return (
        (F.col("p_component") != F.col("q_component"))
        & (100 * F.least("p_n", "q_n") >= percent * F.greatest("p_n", "q_n"))
        & (F.abs(F.col("p_d") - F.col("q_d")) <= 1 - percent / 100 + 1e-9)
        & ((F.least("p_n", "q_n") < 64) | (differ <= may_differ(percent)))
    )


def _linked(percent: int) -> F.Column:
    """Whether sets of sizes n and c that differ in d elements link: 100 * intersection >= percent * union."""
    total = F.col("n") + F.col("c")
    return 100 * (total - F.col("d")) >= percent * (total + F.col("d"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components at similarity percent/100 on `shingle`-word shingles."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = stored(docs.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, hi long, lo long, bands array<long>, bits array<long>"))
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    nodes = stored(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    most = nodes.count()

    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("bucket", "a")
    stars = compared(buckets.join(centres, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct(), docs, shingle, most)
    links = F.expr(f"100 * both >= {percent} * either")
    edges = stars.where(links).select("a", "b")
    met = stars.count()
    found = components(edges, met)

    # What the stars left apart: stars whose centres are in one component are joined to one star around that component's least node,
    # where its members are in several components; members come with their exact distance d to that centre.
    def label_of(found: DataFrame) -> DataFrame:
        return stored(nodes.join(found, "node", "left").select("node", "n", "bits", F.coalesce("component", "node").alias("component")), most)

    def mixed_of(members: DataFrame, label: DataFrame) -> DataFrame:
        """The stars (a, node) with members in several components, with the largest."""
        sizes = members.join(label.select("node", "component"), "node").groupBy("a", "component").agg(F.count("*").alias("size"))
        mixed = sizes.groupBy("a").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        return stored(mixed.select("a", F.col("top.component").alias("largest")), most)

    label = label_of(found)
    joined = stars.select("a", "b").join(label.select(F.col("node").alias("a"), F.col("component").alias("g")), "a")
    joined = stored(joined.select("g", F.explode(F.array("a", "b")).alias("node")).union(joined.select("g", "g")).distinct().withColumnRenamed("g", "a"), 2 * met + most)
    mixed = mixed_of(joined, label)
    stars = compared(joined.join(mixed, "a").where("node <> a").select("a", F.col("node").alias("b")), docs, shingle, most)
    centre = stars.select(F.col("a").alias("node")).distinct().withColumn("a", F.col("node")).select("a", "node", F.lit(0.0).alias("d"))
    reached = stars.count()
    members = stored(centre.union(stars.groupBy("a", F.col("b").alias("node")).agg(F.min(1 - F.col("both") / F.col("either")).alias("d"))), 2 * reached)
    met += 2 * reached
    near = _recentred(stars)
    second = near.where((F.col("node") != F.col("c2")) & _linked(percent)).select(F.col("c2").alias("a"), F.col("node").alias("b"))
    edges = stored(edges.union(stars.where(links).select("a", "b")).union(second).distinct(), met)
    found = components(edges, met)
    label = label_of(found)
    mixed = mixed_of(members.select("a", "node"), label)
    reach = 1 - percent / 100 + 1e-9
    rest = _by_difference(near.join(mixed.select("a"), "a"), label, percent)
    members = members.join(label.select("node", "component"), "node")

    rows = members.where(F.col("d") > CLOSE - reach).join(mixed, "a").withColumn("cell", F.floor(F.col("d") / reach)).join(label.select("node", "n", "bits"), "node")
    p = rows.where("component <> largest").select("a", F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1)))).alias("cell"), *(F.col(c).alias(f"p_{c}") for c in ("node", "component", "n", "d", "bits")))
    q = rows.select("a", "cell", "largest", *(F.col(c).alias(f"q_{c}") for c in ("node", "component", "n", "d", "bits")))
    once = (F.col("q_component") == F.col("largest")) | (F.col("p_node") < F.col("q_node"))
    far = p.join(q, (p.a == q.a) & (p.cell == q.cell) & once & _possible(percent)).select(F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b"))
    rest = stored(rest.union(far).distinct())
    if not rest.isEmpty():
        more = compared(rest, docs, shingle, most).where(links).select("a", "b")
        if not more.isEmpty():
            found = components(edges.union(more), met + rest.count())

    same = some.select("doc_id", "hi", "lo").join(nodes.select("hi", "lo", "node"), ["hi", "lo"])
    groups = same.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    least = groups.groupBy("doc_id").agg(F.min("c").alias("c"))
    out = sketch.select("doc_id", "n_shingles").join(least, "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


QUERIES = {"op10_near_dup": op10_near_dup}
ORACLE_SQL = {
    "op10_near_dup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id JOIN n x ON x.doc_id = p.doc_id JOIN n y ON y.doc_id = q.doc_id
  GROUP BY p.doc_id, q.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
}
