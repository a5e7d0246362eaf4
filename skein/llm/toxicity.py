"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

1. Token log-odds. Words of labelled training texts are counted by label, once a text, so that one long or repetitive text weighs no
   more than another. A word's log-odds toxic : clean has an informative Dirichlet prior, centred on the log-odds of the word's first
   PREFIX letters (themselves smoothed by the overall rates). Words whose log-odds are above MIN_ODDS and significant (z above MIN_Z)
   keep log p(w|toxic)/p(w|clean); so do word beginnings, for words that were too rare to judge: unseen forms of a known stem
   score too. All other tokens share one small negative score, the log-ratio of "no such word here".
2. Segments. A linear scan finds every maximal scoring segment of a text (Ruzzo and Tompa); runs of background tokens count as one
   step, so the scan's work follows the scored tokens.
3. Calibration. For a random text of n tokens the best score follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x));
   lambda solves E[exp(lambda s)] = 1 over clean tokens and K is fitted to the clean texts' best scores. Segments with
   P < SEGMENT_P are significant. -log10 P of the best segment, in BINS steps, is turned into a probability by the label counts of
   each step, made monotone.

Labels are fitted on at most SAMPLE_ROWS labelled rows (least hash of doc_id first), the documented bound of this classifier, so
that sample's ids can be broadcast; its texts are read whole. All documents are scored whole.

Defined results: null, empty and wordless texts have no segment and the probability of "no segment"; labels null are ignored and of
several labels for a doc_id the largest counts; without labelled rows of both kinds every score is the share of toxic labels
(0 without labels); extra columns are ignored; an empty table gives an empty result; repeated rows give equal rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._common import bounded_batches, stored, text_chunks

SAMPLE_ROWS = 40_000
PREFIX, MIN_Z, MIN_ODDS, STRENGTH, MAX_TERMS = 4, 4.0, 2.5, 4.0, 20_000
#: Texts from which on a word is judged by itself, not by its beginning.
ENOUGH = 8
SEGMENT_P, BINS = 1e-3, 60
WORD = re.compile(r"[^\W\d_]+")
COUNTS = ("t", "c", "tt", "tc")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, toxic and clean texts with it, its occurrences in them) of words (w), word beginnings (p) and all together (all)."""
    schema = pa.schema([("kind", pa.string()), ("term", pa.string()), *((c, pa.int64()) for c in COUNTS)])
    texts_by: dict[str, tuple[Counter, Counter]] = {k: (Counter(), Counter()) for k in ("w", "p", "all")}
    times: tuple[Counter, Counter] = Counter(), Counter()

    def flush():
        for kind, (clean, toxic) in texts_by.items():
            terms = list(clean.keys() | toxic.keys())
            columns = [[x[t] for t in terms] for x in (toxic, clean, *((times[1], times[0]) if kind != "p" else (Counter(), Counter())))]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(terms), pa.string()), pa.array(terms, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)
            clean.clear()
            toxic.clear()
        for c in times:
            c.clear()

    for batch, _, _ in text_chunks(batches):
        for text, toxic in zip(texts(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
            words = words_of(text)
            once = set(words)
            times[toxic].update(words)
            times[toxic][""] += len(words)
            texts_by["w"][toxic].update(once)
            texts_by["p"][toxic].update({w[:PREFIX] for w in once if len(w) > PREFIX})
            texts_by["all"][toxic][""] += 1
        if len(times[0]) + len(times[1]) > 150_000:
            yield from flush()
    yield from flush()


class Scorer:
    """Scores of significant words and word beginnings, the background score, and the calibration."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], background: float):
        self.words, self.prefixes, self.background = words, prefixes, background
        self.scale, self.size, self.curve = 1.0, 1.0, [0.0] * (BINS + 1)

    def tokens(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and scores of the tokens that aren't background."""
        get, pre = self.words.get, self.prefixes.get
        out = []
        for i, w in enumerate(words):
            s = get(w)
            if s is None:
                s = pre(w[:PREFIX]) if len(w) > PREFIX else None
            if s:
                out.append((i, s))
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (begin, end, score): Ruzzo and Tompa's list of candidates with cumulative sums."""
        found: list[list[float]] = []  # left sum, right sum, begin, end, the last candidate before it with a smaller left sum
        total, at = 0.0, 0
        for i, s in self.tokens(words):
            total += (i - at) * self.background
            at = i + 1
            left, total = total, total + s
            if s <= 0:
                continue
            cand = [left, total, i, i + 1, -1]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][0] >= cand[0]:
                    j = found[j][4]  # those between have larger left sums still
                if j < 0 or found[j][1] >= cand[1]:
                    found.append([*cand[:4], j])
                    break
                cand = [found[j][0], cand[1], found[j][2], cand[3], -1]
                del found[j:]
        return [(int(b), int(e), hi - lo) for lo, hi, b, e, _ in found]

    def surprise(self, score: float, n: int) -> float:
        """-log10 P(a clean text of n tokens has a segment of this score)."""
        x = math.log(max(self.size * max(n, 1), 1e-300)) - self.scale * score
        return -(x / math.log(10)) if x < -30 else -math.log10(max(-math.expm1(-math.exp(min(x, 700.0))), 1e-300))

    def step(self, best: float, n: int) -> int:
        return 0 if best <= 0 else 1 + min(int(4 * self.surprise(best, n)), BINS - 1)

    def probability(self, best: float, n: int) -> float:
        return self.curve[self.step(best, n)]


def _best(scorer: Scorer):
    """Of each labelled text: label, tokens, best segment, and sums for the background's moments."""
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("s", pa.float64()), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_chunks(batches):
            rows = []
            for text, toxic in zip(texts(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
                w = words_of(text)
                hot = [s for _, s in scorer.tokens(w) if s > 0]
                rows.append((toxic, len(w), max([s for *_, s in scorer.segments(w)], default=0.0), sum(hot) / max(len(hot), 1), len(hot)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def fit(labelled: DataFrame) -> Scorer:
    """From rows (text, toxic 0 or 1), a bounded sample."""
    counts = labelled.mapInArrow(_count, "kind string, term string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("kind", "term")
    counts = stored(counts.agg(*(F.sum(c).alias(c) for c in COUNTS)))
    total = counts.where("kind = 'all'").first()
    if not (total and total["t"] and total["c"] and total["tt"] and total["tc"]):
        scorer = Scorer({}, {}, -1.0)
        share = labelled.agg(F.avg("toxic").alias("x")).first()["x"]
        scorer.curve = [float(share or 0.0)] * (BINS + 1)
        return scorer
    nt, nc = total["t"], total["c"]
    rate = nt / (nt + nc)
    # Beginnings: prior at the overall rate. Words: prior at their beginning's smoothed rate.
    pre = counts.where("kind = 'p'").select(F.col("term").alias("stem"), ((F.col("t") + STRENGTH * rate) / (F.col("t") + F.col("c") + STRENGTH)).alias("r"), F.col("t").alias("pt"), F.col("c").alias("pc"))

    def judged(df: DataFrame, t: Column, c: Column, prior: Column) -> DataFrame:
        a, b = t + STRENGTH * prior, c + STRENGTH * (1 - prior)
        odds = F.log(a / (nt + STRENGTH * rate)) - F.log(b / (nc + STRENGTH * (1 - rate)))
        z = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        return df.withColumns({"odds": odds, "z": z, "hot": (z > MIN_Z) & (odds > MIN_ODDS) & (t >= 2)})

    words = counts.where("kind = 'w'").withColumn("stem", F.substring("term", 1, PREFIX)).join(pre, "stem", "left").withColumn("r", F.coalesce("r", F.lit(rate)))
    words = stored(judged(words, F.col("t"), F.col("c"), F.col("r")))
    got = words.where("hot").orderBy(F.desc("z"), "term").limit(MAX_TERMS).select("term", "odds", "tt", "tc").collect()
    stems = judged(pre, F.col("pt"), F.col("pc"), F.lit(rate)).where("hot").orderBy(F.desc("z"), "stem").limit(MAX_TERMS)
    heads = {r["stem"]: r["odds"] for r in stems.select("stem", "odds").collect()}
    # Words of hot beginnings that are known well enough and not hot themselves score nothing.
    cold = words.where((F.col("odds") < MIN_ODDS) & (F.col("t") + F.col("c") >= ENOUGH) & F.col("stem").isin(list(heads) or [""])).orderBy(F.desc("c"), "term").limit(MAX_TERMS)
    known = {r["term"]: 0.0 for r in cold.select("term").collect()} | {r["term"]: r["odds"] for r in got}
    ht, hc = sum(r["tt"] for r in got) / total["tt"], sum(r["tc"] for r in got) / total["tc"]
    background = math.log((1 - ht) / (1 - hc)) if ht < 1 and hc < 1 else -0.01
    scorer = Scorer(known, heads, min(background, -1e-3))

    rows = labelled.mapInArrow(_best(scorer), "toxic int, n long, best double, s double, k long").toPandas()
    clean = rows[rows.toxic == 0]
    if len(clean):
        hot, n = float((clean.k).sum()), float(max(clean.n.sum(), 1))
        share, mean = max(hot / n, 1e-7), float((clean.s * clean.k).sum() / hot) if hot else 5.0
        low, high = 1e-6, 60.0  # lambda: share * exp(lambda * mean) + (1 - share) * exp(lambda * background) = 1
        for _ in range(200):
            mid = (low + high) / 2
            over = math.log(share) + mid * mean > 700 or share * math.exp(mid * mean) + (1 - share) * math.exp(mid * scorer.background) > 1
            low, high = (low, mid) if over else (mid, high)
        scorer.scale = min(high, 5.0)
        # K by moments of the law: the number of clean texts that reach x is about the sum of K n exp(-lambda x).
        x = 1.0
        scorer.size = min(max(float((clean.best > x).sum()) / (n * math.exp(-scorer.scale * x)), 1e-9), 1.0)
    steps = np.array([scorer.step(b, n) for b, n in zip(rows.best, rows.n, strict=True)], int)
    total_by, toxic_by = np.bincount(steps, minlength=BINS + 1).astype(float), np.bincount(steps, rows.toxic, BINS + 1)
    share = float(rows.toxic.mean()) if len(rows) else 0.0
    blocks: list[list[float]] = []  # pooled until monotone: toxic, all, steps
    for t, c in zip(toxic_by + 0.05 * share, total_by + 0.05, strict=True):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + c, blocks[-1][2] + k]
    scorer.curve = [t / c for t, c, k in blocks for _ in range(int(k))]
    return scorer


def _score(scorer: Scorer, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_chunks(batches):
            score, count, spans = [], [], []
            for text in texts(batch):
                w = words_of(text)
                seg = scorer.segments(w)
                kept = [(b, e, s) for b, e, s in seg if scorer.surprise(s, len(w)) > -math.log10(SEGMENT_P)]
                score.append(scorer.probability(max([s for *_, s in seg], default=0.0), len(w)))
                count.append(len(kept))
                spans.append([{"first_word": b, "end_word": e, "score": s} for b, e, s in kept])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(spans, span)], names=[*columns, "toxic_score", "n_segments", "segments"])

    return run


def _fitted(docs: DataFrame, labels: DataFrame, trains: Column) -> Scorer:
    bounded_batches(docs.sparkSession)
    marked = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    ids = marked.withColumn("t", trains).where("t").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = stored(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    # At most SAMPLE_ROWS rows of 12 bytes: the broadcast has a fixed bound.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return fit(rows.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")))


SEGMENTS = "array<struct<first_word: long, end_word: long, score: double>>"


def toxicity(docs: DataFrame, labels: DataFrame, trains: Column) -> DataFrame:
    """doc_id, text, toxic_score (0 to 1), n_segments and segments (word positions of the significant ones) of every row of docs.

    Learns from rows of docs where `trains` holds and that labels has a toxic value for."""
    scorer = _fitted(docs, labels, trains)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(scorer, ["doc_id", "text"]), f"doc_id long, text string, toxic_score double, n_segments long, segments {SEGMENTS}")


def without_toxic(docs: DataFrame, labels: DataFrame, trains: Column, reject: float) -> DataFrame:
    """The rows of docs with a score below reject; all columns stay as they are."""
    scorer = _fitted(docs, labels, trains)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    held = docs.toDF(*names).withColumn("text", F.col(names[at]).cast("string"))
    more = T.StructType().add("toxic_score", "double").add("n_segments", "long").add("segments", T._parse_datatype_string(SEGMENTS))
    out = held.mapInArrow(_score(scorer, names), T.StructType([*held.select(*names).schema.fields, *more.fields]))
    return out.where(F.col("toxic_score") < reject).select(*names).toDF(*docs.columns)


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels, _remainder(4) != 2).select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"), "n_segments"
    )


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
