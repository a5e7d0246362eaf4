"""LM scoring: a hidden Markov language model, and the add-one unigram base it is compared with.

Tokens are whitespace-separated words, A-Z lower-cased, then one end token a document. Counts of every token of every training
document are one aggregate over 64-bit word hashes (map-side sums first). The model emits a token in two steps, so that what is
broadcast keeps a fixed size while every count is used:

    P(w | state) = P(class(w) | state) * P(w | class(w))

Classes are the most frequent words (at most TOP), one each, and SUFFIXES buckets of a hash of the last three bytes for all other words;
within a bucket P(w | class) = (count(w) + 1) / (count of the bucket + distinct words of the bucket + 1), which leaves one
share for an unseen word. States and transitions come from Baum-Welch: each pass runs scaled forward-backward over all training
text in windows, expected counts are summed within a partition and aggregated across partitions, and the re-estimated model (at most
classes x STATES numbers) goes back to the driver. Passes start from the counts of all pairs of neighbouring tokens of all training
text, in 2 * COARSE groups of classes: the driver fits states, transitions and the groups' emissions to that table of fixed size by expectation
maximisation, and classes share their group's emissions in proportion to their own counts. No text is left out and none is sampled.

The scaled forward recursion gives a text's exact likelihood; texts over LONG tokens are cut into windows whose scaled transfer
matrices are multiplied, which is the same sum. Counts of words outside the TOP reach their documents by a shuffled join on the
word hash, never by broadcast.

Defined results: null and empty texts have the end token alone; with no training text N and V are 0; a null doc_id counts as
training (not held out); repeated rows (same doc_id and text) give one row each, equal; extra columns are ignored; an empty
table gives an empty result. Word hashes of 64 bits may collide with a chance of about V*V/2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._common import bounded_batches, frequent, mix, stored, text_chunks, word_hashes

TOP, SUFFIXES, STATES, WINDOW, LONG = 32768, 4096, 8, 128, 512
#: Full passes; the most frequent words, and groups of all others, whose pairs are counted for the start; its steps at most.
PASSES, COARSE, START_STEPS = 2, 256, 300
#: Words that one map task sums before it passes them on.
FLUSH_WORDS = 3_000_000
END = int(mix(np.array([0x454E44], np.uint64)).view(np.int64)[0])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("s", pa.int32()), ("c", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    docs = words = 0

    def flush() -> pa.RecordBatch:
        h, first, c = np.unique(np.concatenate([x for x, _ in held]), return_index=True, return_counts=True)
        s = np.concatenate([x for _, x in held])[first]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s), pa.array(c.astype(np.int64))], schema=schema)

    for batch, data, off in text_chunks(batches):
        h, _, s = word_hashes(data, off, suffix=True)
        held.append((h, (s % np.uint64(SUFFIXES)).astype(np.int32)))
        docs += batch.num_rows
        words += len(h)
        if words >= FLUSH_WORDS:
            yield flush()
            words = 0
    if held:
        yield flush()
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([0], pa.int32()), pa.array([docs])], schema=schema)


class Classes:
    """The bounded part of the counts: class of a token and the within-class logarithms."""

    def __init__(self, top: np.ndarray, top_counts: np.ndarray, bucket_count: np.ndarray, bucket_words: np.ndarray, ends: int, total: int, distinct: int):
        self.top, self.top_counts, self.ends, self.total, self.distinct = top, top_counts, ends, total, distinct
        self.bucket_log = np.log10(bucket_count + bucket_words + 1.0)
        self.size = len(top) + SUFFIXES + 1
        self.end_class = self.size - 1
        mass = np.concatenate([top_counts, bucket_count, [ends]]) + 1.0
        self.prior = mass / mass.sum()

    def groups(self) -> np.ndarray:
        """The group of each class: the most frequent words one each, words in COARSE - 1 groups by class and, for the last, end tokens."""
        group = COARSE + np.arange(self.size) % (COARSE - 1)
        group[np.argsort(-self.top_counts, kind="stable")[:COARSE]] = np.arange(min(COARSE, len(self.top)))
        group[self.end_class] = 2 * COARSE - 1
        return group

    def of(self, h: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and which tokens have one of their own."""
        if not len(self.top):
            return s.astype(np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        own = self.top[at] == h
        return np.where(own, at, len(self.top) + s), own

    def sequences(self, data: np.ndarray, off: np.ndarray):
        """Token classes with the end tokens, offsets by row; word hashes, their offsets, and which have an own class."""
        h, at, s = word_hashes(data, off, suffix=True)
        cls, own = self.of(h, (s % np.uint64(SUFFIXES)).astype(np.int64))
        rows = len(at) - 1
        heads = at + np.arange(rows + 1)
        seq = np.full(heads[-1], self.end_class, np.int64)
        seq[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(at))] = cls
        return seq, heads, h, at, cls, own


class Model:
    def __init__(self, start: np.ndarray, middle: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.middle, self.move, self.emit = start, middle, move, emit  # emit: classes x states


def fresh(classes: Classes, states: int = STATES) -> Model:
    rng = np.random.default_rng(7)
    emit = classes.prior[:, None] * rng.uniform(0.5, 1.5, (classes.size, states))
    move = np.full((states, states), 0.03 / max(states - 1, 1))
    np.fill_diagonal(move, 0.97 if states > 1 else 1.0)
    even = np.full(states, 1.0 / states)
    return Model(even, even, move, emit / emit.sum(axis=0))


def _pair_map(classes: Classes):
    """Counts of the groups of neighbouring tokens, as first * 2 * COARSE + second."""
    schema = pa.schema([("g", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sums = classes.groups(), np.zeros(4 * COARSE * COARSE, np.int64)
        for _, data, off in text_chunks(batches):
            seq, heads, *_ = classes.sequences(data, off)
            within = np.ones(len(seq), bool)
            within[heads[1:] - 1] = False  # a row's last token has no next one
            first = np.flatnonzero(within)
            sums += np.bincount(group[seq[first]] * 2 * COARSE + group[seq[first + 1]], minlength=len(sums))
        g = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(sums[g])], schema=schema)

    return run


def started(classes: Classes, pairs: np.ndarray, states: int = STATES) -> Model:
    """The model whose neighbouring tokens have the given counts of pairs of groups, by expectation maximisation from a fixed start."""
    model, group = fresh(classes, states), classes.groups()
    if not pairs.any():
        return model
    prior = np.bincount(group, classes.prior, len(pairs))
    emit = np.stack([np.bincount(group, model.emit[:, k], len(pairs)) for k in range(states)], axis=1)
    both, last = model.middle[:, None] * model.move, -np.inf
    for _ in range(START_STEPS):
        chance = emit @ both @ emit.T
        log = float((pairs * np.log10(np.maximum(chance, 1e-300))).sum())
        if log - last < 1e-6 * abs(log):
            break
        last = log
        share = pairs / np.maximum(chance, 1e-300)
        seen = emit * (share @ emit @ both.T + share.T @ emit @ both) + 100.0 * prior[:, None]
        both = both * (emit.T @ share @ emit) + 0.1
        both, emit = both / both.sum(), seen / seen.sum(axis=0)
    each = classes.prior[:, None] * (emit / np.maximum(prior, 1e-300)[:, None])[group]
    at = both.sum(axis=1)
    return Model(at, at, both / at[:, None], each / each.sum(axis=0))


def _windows(heads: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length, row and 'first of its row' of the windows, longest first."""
    lens = np.diff(heads)
    each = -(-lens // size)
    row = np.repeat(np.arange(len(lens)), each)
    k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    begin = heads[row] + k * size
    length = np.minimum(size, heads[row + 1] - begin)
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order], row[order], (k == 0)[order]


def expect(model: Model, seq: np.ndarray, heads: np.ndarray, sums: dict) -> None:
    """Adds the expected counts of the sequences, in windows, to sums: start, middle, move, emit, log."""
    begin, length, _, first = _windows(heads, WINDOW)
    if not len(begin):
        return
    steps, states = int(length[0]), len(model.start)
    live = np.searchsorted(-length, -np.arange(1, steps + 1), "right")  # windows with more than t tokens
    alpha, scale = [], []
    for t in range(steps):
        b = model.emit[seq[begin[: live[t]] + t]]
        a = (np.where(first[:, None], model.start, model.middle) if t == 0 else alpha[-1][: live[t]] @ model.move) * b
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha.append(a)
        scale.append(c)
    sums["log"] += sum(float(np.log10(c).sum()) for c in scale)
    beta = np.ones((live[-1], states))
    gammas, places = [], []
    move = np.zeros((states, states))
    for t in range(steps - 1, -1, -1):
        gamma = alpha[t] * beta
        gammas.append(gamma)
        places.append(seq[begin[: live[t]] + t])
        if t:
            w = model.emit[places[-1]] * beta / scale[t][:, None]
            move += alpha[t - 1][: live[t]].T @ w
            back = np.ones((live[t - 1], states))
            back[: live[t]] = w @ model.move.T
            beta = back
    sums["move"] += move * model.move
    sums["start"] += gammas[-1][first].sum(axis=0)
    place, gamma = np.concatenate(places), np.concatenate(gammas)
    sums["middle"] += gamma.sum(axis=0)
    for k in range(states):
        sums["emit"][:, k] += np.bincount(place, gamma[:, k], len(model.emit))


def nothing(model: Model) -> dict:
    n = len(model.start)
    return {"log": 0.0, "start": np.zeros(n), "middle": np.zeros(n), "move": np.zeros((n, n)), "emit": np.zeros_like(model.emit)}


def estimated(sums: dict, classes: Classes) -> Model:
    def share(x):
        return x / x.sum(axis=-1, keepdims=True)

    emit = sums["emit"] + 100.0 * classes.prior[:, None]
    return Model(share(sums["start"] + 0.1), share(sums["middle"] + 0.1), share(sums["move"] + 0.1), emit / emit.sum(axis=0))


def log_likelihood(model: Model, seq: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """log10 of each row's exact likelihood by the scaled forward recursion."""
    lens = np.diff(heads)
    out = np.zeros(len(lens))
    states = len(model.start)
    short = np.flatnonzero((lens <= LONG) & (lens > 0))
    short = short[np.argsort(-lens[short], kind="stable")]
    if len(short):
        n = lens[short]
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
        a = np.broadcast_to(model.start, (len(short), states))
        for t in range(int(n[0])):
            a = (a[: live[t]] @ model.move if t else a) * model.emit[seq[heads[short[: live[t]]] + t]]
            c = a.sum(axis=1)
            a = a / c[:, None]
            out[short[: live[t]]] += np.log10(c)
    long = np.flatnonzero(lens > LONG)
    if len(long):
        ends = np.cumsum(lens[long])
        src = np.arange(ends[-1]) + np.repeat(heads[long] - (ends - lens[long]), lens[long])
        part = seq[src]
        begin, length, row, first = _windows(np.concatenate([[0], ends]), WINDOW)
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        m = np.broadcast_to(np.eye(states), (len(begin), states, states)).copy()
        logs = np.zeros(len(begin))
        for t in range(int(length[0])):
            k = live[t]
            x = m[:k].reshape(-1, states) @ model.move
            if t == 0:  # a row's first token has no transition
                x = np.where(np.repeat(first, states)[:, None], m.reshape(-1, states), x)
            x = x.reshape(k, states, states) * model.emit[part[begin[:k] + t]][:, None, :]
            c = x.sum(axis=(1, 2))
            m[:k] = x / c[:, None, None]
            logs[:k] += np.log10(c)
        a = None
        for w in np.lexsort((begin, row)):
            a = (model.start if first[w] else a) @ m[w]
            c = a.sum()
            a = a / c
            out[long[row[w]]] += logs[w] + math.log10(c)
    return out


def _expect_map(classes: Classes, model: Model):
    states = len(model.start)
    schema = pa.schema([("g", pa.int32()), *((f"k{k}", pa.float64()) for k in range(states))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = nothing(model), False
        for _, data, off in text_chunks(batches):
            seq, heads, *_ = classes.sequences(data, off)
            expect(model, seq, heads, sums)
            some = True
        if some:
            rows = np.concatenate([sums["emit"], sums["start"][None], sums["middle"][None], sums["move"]])
            g = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), *(pa.array(rows[g, k]) for k in range(states))], schema=schema)

    return run


def _score_map(classes: Classes, model: Model):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("hs", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32()))])
    own_log = np.log10(classes.top_counts + 1.0)
    share = math.log10(classes.total + classes.distinct + 1)

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(values)])
        return run[at[1:]] - run[at[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in text_chunks(batches):
            seq, heads, h, at, cls, own = classes.sequences(data, off)
            n = np.diff(heads)
            base = sums(np.where(own, own_log[np.minimum(cls, len(own_log) - 1)] if len(own_log) else 0.0, 0.0), at) + math.log10(classes.ends + 1) - n * share
            ll = log_likelihood(model, seq, heads) - sums(np.where(own, 0.0, classes.bucket_log[np.maximum(cls - len(own_log), 0) % SUFFIXES]), at)
            known = sums(own, at).astype(np.int64) + (classes.ends > 0)
            row = np.repeat(np.arange(len(n)), np.diff(at))[~own]
            rare = h[~own]
            order = np.lexsort((rare, row))
            row, rare = row[order], rare[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (rare[1:] != rare[:-1])
            begins = np.flatnonzero(new)
            tf = np.diff(np.append(begins, len(row))).astype(np.int32)
            lists = pa.array(np.searchsorted(row[begins], np.arange(len(n) + 1)).astype(np.int32))
            take = lambda c: batch.column(batch.schema.get_field_index(c))
            yield pa.RecordBatch.from_arrays(
                [take("key"), take("doc_id"), take("held_out"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(ll), pa.ListArray.from_arrays(lists, pa.array(rare[begins].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(tf))],
                schema=schema,
            )

    return run


def train(docs: DataFrame) -> tuple[Classes, Model, DataFrame]:
    """From the text of docs: the classes, the model, and the counts (h, s, c) of all tokens."""
    text = docs.select("text")
    counts = stored(text.mapInArrow(_count, "h long, s int, c long").groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("h") == END, F.col("c"))), F.lit(0)).alias("e")).first()
    words = counts.where(F.col("h") != END)
    top = frequent(words, "c", TOP).toArrow()
    h, s, c = (top.column(x).to_numpy() for x in ("h", "s", "c"))
    order = np.argsort(h.view(np.uint64))
    buckets = words.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    bc, bv = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    bc[buckets.column("s").to_numpy()] = buckets.column("c").to_numpy()
    bv[buckets.column("s").to_numpy()] = buckets.column("v").to_numpy()
    np.subtract.at(bc, s, c)
    np.subtract.at(bv, s, 1)
    classes = Classes(h.view(np.uint64)[order], c[order], bc, bv, total["e"], total["n"], total["v"])

    pairs = np.zeros(4 * COARSE * COARSE)
    if total["n"]:
        got = text.mapInArrow(_pair_map(classes), "g int, c long").groupBy("g").agg(F.sum("c").alias("c")).toArrow()
        pairs[got.column("g").to_numpy()] = got.column("c").to_numpy()
    model = started(classes, pairs.reshape(2 * COARSE, 2 * COARSE))
    for _ in range(PASSES if total["n"] else 0):
        cols = [f"k{k}" for k in range(STATES)]
        got = text.mapInArrow(_expect_map(classes, model), "g int, " + ", ".join(f"{x} double" for x in cols)).groupBy("g").agg(*(F.sum(x).alias(x) for x in cols)).toArrow()
        rows = np.zeros((classes.size + 2 + STATES, STATES))
        rows[got.column("g").to_numpy()] = np.stack([got.column(x).to_numpy() for x in cols], axis=1)
        n = classes.size
        model = estimated({"emit": rows[:n], "start": rows[n], "middle": rows[n + 1], "move": rows[n + 2 :]}, classes)
    return classes, model, counts


def hmm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from rows that aren't held_out."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    classes, model, counts = train(docs.where(~F.col("held_out")))
    rows = stored(
        docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "held_out", "text").mapInArrow(
            _score_map(classes, model), "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, hs array<long>, tf array<int>"
        )
    )
    rare = rows.select("key", F.explode(F.arrays_zip("hs", "tf")).alias("x")).select("key", F.col("x.hs").alias("h"), F.col("x.tf").alias("tf"))
    sums = rare.join(counts.select("h", "c"), "h").groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("found"))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))  # equal rows share a key, and their sums
    out = rows.drop("hs", "tf").join(copies.join(sums, "key", "left"), "key")
    more = F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce((F.col("found") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(classes.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hmm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


QUERIES = {"op8_lm_score": op8_lm_score}
ORACLE_SQL: dict[str, str] = {}
