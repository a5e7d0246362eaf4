"""Language ID: word-first backoff.

A known word scores by its log frequency in each language. An unseen word scores by character n-grams: at each of its positions the
longest known n-gram (4, then 3, 2 and 1 characters, word ends marked) gives its log frequency by language; the mean of the positions
that have one counts for the word. A text's language has the largest sum over all its words; the score is that language's posterior share.

With c occurrences in language l, a word's log frequency is log((c + 0.5) / (C_l + V / 2)), where C_l are all occurrences and V all
distinct words of the training text; for n-grams (counted once for every distinct word) likewise. All of it is used: no word,
n-gram or language is cut off. Only what differs from c = 0 is kept, as a list of (language, log((c + 0.5) / 0.5)) a word.

Plan: one pass counts the words of every text (of training text by language) within a partition, then across. Known words have their
lists from the counts; those of unseen words come from joins of their n-grams with the counted n-grams. The most frequent words of all
texts (as many as CELLS allows at that number of languages) are broadcast, finished; every other word reaches its documents by a
shuffled join on the word's 64-bit hash, where, as the hot ones are broadcast, no key is frequent. The split changes no result.

Defined results: `und` with score 0 if the text is null or has no letter (Unicode category L), or if nothing was learned; ties go to the
smaller language name; rows with null lang aren't learned from; repeated rows give equal rows; texts of any length are read whole;
extra columns are ignored; an empty table gives an empty result. Training rows are the caller's choice (`trains`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm._common import bounded_batches, frequent, mix, stored, text_chunks

LONGEST = 4
#: Numbers of the broadcast table (words x languages).
CELLS = 400_000
#: Distinct words of a map task that are summed before they are passed on.
FLUSH = 500_000
#: Rows (of about 40 bytes) up to which the counted n-grams are broadcast to the unseen words.
BROADCAST_GRAMS = 200_000
#: Entries of a list that count words instead of naming a language: known ones, and unseen ones with some known n-gram.
KNOWN, BACKED = -1, -2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letters() -> np.ndarray:
    """Of every code point, whether it is a letter; packed bits."""
    return np.packbits(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(texts: list[str | None], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased texts: code points, begins and ends of the words, and their offsets by text."""
    low = [(t or "").lower() + " " for t in texts]
    c = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    on = letter[c]
    edge = np.diff(on.view(np.int8), prepend=np.int8(0))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return c, begins, ends, np.searchsorted(begins, np.cumsum([0, *map(len, low)]))


def word_keys(c: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    n = ends - begins
    to = np.cumsum(n)
    place = np.arange(to[-1]) - np.repeat(to - n, n)
    scale = np.cumprod(np.full(int(n.max()), _STEP), dtype=np.uint64)
    wide = (c[place + np.repeat(begins, n)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    wide ^= wide >> np.uint64(29)
    return mix(np.add.reduceat(wide * scale[place], to - n) + n.astype(np.uint64))


def spelled(c: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as strings."""
    n = ends - begins
    to = np.cumsum(n)
    part = c[np.arange(to[-1] if len(to) else 0) + np.repeat(begins - (to - n), n)]
    width = np.concatenate([[0], np.cumsum(1 + (part > 0x7F) + (part > 0x7FF) + (part > 0xFFFF))])
    offsets = np.concatenate([[0], width[to]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.tobytes().decode("utf-32-le").encode()))


def _counted(packed: np.ndarray):
    schema = pa.schema([("h", pa.int64()), ("word", pa.string()), ("lang", pa.string()), ("c", pa.int64())])

    def merged(held: list) -> tuple:
        """The parts (h, language number, count, word) with equal words of a language summed."""
        h, lang, c = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((lang, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (lang[order][1:] != lang[order][:-1])
        at = np.flatnonzero(new)
        first = order[at]
        return h[first], lang[first], np.add.reduceat(c[order], at), pa.concat_arrays([x[3] for x in held]).take(pa.array(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.unpackbits(packed).view(bool)
        names: dict[str | None, int] = {}
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            h, lang, c, word = merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), word, pa.array(list(names), pa.string()).take(pa.array(lang)), pa.array(c)], schema=schema)

        for batch, _, _ in text_chunks(batches):
            c, begins, ends, at = words(_column(batch, "text").to_pylist(), letter)
            if not len(begins):
                continue
            h = word_keys(c, begins, ends)
            row = np.array([names.setdefault(x, len(names)) for x in _column(batch, "lang").to_pylist()], np.int32)
            lang = np.repeat(row, np.diff(at))
            order = np.lexsort((lang, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (lang[order][1:] != lang[order][:-1])
            some = np.flatnonzero(new)
            first = order[some]
            held.append((h[first], lang[first], np.diff(np.append(some, len(h))), spelled(c, begins[first], ends[first])))
            count += len(some)
            if count > FLUSH:
                if len(held) > 1:
                    held[:] = [merged(held)]
                count = len(held[0][0])
                if count > FLUSH // 2:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    return run


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number, and for every place of the word (its ends marked) the hashes of the n-grams that begin there: LONGEST columns.

    Where a word ends before n characters the column holds a number that is no n-gram's."""
    own = ["\x02" + w + "\x03" for w in texts]
    size = np.array([len(x) for x in own])
    c = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(own)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))
    out = np.empty((len(c), LONGEST), np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, LONGEST + 1):
        next_ = np.zeros(len(c), np.uint64)
        next_[: len(c) - n + 1] = c[n - 1 :]
        h = h * _STEP + next_
        out[:, n - 1] = np.where(left >= n, mix(h) & ~np.uint64(1), mix(h + np.uint64(n)) | np.uint64(1))
    return word, out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of known words by language."""
    schema = pa.schema([("g", pa.int64()), ("l", pa.int32()), ("c", pa.int64())])
    for batch in batches:
        for i in range(0, batch.num_rows, 100_000):
            part = batch.slice(i, 100_000)
            word, g = gram_keys(_column(part, "word").to_pylist())
            lang = np.repeat(_column(part, "l").to_numpy().astype(np.int32)[word], LONGEST)
            g = g.ravel()
            real = (g & np.uint64(1)) == 0
            g, lang = g[real], lang[real]
            order = np.lexsort((lang, g))
            g, lang = g[order], lang[order]
            at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (lang[1:] != lang[:-1])])) if len(g) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(lang[at]), pa.array(np.diff(np.append(at, len(g))))], schema=schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of every place of the words."""
    for batch in batches:
        for i in range(0, batch.num_rows, 20_000):
            part = batch.slice(i, 20_000)
            word, g = gram_keys(_column(part, "word").to_pylist())
            yield pa.RecordBatch.from_arrays([_column(part, "h").take(pa.array(word)), *(pa.array(np.ascontiguousarray(g[:, n]).view(np.int64)) for n in range(LONGEST))], names=["h", *(f"g{n + 1}" for n in range(LONGEST))])


class Model:
    """The languages with the logarithms that stand for c = 0, and every word's list."""

    def __init__(self, langs: list[str], word_base: np.ndarray, gram_base: np.ndarray, lists: DataFrame | None):
        self.langs, self.word_base, self.gram_base, self.lists = langs, word_base, gram_base, lists


def train(docs: DataFrame) -> Model:
    """From rows (text, lang): lang is null where nothing is learned; the words of all rows get their lists."""
    counts = stored(docs.mapInArrow(_counted(letters()), "h long, word string, lang string, c long").groupBy("h", "word", "lang").agg(F.sum("c").alias("c")))
    mass = {r["lang"]: r["c"] for r in counts.where("lang is not null").groupBy("lang").agg(F.sum("c").alias("c")).collect()}
    langs = sorted(mass)
    if not langs:
        return Model([], np.zeros(0), np.zeros(0), None)
    number = F.create_map(*(x for i, n in enumerate(langs) for x in (F.lit(n), F.lit(i))))
    counts = counts.withColumn("l", number[F.col("lang")])
    held = F.collect_list(F.when(F.col("l").isNotNull(), F.struct(F.col("l").cast("int").alias("l"), F.log((F.col("c") + 0.5) / 0.5).alias("x"))))
    every = stored(counts.groupBy("h", "word").agg(F.sum("c").alias("all"), held.alias("list")))
    known, unseen = every.where(F.size("list") > 0), every.where(F.size("list") == 0)

    grams = known.select("word", F.explode("list.l").alias("l")).mapInArrow(_grams, "g long, l int, c long").groupBy("g", "l").agg(F.sum("c").alias("c"))
    grams = stored(grams.groupBy("g").agg(F.collect_list(F.struct("l", F.log((F.col("c") + 0.5) / 0.5).alias("x"))).alias("list"), F.collect_list(F.struct("l", "c")).alias("count")))
    n_grams = grams.count()
    gram_mass = {r["l"]: r["c"] for r in grams.select(F.inline("count")).groupBy("l").agg(F.sum("c").alias("c")).collect()}
    base = lambda mass, n: np.log(0.5) - np.log(np.array(mass, float) + n / 2)
    word_base, gram_base = base([mass[x] for x in langs], known.count()), base([gram_mass.get(i, 0) for i in range(len(langs))], n_grams)

    grams = grams.select("g", "list")
    places = unseen.select("h", "word").mapInArrow(_places, "h long, " + ", ".join(f"g{n + 1} long" for n in range(LONGEST)))
    for n in range(LONGEST, 0, -1):
        of = grams.select(F.col("g").alias(f"g{n}"), F.col("list").alias(f"list{n}"))
        places = places.join(F.broadcast(of) if n_grams <= BROADCAST_GRAMS else of, f"g{n}", "left").drop(f"g{n}")
    found = places.select("h", F.coalesce(*(F.col(f"list{n}") for n in range(LONGEST, 0, -1))).alias("list")).where("list is not null")
    one = F.array(F.struct(F.lit(BACKED).alias("l"), F.lit(1.0).cast("double").alias("x")))
    sums = found.select("h", F.inline(F.concat("list", one))).groupBy("h", "l").agg(F.sum("x").alias("x"))
    back = sums.groupBy("h").agg(F.collect_list(F.struct("l", "x")).alias("list"))
    places_of = F.filter("list", lambda p: p["l"] == BACKED)[0]["x"]
    mean = F.transform("list", lambda p: F.struct(p["l"].alias("l"), F.when(p["l"] == BACKED, F.lit(1.0)).otherwise(p["x"] / F.col("n")).alias("x")))
    back = back.withColumn("n", places_of).select("h", mean.alias("list"))
    count = F.array(F.struct(F.lit(KNOWN).alias("l"), F.lit(1.0).cast("double").alias("x")))
    lists = known.select("h", "all", F.concat("list", count).alias("list")).unionByName(unseen.select("h", "all").join(back, "h"))
    return Model(langs, word_base, gram_base, stored(lists))


def _sums(packed: np.ndarray, keys: np.ndarray, table: np.ndarray):
    """Of each row the sums of its frequent words, and the other words with their numbers. table: words x (languages, KNOWN, BACKED)."""
    schema = pa.schema([("doc_id", pa.int64()), ("some", pa.bool_()), ("sums", pa.list_(pa.float64())), ("hs", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.unpackbits(packed).view(bool)
        width = table.shape[1]
        for batch, _, _ in text_chunks(batches):
            c, begins, ends, at = words(_column(batch, "text").to_pylist(), letter)
            h, rows = word_keys(c, begins, ends), batch.num_rows
            row = np.repeat(np.arange(rows), np.diff(at))
            place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            own = keys[place] == h if len(keys) else np.zeros(len(h), bool)
            place, of = place[own], row[own]
            sums = np.stack([np.bincount(of, table[place, k], rows) for k in range(width)], axis=1)
            row, rare = row[~own], h[~own]
            order = np.lexsort((rare, row))
            row, rare = row[order], rare[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (rare[1:] != rare[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(row))).astype(np.int32)
            offsets = pa.array(np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "doc_id"), pa.array(np.diff(at) > 0), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(sums.ravel())),
                 pa.ListArray.from_arrays(offsets, pa.array(rare[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(tf))],
                schema=schema,
            )

    return run


def _judged(model: Model):
    """lang_pred and score from the sums of both kinds of words."""
    names, base = np.array(model.langs), np.stack([model.word_base, model.gram_base])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.array(_column(batch, "sums").to_pylist(), float).reshape(batch.num_rows, len(names) + 2)
            for i, more in enumerate(_column(batch, "more").to_pylist()):
                for m in more or ():
                    total[i, m["l"]] += m["x"]
            score = total[:, :-2] + total[:, [KNOWN, BACKED]] @ base
            best = score.argmax(axis=1)
            share = 1 / np.exp(score - score[np.arange(len(best)), best][:, None]).sum(axis=1)
            some = _column(batch, "some").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(np.where(some, names[best], "und").tolist(), pa.string()), pa.array(np.where(some, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, trains: Column) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text, lang); learns from text and lang where `trains` holds."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(trains, F.col("lang").cast("string")).alias("lang"))
    model = train(docs.select("text", "lang"))
    if not model.langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    width = len(model.langs) + 2
    top = frequent(model.lists, "all", CELLS // width).toArrow()
    keys = top.column("h").to_numpy().view(np.uint64)
    table = np.zeros((len(keys), width))
    lists = top.column("list").combine_chunks()
    word = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
    table[word, lists.values.field("l").to_numpy()] = lists.values.field("x").to_numpy()
    order = np.argsort(keys)
    rows = docs.select("doc_id", "text").mapInArrow(_sums(letters(), keys[order], table[order]), "doc_id long, some boolean, sums array<double>, hs array<long>, tf array<int>")
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()))
    rare = rows.select("key", F.explode(F.arrays_zip("hs", "tf")).alias("w")).select("key", F.col("w.hs").alias("h"), F.col("w.tf").alias("tf"))
    hits = rare.join(model.lists.select("h", "list"), "h").select("key", "tf", F.inline("list")).groupBy("key", "l").agg(F.sum(F.col("tf") * F.col("x")).alias("x"))
    more = hits.groupBy("key").agg(F.collect_list(F.struct("l", "x")).alias("more"))
    return rows.select("key", "doc_id", "some", "sums").join(more, "key", "left").drop("key").mapInArrow(_judged(model), "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    found = language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"), rest != 2)
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
