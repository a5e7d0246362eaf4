"""PII: base patterns, and information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by linear scans. The method adds terms: words
that give a protected value away. Over the whole corpus it is counted how often a term stands within RADIUS words of each
protected value, n(t, v), and how often it occurs at all, n(t), copies of a text counted once in both. With P(v | t) = n(t, v) / (n(t) + SHRINK),
the information content I(v) = -log2 P(v), where P(v) is the share of words near v, and the pointwise mutual information
PMI(t; v) = log2(P(v | t) / P(v)), a term discloses v where

    PMI(t; v) / I(v) >= GENERALISE    (towards 1 the term alone identifies the value)

SHRINK stands for occurrences not seen: one joint occurrence leaves 1.3 bits in doubt, which is much in a small corpus and little in a large
one, so values that occur only once are protected too, by the terms that occur hardly anywhere else. Terms at REMOVE or above are
removed, those below are generalised. A term is treated everywhere in the texts that hold the value it discloses, and nowhere else, so
documents without protected values stay as they are.

Plan: one pass finds base spans and window terms (at most 2 * RADIUS a span, linear in the text); word counts of the corpus are
summed within a partition, then across; the counts meet only the terms near protected values (a shuffled join on the term's hash).
Of texts that occur more than once one row is counted. Texts with disclosing terms are read once more to find their places. What
is broadcast is counted first; beyond the limit the join is a shuffle that deals the rows of a hot text to many tasks.

Defined results: null text has no spans (sanitised: null); empty text has none; repeated rows give equal rows and count as one
document; texts of any length are read whole; a span's offsets are code points, end exclusive; extra columns of any name are kept by
`sanitised`, ignored by `find_pii`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._common import bounded_batches, joined, stored, text_chunks

KINDS = ("email", "ip", "card", "phone", "term")
RADIUS, SHRINK, GENERALISE, REMOVE = 6, 1.5, 0.9, 0.98
FLUSH = 150_000
#: Rows, or list entries, of at most 24 bytes that may be broadcast.
BROADCAST_ROWS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the base patterns: by begin, then kind as listed."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:  # the local part is the run of its letters before the sign, from the last match's end
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            end = m.end()
            out.append((begin, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((at, m.end(), "phone"))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def window_terms(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(begin, end, term, value) of the terms within RADIUS terms of a span, outside all spans."""
    taken = sorted((b, e) for b, e, _ in spans)
    begins, reach = [b for b, _ in taken], list(accumulate((e for _, e in taken), max))
    terms = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    free = []
    for b, e in terms:
        i = bisect_left(begins, e) - 1  # spans that begin before e
        free.append(i < 0 or reach[i] <= b)
    first, last = [b for b, _ in terms], [e for _, e in terms]
    out = []
    for b, e, kind in spans:
        value = f"{kind}:{text[b:e].lower()}"
        before, after = bisect_right(last, b), bisect_left(first, e)
        out += [(*terms[i], text[first[i] : last[i]].lower(), value) for i in [*range(max(0, before - RADIUS), before), *range(after, min(after + RADIUS, len(terms)))] if free[i]]
    return out


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) - (1 << 63)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row: counts by kind, the base spans as written, and the terms near them with hashes and places."""
    near = pa.list_(pa.struct([("value", pa.int64()), ("term", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
    names = ["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base", "near"]
    types = [*[pa.int64()] * 4, pa.string(), near]
    for batch, _, _ in text_chunks(batches):
        rows = []
        for text in _texts(batch):
            base = base_spans(text)
            n = Counter(k for *_, k in base)
            terms = [{"value": _hash(v), "term": _hash(t), "first": b, "last": e} for b, e, t, v in window_terms(text, base)] if base else []
            rows.append((n["email"], n["ip"], n["card"], n["phone"], _listed(base), terms))
        take = [batch.column(batch.schema.get_field_index(c)) for c in names[:2]]
        yield pa.RecordBatch.from_arrays([*take, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every term."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])
    count: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in count], pa.int64()), pa.array(list(count.values()), pa.int64())], schema=schema)
        count.clear()
        return out

    for batch, _, _ in text_chunks(batches):
        for text in _texts(batch):
            count.update(_TERM.findall(text.lower()))
        if len(count) > FLUSH:
            yield flush()
    if count:
        yield flush()


def scanned(docs: DataFrame) -> DataFrame:
    """The base spans and near terms of every row (doc_id, key, text), stored without the texts."""
    fields = "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<value: long, term: long, first: int, last: int>>"
    return stored(docs.select("doc_id", "key", "text").mapInArrow(_scan, fields))


def risky_terms(docs: DataFrame, scans: DataFrame) -> DataFrame:
    """key, terms: of each text the hashes of the terms that disclose one of its values, as structs (term, removed)."""
    # Every copy of a text has the same key and counts once.
    once = stored(scans.where(F.size("near") > 0).select("key", F.inline("near")).distinct())
    pairs = once.groupBy("term", "value").agg(F.count("*").alias("both"))
    # One row of each text is counted; only texts that occur more than once are shuffled, reduced within a partition first.
    copied = stored(scans.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    texts, small = docs.select("doc_id", "key", "text"), copied.count() <= BROADCAST_ROWS
    single, several = (joined(texts, copied, ["key"], how, F.col("doc_id"), small) for how in ("left_anti", "left_semi"))
    one = single.select("text").union(several.dropDuplicates(["key"]).select("text"))
    total = stored(one.mapInArrow(_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
    words = total.agg(F.sum("n")).first()[0] or 0
    around = once.groupBy("value").agg(F.count("*").alias("around"))
    odds = pairs.join(total, "term").join(around, "value")
    p = F.least(F.col("around") / F.lit(float(max(words, 1))), F.lit(0.5))
    strength = 1 + F.log2(F.col("both") / F.greatest("both", F.col("n") + SHRINK)) / -F.log2(p)
    risky = stored(odds.withColumn("strength", strength).where(F.col("strength") >= GENERALISE).select("term", "value", "strength"))
    held = once.select("key", "value", "term").distinct()
    hits = joined(held, risky, ["term", "value"], "inner", F.col("key"), risky.count() <= BROADCAST_ROWS)
    hits = hits.groupBy("key", "term").agg(F.max("strength").alias("strength"))
    return stored(hits.groupBy("key").agg(F.collect_list(F.struct("term", (F.col("strength") >= REMOVE).alias("removed"))).alias("terms")))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the texts hold their disclosing terms, outside base spans."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("removed", pa.bool_())]))
    for batch, _, _ in text_chunks(batches):
        out = []
        for text, terms in zip(_texts(batch), batch.column(batch.schema.get_field_index("terms")).to_pylist(), strict=True):
            removed = {t["term"]: t["removed"] for t in terms}
            taken = sorted((b, e) for b, e, _ in base_spans(text))
            begins, reach = [b for b, _ in taken], list(accumulate((e for _, e in taken), max))
            known: dict[str, int] = {}
            here = []
            for m in _TERM.finditer(text):
                word = m[0].lower()
                h = known.get(word)
                if h is None:
                    h = known[word] = _hash(word)
                if h in removed and ((i := bisect_left(begins, m.end()) - 1) < 0 or reach[i] <= m.start()):
                    here.append({"first": m.start(), "last": m.end(), "removed": removed[h]})
            out.append(here)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(out, kind)], names=["key", "places"])


def disclosing(docs: DataFrame, scans: DataFrame) -> tuple[DataFrame, bool]:
    """key, places: of each text that has some the places of terms to treat, as structs (first, last, removed); whether these are few."""
    terms = risky_terms(docs, scans)
    size = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    few = joined(docs.select("doc_id", "key", "text"), terms, ["key"], "inner", F.col("doc_id"), size <= BROADCAST_ROWS).dropDuplicates(["key"])
    places = stored(few.select("key", "text", "terms").mapInArrow(_place, "key long, places array<struct<first: int, last: int, removed: boolean>>"))
    return places, places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= BROADCAST_ROWS


def _listed(spans: list) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k in spans)


def _ordered(base: list, places: list[dict] | None) -> list:
    return sorted([*base, *((p["first"], p["last"], "term") for p in places or [])], key=lambda s: (s[0], KINDS.index(s[2])))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    same = ["doc_id", "n_email", "n_ip", "n_card", "n_phone"]
    for batch in batches:
        sha, spans = [], []
        for base, places in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("base", "places")), strict=True):
            sha.append(hashlib.sha256(base.encode()).hexdigest())
            if places:
                parts = [x.split(":") for x in base.split(",") if x]
                base = _listed(_ordered([(int(b), int(e), k) for k, b, e in parts], places))
            spans.append(base)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in same), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=[*same, "base_sha256", "spans"])


def _mask(text_at: int):
    """Of batches whose last column holds the places: the columns before it, with the text sanitised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_chunks(batches, text_at):
            out = []
            for text, places in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                spans = None if text is None else _ordered(base_spans(text), places)
                out.append(masked(text, spans, {(p["first"], p["last"]): p["removed"] for p in places or []}) if spans else text)
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def masked(text: str, spans: list, removed: dict) -> str:
    """The text with values replaced by their kind, disclosing terms generalised to [TERM] or removed; overlapping spans merge."""
    out, at = [], 0
    merged: list[list] = []
    for b, e, k in spans:
        if merged and b < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([b, e, k])
    for b, e, k in merged:
        out += [text[at:b], "" if k == "term" and removed.get((b, e)) else f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _keyed(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of docs (doc_id, text)."""
    docs = _keyed(docs)
    scans = scanned(docs)
    places, small = disclosing(docs, scans)
    found = joined(scans.drop("near"), places, ["key"], "left", F.col("doc_id"), small)
    return found.mapInArrow(_report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with values replaced by [KIND], disclosing terms by [TERM] or nothing; all columns stay, n_chars (if there) is set anew."""
    names = docs.columns
    keyed = _keyed(docs)
    places, small = disclosing(keyed, scanned(keyed))
    text_at = names.index("text")
    rows = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    fields = T.StructType(rows.schema.fields)
    rows = joined(rows.withColumn("key", F.xxhash64(f"c{text_at}")), places, ["key"], "left", F.col(f"c{names.index('doc_id')}"), small).select(*fields.names, "places")
    out = rows.mapInArrow(_mask(text_at), fields)
    if "n_chars" in names:
        out = out.withColumn(f"c{names.index('n_chars')}", F.length(f"c{text_at}").cast("long"))
    return out.toDF(*names)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
