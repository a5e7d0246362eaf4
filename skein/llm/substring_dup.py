"""Substring dedup: passages that repeat across documents, by compact windows over Cartesian trees.

The tokens of a document are its word shingles (SHINGLE words, 64-bit hashes). Under a hash function, the Cartesian tree of the
tokens' values groups all subsequences of at least MIN_WORDS words by the place of their least value: each group is a compact window
(begin, centre, end), and there are about 2n / MIN_WORDS of them. Functions are used in PAIRS: intersecting the windows of two functions
(joining their intervals, again from the top of both trees) gives windows whose subsequences share both least tokens, so a key, the
two least values, says that two subsequences agree under both functions. An exactly repeated passage has equal keys under every pair; one
of similarity 0.8 agrees under at least one of the pairs with probability 0.95, one of 0.9 with 0.99.

Of texts that are equal byte by byte only the smallest doc_id goes through all this; the others are its members, linked to it by their
whole text. What they share with other texts is in its links.

A key's documents are linked as a star to the smallest doc_id (keys are dealt in packs to parts of PART_BYTES of text and sorted there,
so hot keys make no pairs); each (centre, document) pair is verified on the whole token sequences: runs of shared tokens along a diagonal,
of at least MIN_WORDS words and similarity MIN_PERCENT.

Exact passages are found whole: every run of MIN_WORDS words has one key under the first pair, so all its documents share that key.
Those runs of a document that its key's centre hasn't are linked by the run itself (stars to the smallest doc_id that has it); every
document of an exact passage is linked in this way, whatever else its key's documents hold.

Near passages: a key's members come in groups. A member whose places of the key all lie in confirmed passages is in the group of its class (the
smallest document among its links and itself: equal ones are linked through it), anybody else in one of their own. Members of one group aren't
compared: they are in one class already, and where they have the key is known to be repeated. What a near passage between them has
beyond their confirmed passages isn't reported. Keys end when one group is left. Of SMALL members all pairs of different groups are verified.
Larger keys are split: their members come together by what else they share, one for each equal surrounding (those share an exact passage, by
which they are linked already, if it is long enough for any). Two members with a passage there share at least NEED places within REACH
of the key's, at most GAP apart over MIN_WORDS words, so members without such places that other groups share are done, and of the others' tokens
only the rarest matter (a prefix filter). Members' surroundings are gathered by key; of keys with over GATHERED members they are joined by token.
Such a token that at least two members have and at most half of them makes a key of its own; what most of them have is decided by one
more centre, the member with most of those tokens. Split keys go on in the same way; their members at least halve, so rounds end.

Defined results: null, empty and shorter texts have no passages; passages inside one document aren't reported; rows that
share a doc_id are versions of one document and aren't compared with each other; null ids take no part; repeated rows count once;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._common import bounded_batches, components, discard, joined, mix, ngram_hashes, release, stored, text_chunks, word_hashes

SHINGLE, MIN_WORDS, MIN_PERCENT, PAIRS = 5, 50, 80, 3
#: Shared tokens this far apart still belong to one run (one substituted word breaks SHINGLE tokens).
GAP = 2 * SHINGLE
#: How far from its place the tokens are taken by which a key is split.
REACH = MIN_WORDS - SHINGLE + GAP
#: Members up to which all pairs of a key's groups are verified instead of splitting it.
SMALL = 50
#: Members up to which a large key's surroundings are looked through in one place; beyond, by joins.
GATHERED = 20_000
#: Places around a key that two members with a passage there share at least: somewhat under MIN_PERCENT of MIN_WORDS words' tokens.
NEED = 32
#: Places are kept in the low 24 bits of the values, scattered so that equal tokens are cut in random order and trees stay flat.
PLACE_BITS = 24
SCATTER = 0x9E3779
GATHER = pow(SCATTER, -1, 1 << PLACE_BITS)
BROADCAST_IDS = 500_000
#: Keys of a pack for all parts; bytes of text whose keys (of about the same size) make one part.
PACKED, PART_BYTES = 1 << 20, 16 << 20


def _least(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Sparse table of range minima; values hold their place in the low bits."""
    table = [values]
    step = 1
    while 2 * step <= longest:
        last = table[-1]
        table.append(np.minimum(last[:-step], last[step:]) if len(last) > step else last)
        step *= 2
    return table


def _query(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least value of each [lo, hi)."""
    out = np.empty(len(lo), np.uint64)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << int(k))])
    return out


def windows(tokens: np.ndarray, heads: np.ndarray, least: int, pair: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and place in the row (of the first function's least token) of the joint compact windows, at least `least` tokens wide, of the pair's two hash functions."""
    return _windows(tokens, heads, least, pair)[:3]


def _windows(tokens: np.ndarray, heads: np.ndarray, least: int, pair: int) -> tuple[np.ndarray, ...]:
    """windows, and how far before the place those runs of `least` tokens that have the key begin, and how many there are."""
    lens = np.diff(heads)
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = (np.arange(len(tokens), dtype=np.uint64) * np.uint64(SCATTER)) & low
    values = [(mix(tokens ^ mix(np.array([2 * pair + f + 1], np.uint64))) & ~low) | place for f in range(2)]
    tables = [_least(v, int(lens.max())) for v in values]
    row = np.flatnonzero(lens >= least)
    lo, hi = heads[:-1][row], heads[1:][row]
    rows, keys, places, befores, counts = [], [], [], [], []
    while len(row):
        v = [_query(t, lo, hi) for t in tables]
        rows.append(row)
        keys.append(mix((v[0] & ~low) + mix((v[1] & ~low) + np.uint64(pair))))
        c = [(((x & low) * np.uint64(GATHER)) & low).astype(np.int64) for x in v]
        places.append(c[0] - heads[row])
        first, last = np.minimum(*c), np.maximum(*c)
        start = np.maximum(lo, last - least + 1)
        befores.append(c[0] - start)
        counts.append(np.maximum(np.minimum(first, hi - least) - start + 1, 0))
        # Subsequences without both centres end before the later one or begin after the earlier one.
        row, lo, hi = np.concatenate([row, row]), np.concatenate([lo, first + 1]), np.concatenate([last, hi])
        on = hi - lo >= least
        row, lo, hi = row[on], lo[on], hi[on]
        if len(row):
            _, at = np.unique((lo.astype(np.uint64) << np.uint64(32)) | hi.astype(np.uint64), return_index=True)
            row, lo, hi = row[at], lo[at], hi[at]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in (rows, keys, places, befores, counts)) if rows else (none, none.view(np.uint64), none, none, none)


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, at = word_hashes(data, off)
    return ngram_hashes(words, at, SHINGLE)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, doc_ids and `at`, by key, of a few rows at a time. `at` holds the place, and for the first pair of functions also which exact runs have the key: 6 bits each for
    how far before the place the first begins (under 2 ** 6, as runs hold the place) and for their number."""
    for batch, data, off in text_chunks(batches):
        tokens, heads = _tokens(data, off)
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
        least = MIN_WORDS - SHINGLE + 1
        # Places take 24 bits: longer rows than that (over 100 MB of text) are cut into overlapping parts of that size.
        if len(tokens) >= 1 << 24:
            cut = range(0, len(tokens), (1 << 24) - least - 1)
            parts = [(tokens[b : b + (1 << 24) - 1], np.array([0, min(len(tokens) - b, (1 << 24) - 1)]), ids, b) for b in cut]
        else:
            parts = [(tokens, heads, ids, 0)]
        for part, ends, own, begin in parts:
            got = [_windows(part, ends, least, p) for p in range(PAIRS)] if len(part) else []
            if got:
                for _, _, _, before, count in got[1:]:
                    before[:], count[:] = 0, 0
                row, key, place, before, count = (np.concatenate(x) for x in zip(*got, strict=True))
                at = (place + begin) << 12 | np.where(count > 0, before, 0) << 6 | count
                order = np.argsort(key)
                row, key, at = row[order], key[order], at[order]
                # Repeated rows do no harm: most are left out.
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])
                yield key[new], own[row[new]], at[new]


def _packed_keys(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys in packs, dealt to `parts` parts of about equal size by their hash: the shuffle has a row for PACKED keys of all parts, not one a key."""

    def packs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, doc, at = key[order], doc[order], at[order]
        # Equal steps of the unsigned keys.
        part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        ends = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(ends))
        columns = [pa.array([x[ends[k] : ends[k + 1]].tobytes() for k in some.tolist()], pa.binary()) for x in (key, doc, at)]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *columns], names=["part", "key", "doc_id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in _keys(batches):
            held.append(x)
            n += len(x[0])
            if n >= PACKED:
                yield packs(held)
                held, n = [], 0
        if n:
            yield packs(held)

    return run


def _by_key(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows, cut between keys; the batches are sorted by key, their first column."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows and batch.num_rows and batch.column(0)[0].as_py() != batch.column(0)[-1].as_py():
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, n = [batch.slice(cut)], batch.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's packs of keys those keys that several documents have: their documents but the smallest, a. many: there are three at least."""
    held: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for to, column, kind in zip(held, batch.columns[1:], (np.uint64, np.int64, np.int64), strict=True):
            to += [np.frombuffer(x.as_buffer(), kind).copy() for x in column]
    if not held[0]:
        return
    key, doc, at = (np.concatenate(x) for x in held)
    held.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    # Nearly all keys are of one place.
    same = key[1:] == key[:-1]
    on = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if len(on):
        key, doc, at = key[on], doc[order[on]], at[order[on]]
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
        key, doc, at = key[new], doc[new], at[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        a, z = np.repeat(np.minimum.reduceat(doc, first), size), np.repeat(np.maximum.reduceat(doc, first), size)
        second = np.repeat(np.minimum.reduceat(np.where(doc == a, z, doc), first), size)
        on = np.flatnonzero(doc != a)
        for k in range(0, len(on), 100_000):
            x = on[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[x].view(np.int64)), *(pa.array(c) for c in (a[x], doc[x], at[x], (second < z)[x]))], names=["key", "a", "b", "at", "many"])
    release()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, off in text_chunks(batches):
        tokens, heads = _tokens(data, off)
        raw = (tokens >> np.uint64(32)).astype(np.uint32).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([raw[4 * i : 4 * j] for i, j in zip(heads[:-1], heads[1:], strict=True)], pa.binary())], names=["id", "items"])


def _spans(tokens: np.ndarray) -> np.ndarray:
    """A hash of every run of MIN_WORDS words: of 32 tokens by doubling, then of two such that overlap."""
    width = MIN_WORDS - SHINGLE + 1
    if len(tokens) < width:
        return np.zeros(0, np.uint64)
    h, k = mix(tokens.astype(np.uint64) + np.uint64(1)), 1
    while 2 * k <= width:
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:]
        k *= 2
    return mix(mix(h[: len(h) - (width - k)]) + h[width - k :]) if width > k else mix(h)


def _exact(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """The runs of at least MIN_WORDS words of b that a has word by word, wherever."""
    x, y = _spans(a), _spans(b)
    if not len(x) or not len(y):
        return []
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    at = np.minimum(np.searchsorted(ranked, y), len(x) - 1)
    runs: list[list[int]] = []
    for i, j in zip(np.flatnonzero(ranked[at] == y).tolist(), order[at][ranked[at] == y].tolist(), strict=True):
        if runs and runs[-1][1] == i - 1 and (t := runs[-1][2] + i - runs[-1][0]) < len(x) and x[t] == y[i]:
            runs[-1][1] = i
        else:
            runs.append([i, i, j])
    return [(i, e + MIN_WORDS, t, t + e - i + MIN_WORDS, 1.0) for i, e, t in runs]


def _aligned(a: np.ndarray, b: np.ndarray, idx: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages of the shared tokens at idx in b, each with one place in a."""
    out = []

    def split(i: int, j: int, gap: int) -> list[tuple[int, int]]:
        cut = np.flatnonzero((np.diff(idx[i:j]) > gap) | (np.abs(np.diff(pos[i:j] - idx[i:j])) > gap)) + 1 + i
        return list(zip([i, *cut], [*cut, j], strict=True))

    todo = [(i, j, GAP) for i, j in split(0, len(idx), GAP)]
    while todo:
        i, j, gap = todo.pop()
        lo, hi, x, y = int(idx[i]), int(idx[j - 1]) + 1, int(pos[i:j].min()), int(pos[i:j].max()) + 1
        if hi - lo + SHINGLE - 1 < MIN_WORDS or y - x + SHINGLE - 1 < MIN_WORDS:
            continue
        p, q = np.unique(a[x:y]), np.unique(b[lo:hi])
        both = len(np.intersect1d(p, q, assume_unique=True))
        ratio = both / (len(p) + len(q) - both)
        if 100 * ratio >= MIN_PERCENT:
            out.append((lo, hi + SHINGLE - 1, x, y + SHINGLE - 1, ratio))
        elif gap > 1:
            todo += [(*s, gap // 2) for s in split(i, j, gap // 2)]
    return out


def _ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a's tokens, the tokens in this order and which of them a has several times."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    several = np.zeros(len(a) + 1, bool)
    several[1:-1] = ranked[1:] == ranked[:-1]
    return order, ranked, several[:-1] | several[1:]


def passages(a: np.ndarray, b: np.ndarray, of_a: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, float]]:
    """(first word, end word in b, the same in a, similarity) of the passages of b that a has too.

    Where a has a token several times, its place follows the diagonal of the token before and, in a second alignment, that of the
    token after; exact runs are looked up whole. Of passages within another in b only the longest is given. of_a: _ranked(a), if it is known."""
    order, ranked, several = of_a or _ranked(a)
    at = np.minimum(np.searchsorted(ranked, b), len(a) - 1)
    idx = np.flatnonzero(ranked[at] == b)
    if len(idx) < 2:
        return []
    # No passage where shared tokens at most GAP apart don't reach over MIN_WORDS words anywhere.
    cut = np.flatnonzero(idx[1:] - idx[:-1] > GAP)
    ends = np.append(cut, len(idx) - 1)
    if (idx[ends] - idx[np.concatenate([[0], cut + 1])]).max() + SHINGLE < MIN_WORDS:
        return []
    pos = order[at[idx]]
    several = several[at[idx]]
    for k in (np.flatnonzero(several[1:]) + 1).tolist():
        want = pos[k - 1] + idx[k] - idx[k - 1]
        if pos[k] != want and want < len(a) and a[want] == b[idx[k]]:
            pos[k] = want
    out = _aligned(a, b, idx, pos)
    if several.any():
        back = pos.copy()
        for k in np.flatnonzero(several[:-1])[::-1].tolist():
            want = back[k + 1] - (idx[k + 1] - idx[k])
            if back[k] != want and want >= 0 and a[want] == b[idx[k]]:
                back[k] = want
        if (back != pos).any():
            out += _aligned(a, b, idx, back)
        out += _exact(a, b)
    kept: list[tuple[int, int, int, int, float]] = []
    for p in sorted(out, key=lambda p: (p[0], -p[1], -p[4], p[2])):
        if not kept or p[1] > kept[-1][1]:
            kept.append(p)
    return kept


def _missing(spans_of_a: np.ndarray, b: np.ndarray, ats: list[int]) -> np.ndarray:
    """Hashes of the exact runs that `ats` name in b and that a has nowhere; a's are sorted."""
    at = np.array(ats, np.int64)
    count = at & 63
    begin = np.repeat((at >> 12) - (at >> 6 & 63), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    runs = _spans(b)
    runs = np.unique(runs[begin[begin < len(runs)]])
    if len(spans_of_a):
        runs = runs[spans_of_a[np.minimum(np.searchsorted(spans_of_a, runs), len(spans_of_a) - 1)] != runs]
    return runs.view(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of each pair, and the exact runs of b under the pair's keys that a doesn't have."""
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("other_first", pa.int64()), ("other_end", pa.int64()), ("similarity", pa.float64())]))
    names = [f.name for f in span.value_type]
    last, of_last, runs = None, None, None
    for batch in batches:
        found, missing = [], []
        for x, y, ats in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
            x, y = x.as_buffer().to_pybytes(), np.frombuffer(y.as_buffer(), np.uint32)
            # Rows come by a, if a join has sorted them.
            if x != last:
                last, of_last, runs = x, _ranked(np.frombuffer(x, np.uint32)), None
            x = np.frombuffer(x, np.uint32)
            found.append([dict(zip(names, p, strict=True)) for p in passages(x, y, of_last)])
            if ats and runs is None:
                runs = np.sort(_spans(x))
            missing.append(_missing(runs, y, ats) if ats else None)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, span), pa.array(missing, pa.list_(pa.int64()))], names=["a", "b", "passages", "missing"])
        yield out.filter(pa.array([bool(f) or (m is not None and len(m) > 0) for f, m in zip(found, missing, strict=True)], pa.bool_()))


_CONTEXT = "key long, b long, g long, members long, same long, places array<long>, at array<int>, tokens array<int>"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens within REACH of the keys' places, where they are, and a hash of them."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("key", pa.int64()), ("b", pa.int64()), ("g", pa.int64()), ("members", pa.int64()), ("same", pa.int64()), ("places", pa.list_(pa.int64())), ("at", ints), ("tokens", ints)])
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        for b, keys, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            tokens = np.frombuffer(items.as_buffer(), np.int32)
            for k in keys:
                places = sorted(k["places"])
                parts = [(max(0, p - REACH), min(p + REACH + 1, len(tokens))) for p in places]
                at = np.unique(np.concatenate([np.arange(*x, dtype=np.int32) for x in parts])) if len(parts) > 1 else np.arange(*parts[0], dtype=np.int32)
                same = int.from_bytes(hashlib.blake2b(b"".join(tokens[i:j].tobytes() + b"." for i, j in parts), digest_size=8).digest(), "little", signed=True)
                for column, value in zip(out, (k["key"], b, k["g"], k["members"], same, places, at, tokens[at]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def _alive(member: np.ndarray, at: np.ndarray, token: np.ndarray, centre: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a key's members may have a passage at its place with a member of another group, and which of their tokens are in both.

    Those tokens, at most GAP apart, reach over MIN_WORDS words around a place (see _aligned), and they are NEED at least."""
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
    g = group[member[order]]
    mixed = np.minimum.reduceat(g, first) < np.maximum.reduceat(g, first)
    both = np.empty(len(token), bool)
    both[order] = np.repeat(mixed, np.diff(np.append(first, len(token))))
    on = np.flatnonzero(both)
    alive = np.zeros(len(group), bool)
    if len(on):
        m, p = member[on], at[on]
        begin = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (p[1:] - p[:-1] > GAP)]))
        end = np.append(begin[1:], len(on)) - 1
        wide = (p[end] - p[begin] + SHINGLE >= MIN_WORDS) & np.maximum.reduceat(centre[on], begin)
        alive[m[begin[wide]]] = True
        alive &= np.bincount(m, minlength=len(group)) >= NEED
    return alive, both


def _stars(member: np.ndarray, token: np.ndarray, b: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """A key's members as stars: the token (its rank), centre, member and whether the star ends there, by the tokens that remain of each member
    when its most frequent NEED - 1 places are left out."""
    n = len(b)
    _, code = np.unique(token, return_inverse=True)
    own, times = np.unique(member * (code.max() + 1) + code, return_counts=True)
    member, code = np.divmod(own, code.max() + 1)
    df = np.bincount(code)
    order = np.lexsort((-code, -df[code], member))
    member, code, times = member[order], code[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
    total = np.cumsum(times)
    total -= np.repeat(total[first] - times[first], np.diff(np.append(first, len(member))))
    on = total >= NEED
    member, code = member[on], code[on]
    # Tokens that at most half of the members have: a star each to the least of these, once for tokens of the same members.
    order = np.lexsort((b[member], code))
    order = order[2 * df[code[order]] <= n]
    m, c = member[order], code[order]
    none = np.zeros(0, np.int64)
    parts = []
    if len(m):
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        held = np.diff(np.append(first, len(c)))
        who = np.bitwise_xor.reduceat(mix(b[m].view(np.uint64)), first)
        fit = (held > 1) & (np.minimum.reduceat(group[m], first) < np.maximum.reduceat(group[m], first))
        _, once = np.unique(np.where(fit, who, np.uint64(0)), return_index=True)
        fit &= np.isin(np.arange(len(fit)), once)
        star = np.repeat(fit, held)
        star[first] = False
        parts.append((c[star], np.repeat(m[first], held)[star], m[star], np.zeros(star.sum(), bool)))
    # What most have: one centre, the member with most of those tokens.
    votes = np.bincount(member[2 * df[code] > n], minlength=n)
    best = np.lexsort((b, -votes))[0]
    m = np.flatnonzero((votes > 0) & (group != group[best]))
    parts.append((np.zeros(len(m), np.int64), np.full(len(m), best), m, np.ones(len(m), bool)))
    return tuple(np.concatenate(x) if x else none for x in zip(*parts, strict=True))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of keys, sorted by key, that may have passages at its place, as stars (see _split); of up to SMALL members all pairs."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("ga", pa.int64()), ("b", pa.int64()), ("g", pa.int64()), ("places", pa.list_(pa.int64())), ("last", pa.bool_())])
    for table in _by_key(batches, 1000):
        key, b, g, same = (table.column(k).to_numpy() for k in ("key", "b", "g", "same"))
        places, ats, tokens = (table.column(k).combine_chunks() for k in ("places", "at", "tokens"))
        heads, place_heads = ats.offsets.to_numpy(), places.offsets.to_numpy()
        all_at, all_tokens, all_places = ats.values.to_numpy(), tokens.values.to_numpy(), places.values.to_numpy()
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            # Of equal surroundings the least member.
            order = np.lexsort((b[i:j], same[i:j])) + i
            rows = order[np.concatenate([[True], same[order][1:] != same[order][:-1]])]
            while len(rows) > 1 and (group := g[rows]).min() < group.max():
                size = heads[rows + 1] - heads[rows]
                member = np.repeat(np.arange(len(rows)), size)
                src = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(heads[rows], size)
                at, token = all_at[src].astype(np.int64), all_tokens[src]
                held = place_heads[rows + 1] - place_heads[rows]
                where = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(place_heads[rows], held)
                centre = np.isin(member << 32 | at, np.repeat(np.arange(len(rows)), held) << 32 | all_places[where])
                alive, both = _alive(member, at, token, centre, group)
                if not alive.all():
                    rows = rows[alive]
                    continue
                if len(rows) <= SMALL:
                    p, q = np.triu_indices(len(rows), 1)
                    on = group[p] != group[q]
                    p, q = rows[p[on]], rows[q[on]]
                    p, q = np.where(b[p] < b[q], p, q), np.where(b[p] < b[q], q, p)
                    n = len(p)
                    columns = [key[p], b[p], g[p], b[q], g[q], places.take(pa.array(q)), np.ones(n, bool)]
                else:
                    names, (k, c, r, last) = np.unique(token), _stars(member[both], token[both], b[rows], group)
                    k = np.where(last, key[i], mix(key[i : i + 1].view(np.uint64) ^ mix(names[k].astype(np.uint64))).view(np.int64))
                    c, r = rows[c], rows[r]
                    columns = [k, b[c], g[c], b[r], g[r], places.take(pa.array(r)), last]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
                break


def _dealt(whole: DataFrame) -> DataFrame:
    """What _gathered gives for larger keys, by joins that don't bring a key's members together; by the number of shared tokens only."""
    least = whole.groupBy("key", "same").agg(F.min("b").alias("b"))
    around = whole.join(least, ["key", "same", "b"]).select("key", "b", "places", "g", F.explode(F.col("tokens").cast("array<long>")).alias("token"))
    around = stored(around.groupBy("key", "b", "places", "g", "token").agg(F.count("*").alias("times")))
    df = around.groupBy("key", "token").agg(F.count("*").alias("df")).where("df > 1")
    met = around.join(df, ["key", "token"])
    alive = met.groupBy("key", "b").agg(F.sum("times").alias("s")).where(F.col("s") >= NEED).select("key", "b")
    gone, around = around, stored(met.join(alive, ["key", "b"]).select("key", "b", "places", "g", "token", "times", "df"))
    discard(gone)
    size = around.groupBy("key").agg(F.count_distinct("b").alias("n"))
    later = Window.partitionBy("key", "b").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = around.withColumn("left", F.sum("times").over(later)).where(F.col("left") >= NEED).drop("left", "times")
    gone, prefix = around, stored(joined(prefix, size, ["key"], "inner", F.col("b"), around.count() <= BROADCAST_IDS, like=around))
    discard(gone)
    centre = F.min(F.struct(F.col("b").alias("a"), F.col("g").alias("ga"))).alias("x")
    # Tokens that the same members share make one key; so do members of one group none.
    minor = prefix.where("2 * df <= n")
    shared = minor.groupBy("key", "token").agg(F.count("*").alias("held"), centre, F.bit_xor(F.xxhash64("b")).alias("who"), F.min("g").alias("g"), F.max("g").alias("h")).where("held > 1 and g < h")
    one = shared.groupBy("key", "held", "who").agg(F.min(F.struct("token", "x")).alias("y")).select("key", "y.token", "y.x.*")
    some = minor.join(one, ["key", "token"]).select(F.xxhash64("key", "token").alias("key"), "a", "ga", "b", "g", "places", F.lit(False).alias("last"))
    votes = stored(prefix.where("2 * df > n").groupBy("key", "b", "places").agg(F.count("*").alias("v"), F.min("g").alias("g")))
    best = votes.groupBy("key").agg(F.max(F.struct("v", (-F.col("b")).alias("a"), F.col("g").alias("ga"))).alias("x")).select("key", (-F.col("x.a")).alias("a"), "x.ga")
    most = joined(votes, best, ["key"], "inner", F.col("b"), votes.count() <= BROADCAST_IDS).where("g <> ga").select("key", "a", "ga", "b", "g", "places", F.lit(True).alias("last"))
    return some.union(most).where("a <> b")


def _split(large: DataFrame, sequences: DataFrame) -> DataFrame:
    """key, a, b, at, g, ga, last: the members (key, b, places, g, members) of keys as stars of what else they share.

    Two members with a passage at the key's place share at least NEED places around it. A member with fewer that it shares with anybody has
    none; of the others, each pair shares a token among those that remain when the most frequent NEED - 1 places are left out."""
    own = large.groupBy("b").agg(F.collect_list(F.struct("key", "places", "g", "members")).alias("keys"))
    asked = stored(large.select("b").distinct())
    whole = own.join(_among(sequences, "id", asked, "b").select(F.col("id").alias("b"), "items"), "b").select("b", "keys", "items").mapInArrow(_contexts, _CONTEXT)
    hot = large.where(F.col("members") > GATHERED)
    many = not hot.isEmpty()
    whole = stored(whole) if many else whole
    few = whole.where(F.col("members") <= GATHERED).repartition("key").sortWithinPartitions("key")
    stars = few.mapInArrow(_gathered, "key long, a long, ga long, b long, g long, places array<long>, last boolean")
    if many:
        stars = stars.union(_dealt(whole.where(F.col("members") > GATHERED)))
    return stars.select("key", "a", "b", F.explode(F.transform("places", lambda p: F.shiftleft(p, 12))).alias("at"), "g", "ga", "last")


def _among(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """The rows of df whose column is in ids: by broadcast up to BROADCAST_IDS ids (8 bytes each), by a shuffle beyond."""
    ids = ids.select(F.col(name).alias(column))
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Meanwhile an action's shuffle files are deleted when it ends, not whenever the driver happens to collect its garbage: what is needed later is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """docs without the texts that a smaller doc_id has too, byte by byte; a, b, n: those copies b of a, with their number of words; the bytes of docs.

    Texts too short for MIN_WORDS words have no passages, and stay."""
    docs = docs.where(F.octet_length("text") >= 2 * MIN_WORDS - 1).withColumn("row", F.xxhash64("doc_id", "text"))
    hashed = stored(docs.select("doc_id", "row", F.xxhash64("text").alias("same"), F.octet_length("text").alias("bytes")).distinct())
    size = hashed.agg(F.sum("bytes")).first()[0] or 0
    twice = hashed.groupBy("same").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("same")
    likely = stored(joined(hashed, twice, ["same"], "inner", F.col("doc_id"), False).select("row"))
    discard(hashed)
    # Equal hashes only make candidates; the texts are counted and told apart there alone.
    texts = docs.join(F.broadcast(likely) if likely.count() <= BROADCAST_IDS else likely, "row", "left_semi")
    texts = texts.select("doc_id", "row", F.sha2("text", 256).alias("same"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    texts = stored(texts.distinct())
    heads = texts.groupBy("same").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("same", "a")
    copies = stored(joined(texts, heads, ["same"], "inner", F.col("doc_id"), False).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), "n", "row"))
    discard(likely, texts)
    rows = copies.select("row")
    once = docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, "row", "left_anti").select("doc_id", "text")
    return once, copies.where(F.col("n") >= MIN_WORDS).select("a", "b", "n"), size


def _merged(spans: Column) -> Column:
    """Spans (first, end), in order, those that overlap or touch as one."""
    none = F.array().cast("array<struct<first: bigint, end: bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joint = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["first"] <= last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joint))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.sort_array(spans), none, add)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, other_id, passages: documents with passages of at least MIN_WORDS words that other_id has too.

    other_id is the centre of a star: every document of a repeated passage is linked to it. Of equal texts the smallest doc_id stands for all:
    the others are linked to it by their whole text and to nothing else, as it has their links."""
    with _shuffles_deleted(docs.sparkSession):
        return _repeated_passages(docs)


def _repeated_passages(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    docs, copies, size = _copies(docs)
    parts = max(8, -(-size // PART_BYTES))
    keys = docs.mapInArrow(_packed_keys(parts), "part int, key binary, doc_id binary, at binary").repartitionById(parts, "part")
    rows = keys.mapInArrow(_shared, "key long, a long, b long, at long, many boolean")
    rows = stored(rows.withColumns({"g": F.col("b"), "ga": F.col("a"), "last": F.lit(False)}))
    ids = stored(rows.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sequences = stored(_among(docs, "doc_id", ids, "doc_id").mapInArrow(_sequences, "id long, items binary").where(F.length("items") > 0).distinct())
    span = "array<struct<first_word: long, end_word: long, other_first: long, other_end: long, similarity: double>>"

    def verified(pairs: DataFrame) -> DataFrame:
        asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        some = _among(sequences, "id", asked, "id")
        first = pairs.join(some.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        both = joined(first, some.select(F.col("id").alias("a"), F.col("items").alias("x")), ["a"], "inner", F.col("b"), False, like=pairs).select("a", "b", "x", "y", "ats")
        return stored(both.mapInArrow(_verify, f"a long, b long, passages {span}, missing array<long>"))

    def classes() -> DataFrame:
        """doc_id, g, spans: of each linked document the smallest one among those it is linked to and itself, and where its confirmed passages are."""
        both = [x.select(F.col(c).alias("doc_id"), F.least("a", "b").alias("g"), F.explode("passages").alias("p")).select("doc_id", "g", F.struct(F.col(f"p.{i}").alias("first"), F.col(f"p.{j}").alias("end")).alias("s")) for x in found for c, i, j in (("b", "first_word", "end_word"), ("a", "other_first", "other_end"))]
        return stored(functools.reduce(DataFrame.union, both).groupBy("doc_id").agg(F.min("g").alias("g"), _merged(F.collect_set("s")).alias("spans")))

    found, tested, known = [], None, None
    none = F.expr("cast(null as array<long>)").alias("ats")
    while True:
        if tested is None:
            pairs = stored(rows.groupBy("a", "b").agg(F.collect_set(F.when(F.col("many") & (F.col("at").bitwiseAND(63) > 0), F.col("at"))).alias("ats")))
        else:
            pairs = stored(rows.where("g <> ga").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti").withColumn("ats", none))
        if not pairs.isEmpty():
            good = verified(pairs)
            fresh = [good.where(F.size("passages") > 0).drop("missing")]
            if tested is None:
                # Exact runs that a key's documents have and its centre hasn't: stars by the run itself, all confirmed at once.
                runs = stored(good.where(F.size("missing") > 0).select("b", F.explode("missing").alias("run")).distinct())
                heads = runs.groupBy("run").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a < z").select("run", "a")
                more = runs.join(heads, "run").where("a <> b").select("a", "b").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
                more = stored(more.withColumn("ats", none))
                if not more.isEmpty():
                    fresh.append(verified(more).where(F.size("passages") > 0).drop("missing"))
                    pairs = pairs.union(more)
            found += fresh
            tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
            known = None
        elif tested is None:
            break
        if rows.where("not last").isEmpty():
            break
        known = known or classes()
        # A place that a confirmed passage holds is in its document's class, any other one in a class of its own.
        place = F.shiftright("at", 12)
        places = rows.where("many" if "many" in rows.columns else "not last").select("key", "b", place.alias("place"))
        held = F.coalesce(F.exists("spans", lambda p: (p["first"] <= F.col("place")) & (F.col("place") < p["end"])), F.lit(False))
        judged = (places.join(F.broadcast(known), F.col("b") == F.col("doc_id"), "left") if known.count() <= BROADCAST_IDS // 5 else places.join(known, F.col("b") == F.col("doc_id"), "left")).select("key", "b", "place", F.when(held, F.col("g")).alias("g"))
        group = F.when(F.count("g") == F.count("*"), F.min("g")).otherwise(F.xxhash64(F.lit("alone"), "b")).alias("g")
        judged = stored(judged.groupBy("key", "b").agg(F.collect_set("place").alias("places"), group))
        few = judged.count() <= BROADCAST_IDS
        groups = judged.groupBy("key").agg(F.count("*").alias("members"), F.min("g").alias("low"), F.max("g").alias("high")).where("members > 1 and low < high").select("key", "members")
        left = stored(joined(judged, groups, ["key"], "inner", F.col("b"), few))
        small = left.where(F.col("members") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("b", "g")).alias("all"))
        small = small.select("key", "all", F.explode("all").alias("p")).select("key", "p", F.explode("all").alias("q")).where("p.b < q.b and p.g <> q.g")
        small = small.select(F.col("p.b").alias("a"), F.col("q.b").alias("b")).distinct().select(F.xxhash64("a", "b").alias("key"), "a", "b", F.lit(0).cast("long").alias("at"), F.col("b").alias("g"), F.col("a").alias("ga"), F.lit(True).alias("last"))
        large = left.where(F.col("members") > SMALL)
        done = [rows, judged, left]
        rows = stored(small if large.isEmpty() else small.union(_split(large, sequences)))
        discard(*done)
        if rows.isEmpty():
            break
    whole = F.struct(F.lit(0).cast("long").alias("first_word"), F.col("n").alias("end_word"), F.lit(0).cast("long").alias("other_first"), F.col("n").alias("other_end"), F.lit(1.0).alias("similarity"))
    out = copies.select("a", "b", F.array(whole).cast(span).alias("passages"))
    for more in found:
        out = out.unionByName(more)
    return out.select(F.col("b").alias("doc_id"), F.col("a").alias("other_id"), "passages")


def classes_of_passages(docs: DataFrame) -> DataFrame:
    """doc_id, component_id, n_links, n_passages, n_words, passages: a row for each document that has passages in common with another.

    component_id is the smallest doc_id that links reach, n_links the number of documents it is linked to in repeated_passages. Passages
    (first_word, end_word) are those of the document itself, with whichever other document; those that overlap or touch are one."""
    links = stored(repeated_passages(docs))
    spans = [links.select(F.col(c).alias("doc_id"), F.col(o).alias("other_id"), F.explode("passages").alias("p")).select("doc_id", "other_id", F.struct(F.col(f"p.{i}").alias("first"), F.col(f"p.{j}").alias("end")).alias("s")) for c, o, i, j in (("doc_id", "other_id", "first_word", "end_word"), ("other_id", "doc_id", "other_first", "other_end"))]
    # A centre has as many links as documents, but few different spans: counted and collected each by themselves.
    both = stored(spans[0].union(spans[1]))
    count = both.select("doc_id", "other_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_links"))
    own = both.select("doc_id", "s").distinct().groupBy("doc_id").agg(_merged(F.collect_list("s")).alias("spans"))
    group = components(links.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b")), links.count())
    out = own.join(count, "doc_id").join(group.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["first"]).alias("n_words")
    passages = F.transform("spans", lambda p: F.struct(p["first"].alias("first_word"), p["end"].alias("end_word"))).alias("passages")
    return out.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links", F.size("spans").cast("long").alias("n_passages"), words, passages)


def op7_substring_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_substring_dup": op7_substring_dup}
ORACLE_SQL: dict[str, str] = {}
