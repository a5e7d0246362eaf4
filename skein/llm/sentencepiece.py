"""SentencePiece encoding and decoding: sampled segmentations by forward filtering and backward sampling over the piece lattice.

The vocabulary is that of a public model file (a parameter; nothing is trained). A text's lattice has an edge for every piece that
matches at a place; a character without a piece has one edge, its UTF-8 bytes as byte pieces. A segmentation has a probability
proportional to the product of its pieces' weights; weights follow the pieces' rank r by Zipf's law, (r + 10) ** -theta, and a
byte piece weighs as the last rank. Forward filtering sums, for every place, the weights of all paths that reach it; backward
sampling then draws the last piece, the one before it and so on from those sums: an exact sample. theta is the inverse temperature:
small values spread the samples, large ones approach the best path.

No piece of the vocabulary crosses certain places (after a run of letters, before a space); there the lattice factors, so the
filter runs once for a distinct unit between such places and is kept for reuse, while each occurrence draws its own path. The
draws' random numbers are a hash of (row key, place of the unit in the row, step): the same row key and text give the same
segmentation on any cluster, in any partitioning, after any retry.

Spaces are written as the meta symbol U+2581, with one in front of the text, and no other normalisation takes place. A U+2581 of the text
itself is written in byte pieces, so decoding restores every text exactly.

Defined results: null text gives null ids; empty text gives empty ids and decodes to the empty text; a row key of null is a key
like any other; repeated rows give equal rows; lone surrogates can't occur in Spark strings; texts of any length are encoded whole (a
worker holds one text at a time beyond CHUNK, and the lattice of its longest unit); extra columns are kept whatever their
names, but those named as the results (piece_ids, lossless) are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._common import bounded_batches, mix, release, text_chunks

MODEL_FILE = "piece_bpe_32k.model"
#: Distinct units whose filters a worker keeps.
KEPT_UNITS = 25_000
#: The table of pieces and their beginnings is addressed by the bits of a hash above these.
TABLE_SHIFT = 44
NONE, BEGUN = -1, -2
#: Bytes of text that are encoded at once: some tens of bytes a character are held for them.
CHUNK = 1 << 18
META = "▁"
LETTERS = re.compile(r"[^\W\d_²]+")
#: Classes of characters; a unit is a run of spaces with the run of one other class behind it.
SPACE, LETTER, OTHER = 0, 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL_FILE)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _grown(old: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """old with room for new behind its first `used` values, and new put there."""
    if used + len(new) > len(old):
        old = np.concatenate([old[:used], np.empty(max(used, 2 * len(new), 1024), old.dtype)])
    old[used : used + len(new)] = new
    return old


class Pieces:
    """A vocabulary and the filters of the units seen so far.

    A unit's places 1..n are nodes. Node k's incoming edges begin at first[k], the longest first; `share` is their cumulated
    probability, `ids` their pieces (-2 - c: the bytes of the character c), `back` the node each comes from (-1: the unit's start).
    Everything about a unit is computed from that unit alone and in one order, so its shares are the same bit by bit whatever units
    are filtered together. Units are looked up by a 64-bit hash; every batch is decoded and compared, and should two units ever share
    a hash, the batch is encoded again under another one."""

    def __init__(self, pieces: list[str], kinds: list[str], theta: float = 0.6):
        self.theta = theta
        byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32) if len(byte_ids) == 256 else None
        usual = [i for i, k in enumerate(kinds) if k == "piece"]
        vocab = {pieces[i].replace(META, " "): (i, (r + 10.0) ** -theta) for r, i in enumerate(usual)}
        self.byte_weight = (len(usual) + 10.0) ** -theta
        self.classes = np.full(0x110000, OTHER, np.uint8)
        self.classes[0x20] = SPACE
        for m in LETTERS.finditer("".join(map(chr, range(0x110000)))):
            self.classes[m.start() : m.end()] = LETTER
        # The units are sound only if no piece crosses from one to the next.
        held = [code_points(p) for p in vocab if p.strip(" ")]
        ends = np.cumsum([len(x) for x in held])
        if held and len(self.units(np.concatenate(held), np.concatenate([[0], ends[:-1]]))) > len(held):
            self.classes[self.classes == LETTER] = OTHER
        self.longest = max(map(len, vocab), default=1)
        texts = sorted(vocab, key=len)
        self.hash = np.zeros(len(texts), np.uint64)
        begun = [np.zeros(0, np.uint64)]
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size)
        c = code_points("".join(texts)).astype(np.uint64)
        for k in range(self.longest):
            on = size > k
            self.hash[on] = self.hash[on] * _STEP + c[(ends - size)[on] + k] + np.uint64(1)
            begun.append(mix(self.hash[size > k + 1]))
        self.hash = mix(self.hash)
        if len(np.unique(self.hash)) < len(texts):
            raise ValueError("piece hashes collide")
        self.piece = np.array([vocab[t][0] for t in texts], np.int32)
        self.weight = np.array([vocab[t][1] for t in texts])
        # By the top bits of a hash: NONE, BEGUN (only beginnings of pieces) or the place of the last of the pieces, of which chain
        # names the one before.
        self.table = np.full(1 << (64 - TABLE_SHIFT), NONE, np.int32)
        self.table[np.concatenate(begun) >> np.uint64(TABLE_SHIFT)] = BEGUN
        self.chain = np.full(len(texts), NONE, np.int32)
        for i, slot in enumerate((self.hash >> np.uint64(TABLE_SHIFT)).tolist()):
            self.chain[i] = max(self.table[slot], NONE)
            self.table[slot] = i
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else p.replace(META, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.raw_end = np.cumsum([len(r) for r in raw])
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.salt = 0
        self.clear()

    def clear(self) -> None:
        self.known, self.last = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of the units, their last nodes
        self.nodes = self.edges = 0
        self.share, self.ids, self.back, self.first = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def units(self, c: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the units of the code points c begin; rows begin new ones."""
        kind = self.classes[c]
        begins = np.ones(len(c), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        begins[rows[rows < len(c)]] = True
        return np.flatnonzero(begins)

    def add(self, c: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Filters the lattices of the units c[begins:ends] (c holds nothing else), all at once; their last nodes."""
        n_all, size = len(c), ends - begins
        end_of, start = np.repeat(ends, size), np.repeat(begins, size)
        h, place, wide = np.zeros(n_all, np.uint64), np.arange(n_all), c.astype(np.uint64) + np.uint64(1)
        found = []
        lone = np.ones(n_all, bool)
        for n in range(1, self.longest + 1):
            on = np.flatnonzero(place + n <= end_of[place])
            place = place[on]
            h = h[on] * _STEP + wide[place + n - 1]
            x = mix(h)
            at = self.table[x >> np.uint64(TABLE_SHIFT)]
            on = np.flatnonzero(at != NONE)
            place, h, x, at = place[on], h[on], x[on], at[on]
            look = np.flatnonzero(at >= 0)
            while len(look):  # the pieces of a slot, nearly always one
                look = look[self.hash[at[look]] != x[look]]
                at[look] = self.chain[at[look]]
                look = look[at[look] >= 0]
            hit = np.flatnonzero(at >= 0)
            found.append((place[hit], n, self.piece[at[hit]], self.weight[at[hit]]))
            if n == 1:
                lone[place[hit]] = False
            if not len(place):
                break
        lone = np.flatnonzero(lone)
        if len(lone):
            if self.byte_ids is None:
                raise ValueError(f"no piece for {chr(int(c[lone[0]]))!r} and no byte pieces")
            x = c[lone].astype(np.int32)
            found.insert(0, (lone, 1, -2 - x, self.byte_weight ** (1 + (x > 0x7F) + (x > 0x7FF) + (x > 0xFFFF))))
        # Edges by the place they end at, the longest first: each length has at most one there.
        many = np.zeros(n_all, np.int64)
        for b, n, _, _ in found:
            many[b + (n - 1)] += 1
        firsts = np.cumsum(many) - many
        total_edges = int(firsts[-1] + many[-1])
        begin, piece, weight = np.empty(total_edges, np.int32), np.empty(total_edges, np.int32), np.empty(total_edges)
        filled = firsts.copy()
        for b, n, ids, w in reversed(found):
            to = filled[b + (n - 1)]
            begin[to], piece[to], weight[to] = b, ids, w
            filled[b + (n - 1)] += 1
        # Places of a unit are filled in order, all units together. Sums are kept as mantissa and exponent of two, so that long units
        # neither vanish nor overflow.
        by_size = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[by_size], -np.arange(1, int(size.max()) + 1), "right")
        total, power = np.ones(n_all), np.zeros(n_all, np.int32)
        inner = begin > np.repeat(start, many)
        share = np.empty(total_edges)
        for k, count in enumerate(live.tolist()):
            to = begins[by_size[:count]] + k
            n = many[to]
            new = np.cumsum(n) - n
            e = np.arange(new[-1] + n[-1]) + np.repeat(firsts[to] - new, n)
            p = weight[e]
            if k:
                base = power[to - 1]
                b = begin[e] - 1
                some = inner[e]
                p = np.ldexp(p * np.where(some, total[b], 1.0), np.where(some, power[b], 0) - np.repeat(base, n))
            sums = np.add.reduceat(p, new)
            share[e] = p / np.repeat(sums, n)
            mantissa, more = np.frexp(sums)
            total[to], power[to] = mantissa, more + (base if k else 0)
        for k in range(1, int(many.max())):
            at = firsts[many > k] + k
            share[at] += share[at - 1]
        share[firsts + many - 1] = 2.0
        nodes, edges = self.nodes, self.edges
        self.share = _grown(self.share, edges, share)
        self.ids = _grown(self.ids, edges, piece)
        self.back = _grown(self.back, edges, np.where(inner, nodes + begin - 1, -1).astype(np.int32))
        self.first = _grown(self.first, nodes, (edges + firsts).astype(np.int32))
        self.nodes, self.edges = nodes + n_all, edges + total_edges
        return nodes + ends - 1

    def _lasts(self, c: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last nodes of the units, filtering those not seen before."""
        lens = ends - begins
        scale = np.cumprod(np.full(int(lens.max()), _STEP), dtype=np.uint64)
        wide = (c.astype(np.uint64) + np.uint64(self.salt + 1)) * np.uint64(0xD6E8FEB86659FD93)
        wide ^= wide >> np.uint64(29)
        h = mix(np.add.reduceat(wide * scale[np.arange(len(c)) - np.repeat(begins, lens)], begins) + lens.astype(np.uint64))
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        miss = np.flatnonzero(self.known[at] != h) if len(self.known) else np.arange(len(h))
        if len(miss):
            new, one = np.unique(h[miss], return_index=True)
            one = miss[one]
            n = lens[one]
            to = np.cumsum(n)
            part = c[np.arange(to[-1]) + np.repeat(begins[one] - (to - n), n)]
            lasts = self.add(part, to - n, to)
            where = np.searchsorted(self.known, new)
            self.known, self.last = np.insert(self.known, where, new), np.insert(self.last, where, lasts)
            at = np.searchsorted(self.known, h)
        return self.last[at]

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of the texts, their offsets by text, and which texts they restore."""
        for _ in range(3):
            ids, heads, same = self._encode(texts, keys)
            if same.all():
                break
            self.clear()
            self.salt += 1
        return ids, heads, same

    def _encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [" " + t if t else "" for t in texts]
        whole = "".join(own)
        c = code_points(whole)
        if not len(c):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool)
        rows = np.cumsum([0, *map(len, own)])
        begins = self.units(c, rows)
        lasts = self._lasts(c, begins, np.append(begins[1:], len(c)))
        heads = np.searchsorted(begins, rows)
        count = np.diff(heads)
        row = np.repeat(np.arange(len(texts)), count)
        seed = mix(keys.astype(np.uint64)[row] + mix((np.arange(len(begins)) - heads[row]).astype(np.uint64)))
        node, live = lasts, np.arange(len(begins))
        drawn, steps = [], np.zeros(len(begins), np.int64)
        while len(live):
            u = (mix(seed + np.uint64(len(drawn) + 1)) >> np.uint64(11)).astype(np.float64) / 2**53
            edge = self.first[node]
            late = np.flatnonzero(self.share[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.share[edge[late]] <= u[late]]
            drawn.append((live, self.ids[edge]))
            node = self.back[edge]
            on = np.flatnonzero(node >= 0)
            steps[live] += 1
            live, node, seed = live[on], node[on], seed[on]
        ends = np.cumsum(steps)
        piece = np.empty(ends[-1], np.int32)
        for k, (unit, x) in enumerate(drawn):  # the last draw comes first
            piece[ends[unit] - 1 - k] = x
        heads = np.concatenate([[0], ends])[heads]
        rare = np.flatnonzero(piece < 0)
        if len(rare):
            kinds, which = np.unique(piece[rare], return_inverse=True)
            spelled = [chr(-2 - int(x)).encode() for x in kinds]
            width = np.ones(len(piece), np.int64)
            width[rare] = np.array([len(x) for x in spelled])[which]
            to = np.cumsum(width)
            heads = np.concatenate([[0], to])[heads]
            out = np.repeat(piece, width)
            n = width[rare]
            first = np.cumsum([0, *map(len, spelled)])[:-1][which]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[rare] - n, n) + place] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)[np.repeat(first, n) + place]]
            piece = out
        if len(self.known) > KEPT_UNITS or self.edges > 20 * KEPT_UNITS:
            self.clear()
        return piece, heads, self._restores(piece, heads, whole, own)

    def _restores(self, ids: np.ndarray, heads: np.ndarray, whole: str, own: list[str]) -> np.ndarray:
        """Which of the texts `own` (joined: whole) the ids decode to."""
        lens = self.raw_len[ids]
        to = np.concatenate([[0], np.cumsum(lens)])
        want = np.frombuffer(whole.encode(), np.uint8)
        rows = np.cumsum([0, *(len(x) if x.isascii() else len(x.encode()) for x in own)])
        if (to[heads] != rows).any():
            return np.array([self.decode(ids[i:j]) == x[1:] for i, j, x in zip(heads[:-1], heads[1:], own, strict=True)], bool)
        got = self.raw[np.arange(to[-1]) + np.repeat(self.raw_end[ids] - lens - to[:-1], lens)]
        wrong = np.flatnonzero(got != want)
        same = np.ones(len(own), bool)
        same[np.searchsorted(rows, wrong, "right") - 1] = False
        return same

    def decode(self, ids) -> str:
        raw = self.raw.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        ids = np.asarray(ids, np.int64)
        return b"".join(raw[e - n : e] for e, n in zip(self.raw_end[ids].tolist(), self.raw_len[ids].tolist(), strict=True)).decode("utf-8", "replace").removeprefix(" ")


def load(model_file: str | None = None, theta: float = 0.6) -> Pieces:
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=model_file or default_model())
    ids = range(sp.get_piece_size())
    kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in ids]
    return Pieces([sp.id_to_piece(i) for i in ids], kind, theta)


def _encode(model: Pieces, text_at: int, check: bool):
    """Of batches whose last column is the row key: the columns before it, the ids, and with check whether they restore the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (batch, _, _) in enumerate(text_chunks(batches, text_at, CHUNK)):
            if n % 16 == 15:
                release()
            text = batch.column(text_at)
            ids, heads, same = model.encode(text.to_pylist(), batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(ids), mask=text.is_null() if text.null_count else None)
            out = [*batch.columns[:-1], lists]
            if check:
                out.append(pa.array(same, pa.bool_(), mask=text.is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

    return run


def encode(docs: DataFrame, key: str = "doc_id", model_file: str | None = None, theta: float = 0.6, check: bool = False) -> DataFrame:
    """docs with piece_ids array<int>, a sampled segmentation of text seeded by the key column; check: also lossless, whether decoding restores it."""
    bounded_batches(docs.sparkSession)
    added = ["piece_ids", *(["lossless"] if check else [])]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names))
    types = [f.dataType for f in docs.schema.fields] + [T.ArrayType(T.IntegerType()), T.BooleanType()][: len(added)]
    fields = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    rows = docs.select("*", F.xxhash64(f"`{key}`")).toDF(*(f"c{i}" for i in range(len(names) + 1)))
    return rows.mapInArrow(_encode(load(model_file, theta), names.index("text"), check), fields).toDF(*names, *added)


def decode(rows: DataFrame, column: str = "piece_ids", model_file: str | None = None) -> DataFrame:
    """rows with a text column decoded from piece ids."""
    model = load(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).to_pylist()
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array([None if x is None else model.decode(x) for x in ids], pa.string())], names=[*keep, "text"])

    fields = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces, lossless of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "lossless")


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
