"""Embedders: the protocol, a deterministic hashing embedder, an ONNX one where model files are given, and the batched column UDF."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH, MAX_TOKENS = 64, 512


class Embedder(Protocol):
    model_id: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def normalised(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors: the mean of the token states (rows x tokens x width) where mask is 1."""
    m = mask[..., None].astype(states.dtype)
    return normalised((states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9))


class HashingEmbedder:
    """Signed hashing of word counts; no model files."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.model_id = dimensions, f"hashing-{dimensions}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1 if h >> 31 else -1
        return normalised(out).tolist()

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


def basic_tokens(text: str) -> list[str]:
    """Lower-cased words and single punctuation marks or symbols."""
    out, word = [], []
    for c in text.lower():
        if c.isspace() or unicodedata.category(c)[0] in "PS":
            if word:
                out.append("".join(word))
                word = []
            if not c.isspace():
                out.append(c)
        else:
            word.append(c)
    return [*out, "".join(word)] if word else out


def wordpiece(text: str, vocab: dict[str, int], limit: int = MAX_TOKENS) -> list[int]:
    """[CLS], the longest matching pieces of each word (## within words, [UNK] where none fits), [SEP]; at most limit ids."""
    ids = [vocab["[CLS]"]]
    for word in basic_tokens(text):
        at, pieces = 0, []
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
            if end is None:
                pieces = [vocab["[UNK]"]]
                break
            pieces.append(vocab[("##" if at else "") + word[at:end]])
            at = end
        ids += pieces
    return [*ids[: limit - 1], vocab["[SEP]"]]


class OnnxEmbedder:
    """A sentence encoder from local files (model.onnx, vocab.txt)."""

    def __init__(self, model_file: str, vocab_file: str, model_id: str, dimensions: int = 384):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(model_file)
        with open(vocab_file, encoding="utf-8") as f:
            self.vocab = {line.rstrip("\n"): i for i, line in enumerate(f)}
        self.model_id, self.dimensions = model_id, dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        rows = [wordpiece(t, self.vocab) for t in texts]
        width = max(map(len, rows))
        ids = np.array([r + [0] * (width - len(r)) for r in rows], np.int64)
        mask = np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], np.int64)
        names = {i.name for i in self.session.get_inputs()}
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = self.session.run(None, {k: v for k, v in given.items() if k in names})[0]
        return mean_pooled(states, mask).tolist()

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


def load_onnx(model_file: str, vocab_file: str, model_id: str = "onnx") -> OnnxEmbedder | None:
    """None if the files or the runtime can't be loaded: searches are then text only."""
    try:
        return OnnxEmbedder(model_file, vocab_file, model_id)
    except Exception:  # noqa: BLE001  any failure to load means no vectors
        return None


def embedded_text(heading: Column, text: Column) -> Column:
    return F.when(heading != "", F.concat(heading, F.lit("\n"), text)).otherwise(text)


def embed_column(embedder: Embedder, text: Column) -> Column:
    """array<float> of unit vectors, computed in batches of at most BATCH rows."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            out: list[list[float]] = []
            for i in range(0, len(texts), BATCH):
                out += embedder.embed_batch(texts[i : i + BATCH])
            yield pd.Series(out)

    return run(text)


def cosine(a: list[float], b: list[float]) -> float:
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0
