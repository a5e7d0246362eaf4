"""The pipeline on documents whose fate is known by construction."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from skein.llm import sentencepiece  # noqa: E402

VOCAB = [f"{a}{b}{c}" for a in "bdfgklmnprstv" for b in ("a", "e", "io", "u") for c in ("rt", "st", "ng", "l", "m", "pt", "sk")]


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path))


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    bench = [text(25) for _ in range(3)]
    docs, labels, fate = [], [], {}

    def add(i, t, what):
        docs.append((i, t, "en", "s", len(t or "")))
        fate[i] = what

    for i in range(300):  # every fourth is toxic
        toxic = i % 4 == 0
        add(i, " ".join(w if not toxic or k % 9 else "scumbag" for k, w in enumerate(text(60).split())), "toxic" if toxic else "clean")
        labels.append((i, 1, int(toxic)))
    for k in range(20):
        add(1000 + k, text(100), "clean")
        add(2000 + k, docs[-1][1] + " tail", "copy")
    for k, b in enumerate(bench):
        add(3000 + k, f"{text(30)} {b} {text(30)}", "leak")
    add(4000, f"{text(30)} mail to ann@example.org or +1 555 123 4567 now", "private")
    add(5000, "", "empty")
    docs.append((5001, None, None, "s", None))
    fate[5001] = "empty"
    write(spark, tmp_path / "documents.parquet", docs, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path / "labels.parquet", labels, "doc_id long, quality int, toxic int")
    write(spark, tmp_path / "benchmark.parquet", list(enumerate(bench)), "item_id long, text string")

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, what in fate.items() if what in ("clean", "private", "empty")}
    text_of = {i: t for i, t, *_ in docs}
    model = sentencepiece.load()
    for i, r in got.items():
        assert r["text"] == text_of[i] if i != 4000 else r["text"].endswith("mail to [EMAIL] or [PHONE] now")
        assert r["piece_ids"] is None if r["text"] is None else model.decode(r["piece_ids"]) == r["text"]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path / "documents.parquet", [], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path / "labels.parquet", [], "doc_id long, quality int, toxic int")
    write(spark, tmp_path / "benchmark.parquet", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
