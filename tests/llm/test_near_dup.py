import random
import re

import pytest

from pyspark.sql import functions as F

from skein.llm import near_dup
from skein.llm._common import joined, stored
from skein.llm.near_dup import near_duplicates

SCHEMA = "doc_id long, text string"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_links_of_edited_copies_match_brute_force(spark, n, percent, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for words in (60, 150, 400):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(70):  # rates of edits on both sides of the threshold; some copies of copies
            words_ = list(base)
            rate = rng.uniform(0, 0.06)
            for k in range(len(words_)):
                if rng.random() < rate:
                    words_[k] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 5, " ".join(words_)))
            if rng.random() < 0.2:
                base = words_
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "x " * 50_000), (8, "x " * 50_000), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (10, "a b c d")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA + ", a string, bands int")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, 3, 85).collect()), key=str)
    want = [(0, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 2, 9, True), (9, 2, 9, True), (10, 2, 9, False)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_pairs_that_can_link_are_compared(spark):
    """Members of one star that differ from its centre in 26 of 200 elements each and share about 8 of these; two links are planted."""
    rng = random.Random(5)
    differ = {i: set(rng.sample(range(80), 26)) for i in range(1, 41)}
    for x, y in ((1, 2), (3, 4)):
        differ[y] = set(rng.sample(sorted(differ[x]), 20)) | set(range(100 + 10 * y, 106 + 10 * y))
    near = spark.createDataFrame([(0, i, 100, 100, 26, sorted(d)) for i, d in differ.items()], "a long, node long, n long, c long, d long, delta array<long>")
    label = spark.createDataFrame([(i, i, [0] * 8) for i in differ], "node long, component long, bits array<long>")
    got = {(r["a"], r["b"]) for r in near_dup._by_difference(near, label, 80).collect()}
    want = {(x, y) for x in differ for y in differ if x < y and 100 * (200 - len(differ[x] ^ differ[y])) >= 80 * (200 + len(differ[x] ^ differ[y]))}
    assert {(1, 2), (3, 4)} <= want <= got and len(got) < 30, len(got)


def test_the_left_side_of_a_join_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    base = stored(spark.range(2000).select(F.lit(1).cast("long").alias("k"), "id"))
    right = stored(spark.range(3).withColumnRenamed("id", "k"))
    assert joined(base.mapInArrow(look, "k long, id long"), right, ["k"], "inner", F.col("id"), False, like=base).count() == 2000
    assert seen.value == 2000
