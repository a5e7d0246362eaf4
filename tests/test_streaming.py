import datetime as dt
import random
import time

from pyspark.sql import functions as F

from skein.plans.search import SearchIndex
from skein.sources.config import parse
from skein.streaming import maintain

T0 = dt.datetime(2024, 1, 1)


def test_a_burst_of_changes_is_one_pass(spark):
    rows = [(T0 + dt.timedelta(seconds=s), p) for s, p in ((0, "a"), (0.1, "a"), (0.5, "b"), (3, "c"))]
    ev = spark.createDataFrame(rows, "ts timestamp, path string")
    assert sorted(r["n"] for r in maintain.bursts(ev).collect()) == [1, 3]
    assert [r["n"] for r in maintain.scan_windows(ev).collect()] == [4]
    assert {r["path"]: r["n"] for r in maintain.drained(ev).collect()} == {"a": 2, "b": 1, "c": 1}


def brute(times, gap):
    runs = []
    for t in sorted(times):
        if runs and t < runs[-1][1] + gap:
            runs[-1][1:] = [t, runs[-1][2] + 1]
        else:
            runs.append([t, t, 1])
    return sorted((a, b + gap, n) for a, b, n in runs)


def test_events_exactly_a_gap_apart_are_two_bursts(spark):
    us = lambda x: T0 + dt.timedelta(microseconds=x)
    ev = spark.createDataFrame([(us(x),) for x in (0, 999_999, 1_999_999, 1_999_999, 5_000_000)], "ts timestamp")
    assert sorted((r["start"], r["end"], r["n"]) for r in maintain.bursts(ev).collect()) == [(us(0), us(1_999_999), 2), (us(1_999_999), us(2_999_999), 2), (us(5_000_000), us(6_000_000), 1)]


def test_bursts_go_on_over_hours(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(3000):
        at += rng.choice([1, 300, 599, 600, 601, 7200]) if rng.random() < 0.7 else 0
        rows.append((T0 + dt.timedelta(seconds=at), rng.choice("ab")))
    gap = dt.timedelta(seconds=600)
    for kind in ("timestamp", "timestamp_ntz"):
        ev = spark.createDataFrame(rows, f"ts {kind}, path string")
        assert sorted((r["start"], r["end"], r["n"]) for r in maintain.bursts(ev, gap=maintain.IDLE).collect()) == brute([t for t, _ in rows], gap)
    by = maintain.bursts(ev, "ts", maintain.IDLE, "path").collect()
    for key in "ab":
        assert sorted((r["start"], r["end"], r["n"]) for r in by if r["path"] == key) == brute([t for t, p in rows if p == key], gap)


def test_watched_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("a.md", "x/.git/h", "build/a", ".skein/index/x", ".skein/config.yaml")], "path string")
    assert sorted(r["path"] for r in df.where(maintain.watched(F.col("path"))).collect()) == [".skein/config.yaml", "a.md"]


def test_the_ticker_keeps_an_index_up_to_date(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nplum\n")
    index = SearchIndex(spark, str(tmp_path), parse("index: {i: {index_path: idx, markdown: ['*.md']}}"))
    seen = []
    query = maintain.keep_indexed(spark, index, every="1 second", on_pass=lambda name, s: seen.append(s))
    try:
        end = time.time() + 60
        while not seen and time.time() < end:
            time.sleep(0.2)
        (tmp_path / "b.md").write_text("# B\npear\n")
        while not any(s.added and s.docs == 2 for s in seen) and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[0].added == 1 and any(s.docs == 2 for s in seen)


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=s), "p") for s in (0, 0.4, 5, 100)]
    spark.createDataFrame(rows, "ts timestamp, path string").write.parquet(str(tmp_path / "in"))
    ev = spark.readStream.schema("ts timestamp, path string").parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = maintain.bursts(ev, "ts", "1 second", "path").writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.sql("select n from bursts").collect()) in ([1, 2], [2], [1, 1, 2])


def test_an_idle_stream_stops(spark):
    query = spark.readStream.format("rate").load().writeStream.format("noop").start()
    used = time.time()
    maintain.stop_when_idle(query, lambda: used, busy=lambda: time.time() < used + 0.5, idle=0.2, poll=0.1)
    assert not query.isActive and time.time() >= used + 0.5
