"""Continuous maintenance: bursts of change events, idle gaps, periodic scans, and a ticker that reindexes.

The file stream source tracks files by name and reports neither edits nor deletions, so passes are driven by a ticker whose batches run
the snapshot diff; event times of a change stream are grouped by session and tumbling windows."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skein.plans.search import SearchIndex

log = logging.getLogger(__name__)
DEBOUNCE, POLL, SCAN, IDLE = "1 second", "500 milliseconds", "5 minutes", "10 minutes"
IGNORED = ("target", "build", "node_modules", ".git")


def bursts(events: DataFrame, ts: str = "ts", gap: str = DEBOUNCE, *keys: str) -> DataFrame:
    """keys, start, end, n: runs of events that stand less than a gap apart; each triggers one pass.

    Batch, or a stream with a watermark; a stream needs a key, for example the index's name, and its session windows also join events
    that stand exactly a gap apart. A batch is cut into hours that are grouped for themselves; only the first and last run of an hour meet in one task."""
    if events.isStreaming:
        w = F.session_window(ts, gap)
        return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    t, step = F.col(ts), F.lit(gap).cast("interval")
    # By the clock of the epoch, so that hours follow each other whatever the time zone; times without a zone go by days.
    hour = F.unix_date(F.to_date(t)) if events.schema[ts].dataType == T.TimestampNTZType() else F.floor(F.unix_seconds(t) / 3600)
    rows = events.where(t.isNotNull()).select(*keys, t.alias("start"), t.alias("last"), F.lit(1).cast("long").alias("n"), hour.alias("hour"))

    def joined(runs: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("start")
        new = F.coalesce(F.col("start") >= F.lag("last").over(order) + step, F.lit(True)).cast("long")
        numbered = runs.withColumn("new", new).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "k").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"))

    runs = joined(rows, *keys, "hour").withColumn("ends", F.max("k").over(Window.partitionBy(*keys, "hour")))
    edge = (F.col("k") == 1) | (F.col("k") == F.col("ends"))
    out = [*keys, "start", "last", "n"]
    whole = runs.where(~edge).select(*out).unionByName(joined(runs.where(edge).select(*out), *keys).select(*out))
    return whole.select(*keys, "start", (F.col("last") + step).alias("end"), "n")


def scan_windows(events: DataFrame, ts: str = "ts", every: str = SCAN) -> DataFrame:
    """start, n by tumbling windows."""
    return events.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def watched(path) -> object:
    """Whether change events of a relative path count."""
    return ~path.rlike("(^|/)(" + "|".join(x.replace(".", "\\.") for x in IGNORED) + ")/") & (~path.startswith(".skein/") | (path == ".skein/config.yaml"))


def drained(events: DataFrame) -> DataFrame:
    """The distinct paths of one batch of change events (path, kind); an overflow event (null path) asks for a full scan."""
    return events.groupBy("path").agg(F.count("*").alias("n")).withColumn("full_scan", F.col("path").isNull())


def keep_indexed(spark: SparkSession, index: SearchIndex, names: list[str] | None = None, every: str = SCAN, on_pass: Callable | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a stream that runs one incremental pass of every index a trigger; a failed pass is logged and tried again at the next."""

    def run(batch: DataFrame, epoch: int) -> None:
        for name in names or sorted(index.stores):
            try:
                stats = index.reindex(name)
                if on_pass:
                    on_pass(name, stats)
            except Exception as e:  # noqa: BLE001
                log.warning("pass of %s failed: %s", name, e)

    writer = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.trigger(processingTime=every).foreachBatch(run)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stop_when_idle(query: StreamingQuery, last_used: Callable[[], float], busy: Callable[[], bool] = lambda: False, idle: float = 600.0, poll: float = 0.5) -> None:
    """Returns after it has stopped the query: when nothing is in flight and the last use is `idle` seconds past."""
    while query.isActive:
        if not busy() and time.time() - last_used() >= idle:
            query.stop()
            return
        time.sleep(poll)
