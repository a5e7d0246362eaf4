"""A change source by polling, and a keeper that turns changes, requests, scans and configuration edits into passes.

A poll lists names, lengths and modification times only. One aggregate tells whether anything differs from the listing of the poll
before; only then are both listings compared and the differences appended to an event table below the state folder, which
`readStream` reads as a stream. Listings and events lie on the shared file system: the driver holds neither."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.plans.search import SearchIndex
from skein.sources import files
from skein.sources.config import Config, IndexConfig
from skein.streaming.maintain import POLL, drained, watched

log = logging.getLogger(__name__)
EVENTS = "ts timestamp, path string, kind string"
LISTING = "path string, length long, modified timestamp"


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind (create, delete, modify) of two listings (path, length, modified)."""
    stamp = F.struct("length", "modified")
    both = before.select("path", stamp.alias("old")).join(after.select("path", stamp.alias("new")), "path", "full")
    kind = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "modify")
    return both.select("path", kind.alias("kind")).where("kind is not null")


class ChangeSource:
    """The changes of one index's files since the last poll, also those from before a restart."""

    def __init__(self, spark: SparkSession, base_dir: str, config: IndexConfig, state_dir: str):
        self.spark, self.base, self.config, self.state = spark, base_dir, config, state_dir.rstrip("/")
        self._mark, self._listing = None, None
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.state}/listing-*/_SUCCESS")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            newest = max(found, key=lambda s: s.getModificationTime()).getPath().getParent().toString()
            self._listing = newest
            self._mark = self._fingerprint(spark.read.schema(LISTING).parquet(newest))

    @staticmethod
    def _fingerprint(listing: DataFrame) -> tuple:
        return tuple(listing.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modified").cast("decimal(38,0)"))).first())

    def poll(self) -> DataFrame | None:
        """The events that this poll appended, None if there are none; a listing that fails is one overflow event (null path)."""
        now = F.current_timestamp()
        try:
            listing = files.listed(self.spark, self.base, self.config)
            listing = self.spark.createDataFrame([], LISTING) if listing is None else listing.where(watched(F.col("path"))).select("path", "length", "modified")
            mark = self._fingerprint(listing)
            if mark == self._mark:
                return None
            at = f"{self.state}/listing-{uuid.uuid4().hex}"
            listing.write.parquet(at)
        except Exception as e:  # noqa: BLE001
            log.warning("listing failed: %s", e)
            return self.spark.createDataFrame([(None, "overflow")], "path string, kind string").select(now.alias("ts"), "path", "kind")
        after = self.spark.read.schema(LISTING).parquet(at)
        before = self.spark.read.schema(LISTING).parquet(self._listing) if self._listing else after.limit(0)
        batch = f"{self.state}/batch-{uuid.uuid4().hex}"
        changes(before, after).select(now.alias("ts"), "path", "kind").write.parquet(batch)
        events = self.spark.read.schema(EVENTS).parquet(batch)
        events.write.mode("append").parquet(f"{self.state}/events")
        if self._listing:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._listing)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._mark, self._listing = self._fingerprint(after), at
        return events

    def stream(self) -> DataFrame:
        """All events so far and those to come."""
        self.spark.createDataFrame([], EVENTS).write.mode("append").parquet(f"{self.state}/events")
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.state}/events")


class Keeper:
    """Keeps the indexes of a configuration up to date; every tick is one micro-batch of a stream.

    A pass of an index runs when its last change is `debounce` seconds past, at the next tick after a request (every search makes one;
    any number of requests is one pass), and for all indexes every `scan` seconds, after an overflow, and after the configuration
    has changed, which also reopens every index. A pass that fails is logged and tried again at the next tick."""

    def __init__(self, spark: SparkSession, load: Callable[[], Config], opened: Callable[[Config], SearchIndex], state_dir: str, debounce: float = 1.0, scan: float = 300.0, clock: Callable[[], float] = time.time):
        self.spark, self.load, self.opened, self.state = spark, load, opened, state_dir.rstrip("/")
        self.debounce, self.scan, self.clock = debounce, scan, clock
        self._lock, self._requested, self._changed, self._in_flight = threading.Lock(), set(), {}, 0
        self.last_used = self._scanned = clock()
        self.config = None
        self._open(load())

    def _open(self, config: Config) -> None:
        index = self.opened(config)
        sources = {n: ChangeSource(self.spark, index.base, config.index[n], f"{self.state}/{n}") for n in config.index}
        with self._lock:
            self.config, self.index, self.sources = config, index, sources
            self._requested, self._changed = set(config.index), {}

    def request(self, name: str) -> None:
        with self._lock:
            if name in self.sources:
                self._requested.add(name)

    def search(self, name: str, *args, **kwargs) -> DataFrame:
        """SearchIndex.search; it asks for a pass in the background."""
        with self._lock:
            self._in_flight += 1
        try:
            return self.index.search(name, *args, **kwargs)
        finally:
            with self._lock:
                self._in_flight -= 1
            self.last_used = self.clock()
            self.request(name)

    def busy(self) -> bool:
        return self._in_flight > 0

    def tick(self) -> dict:
        """The passes that were due: {name: ReindexStats}."""
        try:
            config = self.load()
            if config != self.config:
                self._open(config)
        except Exception as e:  # noqa: BLE001
            log.warning("configuration not reloaded: %s", e)
        now = self.clock()
        for name, source in self.sources.items():
            events = source.poll()
            if events is not None:
                self._changed[name] = now
                if drained(events).agg(F.max("full_scan")).first()[0]:
                    self._scanned = now - self.scan
        due = {n for n, t in self._changed.items() if now - t >= self.debounce}
        if now - self._scanned >= self.scan:
            due, self._scanned = set(self.sources), now
        with self._lock:
            due |= self._requested
            self._requested = set()
        done = {}
        for name in sorted(due):
            self._changed.pop(name, None)
            try:
                done[name] = self.index.reindex(name)
            except Exception as e:  # noqa: BLE001
                log.warning("pass of %s failed: %s", name, e)
                self.request(name)
        return done

    def start(self, every: str = POLL, on_pass: Callable | None = None) -> StreamingQuery:
        def run(batch: DataFrame, epoch: int) -> None:
            for name, stats in self.tick().items():
                if on_pass:
                    on_pass(name, stats)

        return self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.trigger(processingTime=every).foreachBatch(run).start()
