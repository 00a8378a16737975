"""A cache of answers whose entries run out, as keyed state of a stream, by the time of the look-ups themselves."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriloom.streaming.flows import with_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROWS = "key string, id bigint, at bigint, outcome string, stored bigint"


class Cache(StatefulProcessor):
    """State of a key: when its entry was stored, and look-ups that wait until no earlier one can come.

    Look-ups are answered in order of their time once the watermark has passed them, whatever order they came in. One
    without an entry, or whose entry has run out, is a miss and stores an entry; others are hits and leave it as it
    is. An entry that runs out gives a row of its own and leaves no state behind.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "stored bigint")
        self.waiting = handle.getListState("waiting", "at bigint, id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(r["at"], r["id"]) for r in rows]
        self.waiting.appendList(fresh)
        self._wake(min(at for at, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        out, name = [], key[0]
        stored = self.entry.get()[0] if self.entry.exists() else None
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [w for w in waiting if w[0] < until]
        for at, id in [*due, (until, None)]:
            if stored is not None and stored + self.ttl < until and stored + self.ttl <= at:
                out.append(Row(key=name, id=None, at=stored + self.ttl, outcome="expiry", stored=stored))
                stored = None
            if id is not None:
                out.append(Row(key=name, id=id, at=at, outcome="miss" if stored is None else "hit", stored=at if stored is None else stored))
                stored = at if stored is None else stored
        if stored is None:
            self.entry.clear()
        else:
            self.entry.update((stored,))
            self._wake(stored + self.ttl)
        if left := waiting[len(due) :]:
            self.waiting.put(left)
            self._wake(left[0][0])
        else:
            self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        """Comes back once the watermark is beyond a time."""
        self.handle.registerTimer(micros // 1000 + 1)


@contextlib.contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """Keyed state with timers needs the store that keeps state on disk; partitions: of the state, else the session's."""
    new = {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | ({PARTITIONS: str(partitions)} if partitions else {})
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cached(stream: DataFrame, key: str, id: str, time: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """Rows of look-ups (key, id, at in microseconds, outcome hit or miss, stored: when the entry that counts was stored)
    and of entries that ran out (outcome expiry, no id). Run it within state_store.

    Look-ups of one time go by id. Look-ups that come later than `late` behind the newest are left out, null keys and
    times too; look-ups that the watermark hasn't passed yet stay in state.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(id).cast("long").alias("id"), F.col(time).cast("timestamp").alias("seen")).filter("key is not null and id is not null and seen is not null")
    rows = with_time(rows, "seen", late).withColumn("at", F.unix_micros("seen"))
    return rows.groupBy("key").transformWithState(Cache(int(seconds * 1_000_000)), ROWS, "Append", "EventTime")
