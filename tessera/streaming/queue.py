"""The event queue as a stateful stream: sessions that end are imported at once, others once they are idle, failures come again later and
later, and what fails too often goes to a table of its own.

Each key has its last event, its attempts and a timer as state. With the clock of processing time a timer fires when its time has come. With event
time the clock is the watermark, so a log can be replayed: attempts happen at the times at which they fell due, before any
event that came later; what falls due at the moment of a newer event is that event's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.streams import CEILING_S, EXACT, IDLE_S, MOST_ATTEMPTS, run_available

ATTEMPT = "key string, event_id long, trigger string, attempt int, outcome string, at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = "event_id long, trigger string, received long, attempts int, due long"


class _Queue(StatefulProcessor):
    """work(key, event_id, trigger, attempt) imports a session; false or an error is a failure."""

    def __init__(self, work: Callable[[str, int, str, int], bool], event_time: bool):
        self.work, self.event_time = work, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", _STATE)

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _tried(self, key: str, held: tuple, before: int) -> tuple[list[tuple], tuple | None]:
        """The attempts that fall due before a time, and what is left."""
        out = []
        while held is not None and held[4] < before:
            event, trigger, received, attempts, due = held
            attempts += 1
            try:
                done = bool(self.work(key, event, trigger, attempts))
            except Exception:
                done = False
            outcome = "imported" if done else "dropped" if attempts >= MOST_ATTEMPTS else "failed"
            out.append((key, event, trigger, attempts, outcome, pd.Timestamp(due, unit="ms", tz="UTC")))
            wait = min(CEILING_S, 2 ** min(attempts, 8)) * 1000
            held = (event, trigger, received, attempts, due + wait) if outcome == "failed" else None
            if not self.event_time:
                before = min(before, due)  # the clock goes on by itself: one attempt for each time a timer fires
        return out, held

    def _kept(self, held: tuple | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(held[4])

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ATTEMPT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        out: list[tuple] = []
        for at, event, trigger in sorted((int(r.at.value // 1_000_000), r.event_id, r.trigger) for b in rows for r in b.itertuples()):
            tried, held = self._tried(key[0], held, at)
            out += tried
            held = (event, trigger, at, 0, at if trigger == EXACT else at + IDLE_S * 1000)
        tried, held = self._tried(key[0], held, self._now(timerValues))
        self._kept(held)
        yield from self._frame(out + tried)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            out, held = self._tried(key[0], tuple(self.held.get()), self._now(timerValues))
            self._kept(held)
            yield from self._frame(out)

    def close(self) -> None:
        pass


def attempts(events: DataFrame, work: Callable[[str, int, str, int], bool], *, event_time: bool = True, late: str = "0 seconds") -> DataFrame:
    """The attempts (ATTEMPT) at the sessions of a stream of (key, event_id, trigger, at): a newer event of a key takes the place of an older one.

    Its state needs the RocksDB state store, which this sets for the session."""
    events.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("key", "event_id", "trigger", F.col("at").cast("timestamp").alias("at")).where("key is not null and at is not null")
    rows = rows.withWatermark("at", late) if event_time else rows
    return rows.groupBy("key").transformWithStateInPandas(_Queue(work, event_time), ATTEMPT, "append", "EventTime" if event_time else "ProcessingTime")


def drained_to(events: DataFrame, work: Callable[[str, int, str, int], bool], out: str, checkpoint: str, **options) -> tuple[DataFrame, DataFrame]:
    """Drains what a stream has now; all attempts of all calls, and those whose sessions were dropped. A batch that is run again overwrites its own rows."""

    def each(batch: DataFrame, n: int) -> None:
        kept = batch.withColumn("dead", F.col("outcome") == "dropped")
        kept.write.mode("overwrite").partitionBy("dead").parquet(f"{out}/batch={n}")

    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    try:
        run_available(attempts(events, work, **options), each, checkpoint=checkpoint)
    finally:  # other streams keep the store that they had
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    found = spark.read.schema(f"{ATTEMPT}, dead boolean, batch int").parquet(out)
    return found.drop("dead", "batch"), found.where("dead").drop("dead", "batch", "outcome")
