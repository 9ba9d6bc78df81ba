"""Streams: journals merged batch by batch, sessions of events, and the debounced event queue."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.components import own_dir
from tessera.sources.pointer import read_small, replace_small

IDLE_S, CEILING_S, MOST_ATTEMPTS, MOST_BYTES = 300, 300, 10, 256 * 1024
EXACT = "session_end"


def new_checkpoint(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs each(batch, number) over all that is there, then stops; a checkpoint makes the next call go on from here."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or new_checkpoint(spark)).foreachBatch(each).start()
    q.awaitTermination()


# ---------------------------------------------------------------- sessions


def session_windows(events: DataFrame, *, gap: str = "300 seconds", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, started, n) of a stream of events; a session is final once the watermark has passed it."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


def collected_sessions(events: DataFrame, **options: str) -> DataFrame:
    """All sessions of what the stream has now, open ones too, from one complete pass; for reports. A stream that goes on takes
    final_sessions(), whose state sheds what is over. The result is a table in the shared folder."""
    spark = events.sparkSession
    out = f"{own_dir(spark)}/sessions-{uuid.uuid4().hex}"
    run_available(session_windows(events, **options), lambda df, _: df.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out)


def final_sessions(events: DataFrame, out: str, checkpoint: str, **options: str) -> DataFrame:
    """The sessions that are final, each written once below out; the next call with the same folders goes on from here."""
    run_available(session_windows(events, **options), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), "append", checkpoint)
    return events.sparkSession.read.parquet(out).drop("batch")


# ---------------------------------------------------------------- journal


BUCKETS = 64


def merge_stream(entries: DataFrame, start: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], *, state_key: Column, entry_key: Column, root: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """State merged with a stream of entries, in buckets by key: a micro-batch reads, merges and writes only the buckets that it
    touches. merge(held, batch) must be by key: equal keys of state and entries fall into one bucket.

    root keeps buckets, their index and the checkpoint: the next call with the same root goes on from here, start then counts no
    more. A batch's files and index have its number, so a batch that is run again overwrites its own ones only."""
    spark = entries.sparkSession
    root = (root or f"{own_dir(spark)}/merged-{uuid.uuid4().hex}").rstrip("/")
    placed = lambda df, key: df.withColumn("bucket", F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int"))

    def index() -> tuple[int, dict[int, int]]:
        held = json.loads(read_small(spark, f"{root}/INDEX") or "null")
        return (held["batch"], {int(b): v for b, v in held["versions"].items()}) if held else (-2, {})

    def written(df: DataFrame, number: int, versions: dict[int, int]) -> None:
        path = f"{root}/v={number}"
        placed(df, state_key).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        touched = [r["bucket"] for r in spark.read.schema(f"{schema}, bucket int").parquet(path).select("bucket").distinct().collect()]  # at most `buckets`
        replace_small(spark, f"{root}/INDEX", json.dumps({"batch": number, "versions": versions | dict.fromkeys(touched, number)}))

    def state(versions: dict[int, int]) -> DataFrame:
        paths = [f"{root}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(start.schema).parquet(*paths) if paths else spark.createDataFrame([], start.schema)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in start.schema.fields)
    if index()[0] == -2:
        written(start, -1, {})

    def each(batch: DataFrame, number: int) -> None:
        done, versions = index()
        if number <= done:
            return  # a batch whose index is written is done
        touched = {r["bucket"] for r in placed(batch, entry_key).select("bucket").distinct().collect()}
        if touched:
            written(merge(state({b: v for b, v in versions.items() if b in touched}), batch), number, versions)

    run_available(entries, each, checkpoint=f"{root}/checkpoint")
    return state(index()[1])


# ---------------------------------------------------------------- event queue


def payload_value(payload: Column, *names: str) -> Column:
    """The first of the names that a JSON payload has, at the top or under properties."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{p}{n}") for n in names for p in ("", "properties.")])


def accepted_payload(payload: Column) -> Column:
    """Whether a payload is a JSON object of at most MOST_BYTES."""
    return (F.octet_length(payload) <= MOST_BYTES) & F.trim(payload).startswith("{") & F.get_json_object(payload, "$").isNotNull()


def event_key(agent: Column, session: Column, payload: Column, most: int = 80) -> Column:
    """agent and session; without a session a hash of the payload, and long sessions cut and hashed."""
    short = F.when(F.length(session) > most, F.concat(F.substring(session, 1, most), F.lit("-"), F.substring(F.sha2(session, 256), 1, 12))).otherwise(session)
    return F.concat(agent, F.lit("/"), F.coalesce(F.nullif(short, F.lit("")), F.substring(F.sha2(payload, 256), 1, 12)))


def coalesced(events: DataFrame) -> DataFrame:
    """The last event of each key (columns key, received_at, trigger, attempts, last_attempt_at): ties go to the greater trigger."""
    cols = [c for c in events.columns if c != "key"]
    return events.groupBy("key").agg(F.max_by(F.struct(*cols), F.struct("received_at", "trigger")).alias("e")).select("key", "e.*")


def backoff(attempts: Column) -> Column:
    """Seconds to wait after so many attempts."""
    return F.least(F.lit(float(CEILING_S)), F.pow(F.lit(2.0), F.least(attempts, F.lit(8))))


def queue_state(queue: DataFrame, now: float) -> DataFrame:
    """queue with state at a time (epoch seconds): dropped, retrying (its backoff runs), waiting (its session may go on), or due."""
    waits = F.col("last_attempt_at").isNotNull() & (F.lit(now) - F.col("last_attempt_at") < backoff(F.col("attempts")))
    idle = (F.col("trigger") != EXACT) & (F.lit(now) - F.col("received_at") < IDLE_S)
    return queue.withColumn("state", F.when(F.col("attempts") >= MOST_ATTEMPTS, "dropped").when((F.col("attempts") > 0) & waits, "retrying").when(idle, "waiting").otherwise("due"))


def drained(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, closed_by, n, last_at) from a stream of (key, at timestamp, trigger): a session ends at once on session_end, else
    once event time has gone IDLE_S past its last event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], "idle", n, pd.Timestamp(last, unit="us")))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("at")
            for at, trigger in zip(rows["at"], rows["trigger"], strict=True):
                us = int(at.value // 1000)
                if n and us - last >= IDLE_S * 1_000_000:
                    out.append((key[0], "idle", n, pd.Timestamp(last, unit="us")))
                    n = 0
                n, last = n + 1, us
                if trigger == EXACT:
                    out.append((key[0], "exact", n, pd.Timestamp(last, unit="us")))
                    n = 0
            if n:
                state.update((n, last))
                state.setTimeoutTimestamp(max(last // 1000 + IDLE_S * 1000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "closed_by", "n", "last_at"])

    keyed = events.withWatermark("at", late).groupBy("key")
    return keyed.applyInPandasWithState(step, "key string, closed_by string, n long, last_at timestamp", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def debounced(changes: DataFrame, gap_s: float = 30.0) -> DataFrame:
    """The changes (key, at in seconds) that lead to an import: the first of a key, and then each that comes gap_s or more after
    the last import, not after the last change.

    A key's imports follow one from another, so its changes pass through one task, in order; none is held but the last import."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), 0.0
        for b in batches:
            taken = []
            for k, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key or at - last >= gap_s:
                    key, last = k, at
                    taken.append(True)
                else:
                    taken.append(False)
            yield b.filter(pa.array(taken, pa.bool_()))

    rows = changes.select("key", "at").where("at is not null")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "at").mapInArrow(fold, f"key {kind}, at double")
