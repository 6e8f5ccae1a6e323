"""Keyed state over streams, kept by Spark's state store.

Each operator is two streaming queries.  The first stages the rows of a
micro-batch as they are and reduces them to little per key, combined map-side:
a count, the distinct instants, or at most five events.  The second reads what
was reduced into `transformWithState` and joins what comes out with the staged
rows.  So a hot key's rows never meet in one task, the state touched follows
the keys of the batch, and Spark commits, restores and expires the state.

Files are written per batch id: a replayed batch replaces its own.  The second
query starts when the first has taken all there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chronoweave.operators.folds import COMPLETED, FAILED, HOT_CACHE_ROWS, IN_PROGRESS, NOT_STARTED, served_by
from chronoweave.operators.ordered import HOT_ROWS, broadcast_if_small, with_position
from chronoweave.schema import CACHE_TTL_SECONDS

# How long after its last event a key's lifecycle is remembered.
IDLE_DAYS = 365
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(
    stream: DataFrame,
    out: str,
    ckpt: str,
    key: str,
    stage: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    reduced: str,
    processor: _Processor,
    emitted: str,
    finish: Callable[[DataFrame | None, DataFrame], DataFrame],
    event_time: tuple[str, str] | None = None,
) -> StreamingQuery:
    """Runs `stage(batch) -> (rows, reduced)`, the processor over what was reduced, and `finish(rows, emitted)`.

    `reduced` and `emitted` are schemas; both hold `key`, and `batch_id` is added to the first.
    Finished rows go to `out`/rows.
    """
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    processor.columns = [key, *[c.split()[0] for c in emitted.split(", ")], "batch_id"]

    def staging(batch: DataFrame, batch_id: int) -> None:
        rows, small = stage(batch.persist())
        rows.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/staged/{batch_id}")
        small.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/reduced/{batch_id}")
        batch.unpersist()

    def finishing(found: DataFrame, number: int) -> None:
        # written first: the stateful plan must run once
        found.write.mode("overwrite").parquet(f"{out}/emitted/{number}")
        found = found.sparkSession.read.schema(found.schema).parquet(f"{out}/emitted/{number}")
        batches = [r[0] for r in found.select("batch_id").distinct().collect()]  # as many as arrived since the last run
        if batches:
            staged = found.sparkSession.read.parquet(*[f"{out}/staged/{b}" for b in batches])
            finish(staged, found).write.mode("overwrite").parquet(f"{out}/rows/batch_id={number}")

    # timers and times to live act when the next rows come; without this a query that has taken everything would not end
    settings = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    taken = stream.writeStream.foreachBatch(staging).option("checkpointLocation", f"{ckpt}/staging").trigger(availableNow=True).start()
    taken.awaitTermination()
    small = spark.readStream.schema(f"`{key}` {kind}, {reduced}, batch_id long").parquet(f"{out}/reduced/*")
    if event_time:
        small = small.withWatermark(*event_time)
    output = f"`{key}` {kind}, {emitted}, batch_id long"
    found = small.groupBy(key).transformWithState(processor, output, "update", processor.time)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return found.writeStream.foreachBatch(finishing).outputMode("update").option("checkpointLocation", f"{ckpt}/state").trigger(availableNow=True).start()
    finally:  # a started query keeps its settings
        for k, v in before.items():
            spark.conf.set(k, v)


class _Processor(StatefulProcessor):
    columns: list[str]
    time = "None"

    def row(self, *values: object) -> Row:
        return Row(**dict(zip(self.columns, values, strict=True)))


class _Counter(_Processor):
    """Rows of a group so far; emits how many there were before each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        for r in sorted(rows, key=lambda r: r["batch_id"]):
            yield self.row(key[0], n, r["batch_id"])
            n += r["n"]
        self.seen.update((n,))


def sequence_by_group(
    stream: DataFrame, out: str, ckpt: str, arrival: str = "reference_time", hot_rows: int = HOT_ROWS
) -> StreamingQuery:
    """Gap-free number of each episode within its group, across micro-batches.

    The state is one counter per group; it does not expire, as a number must not come twice.
    """
    group = "group_id"

    def stage(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return with_position(batch, [group], [arrival, "uuid"], "sequence", hot_rows), batch.groupBy(group).agg(F.count(F.lit(1)).alias("n"))

    def finish(rows: DataFrame, found: DataFrame) -> DataFrame:
        before = broadcast_if_small(found.select(F.col(group).alias("_g"), F.col("batch_id").alias("_b"), "before"))
        joined = rows.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_batch") == F.col("_b")))
        return joined.withColumn("sequence", F.col("sequence") + F.col("before")).drop("_g", "_b", "_batch", "before")

    return _keyed(stream, out, ckpt, group, stage, "n long", _Counter(), "before long", finish)


class _Cache(_Processor):
    """The entry of a key that can still serve; emits it and the entries that follow."""

    time = "EventTime"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        parts = sorted((r["batch_id"], list(r["instants"])) for r in rows)
        for batch_id in sorted({b for b, _ in parts}):
            yield self.row(key[0], None, False, batch_id)  # rows of this batch are to be finished
        entry = before = self.entry.get()[0] if self.entry.exists() else None
        if before is not None:
            yield self.row(key[0], before, False, parts[0][0])
        for batch_id, instants in parts:
            for t in instants:
                if entry is None or t - entry >= self.ttl:
                    entry = t
                    yield self.row(key[0], entry, True, batch_id)
        if entry != before:
            self.entry.update((entry,))
            self.handle.registerTimer(-(-(entry + self.ttl) // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.entry.exists() and self.entry.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.entry.clear()
        return iter(())


def ttl_cache_stream(
    stream: DataFrame,
    out: str,
    ckpt: str,
    key: str,
    ts: str,
    id: str,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    hot_rows: int = HOT_CACHE_ROWS,
) -> StreamingQuery:
    """J5 on a stream whose batches arrive in time order.

    The state is the entry of each key that can still serve; an event-time timer
    clears it one time to live after it has stopped serving.  Of a key's rows in a
    micro-batch only the distinct instants reach its task, in slices of one time to
    live.
    """
    ttl = ttl_seconds * 1_000_000

    def stage(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = batch.select(key, id, ts).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
        slices = rows.groupBy(key, F.floor(F.col("_t") / ttl).alias("_s"))
        return rows, slices.agg(F.sort_array(F.collect_set("_t")).alias("instants"), F.timestamp_micros(F.max("_t")).alias("seen_at")).drop("_s")

    def finish(rows: DataFrame, found: DataFrame) -> DataFrame:
        entries = found.filter("entry IS NOT NULL").select(F.col(key).alias("k"), F.col("entry").alias("_t"), "fresh")
        served = served_by(rows.filter(F.col("_t").isNotNull()), entries, key, id, hot_rows)
        never = rows.filter(F.col("_t").isNull()).withColumns({"_kept": F.lit(None).cast("long"), "hit": F.lit(False)})
        return served.unionByName(never).withColumn("served_from", F.timestamp_micros("_kept")).drop("_t", "_kept", "_batch")

    return _keyed(
        stream, out, ckpt, key, stage, "instants array<long>, seen_at timestamp", _Cache(ttl), "entry long, fresh boolean", finish,
        ("seen_at", f"{ttl_seconds} seconds"),
    )


class _Lifecycle(_Processor):
    """State of a key; emits it after the events of a run."""

    time = "ProcessingTime"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("state", "state string, start long, done long, error string", IDLE_DAYS * 86_400_000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        state, start, done, error = self.current.get() if self.current.exists() else (NOT_STARTED, None, None, None)
        parts = sorted(rows, key=lambda r: r["batch_id"])
        for r in parts:
            for e in sorted(r["events"], key=lambda e: (e["t"], e["id"])):
                t, event = e["t"], e["event"]
                if event == "fail":
                    state, done, error = FAILED, t, e["message"]
                elif event == "start" and state == NOT_STARTED:
                    state, start = IN_PROGRESS, t
                elif event == "complete" and state == IN_PROGRESS:
                    state, done = COMPLETED, t
        self.current.update((state, start, done, error))
        yield self.row(key[0], state, start, done, error, parts[-1]["batch_id"])


def _deciding(batch: DataFrame, key: str) -> DataFrame:
    """At most five events per key, which decide as all of them do: first and last fail, first start,
    first complete and the first one after that start."""
    event = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("id").cast("long").alias("id"), "event", "message")
    events = batch.select(F.col(key).alias("_k"), event.alias("e"))
    is_ = lambda kind: F.when(F.col("e.event") == kind, F.col("e"))
    bounds = events.groupBy("_k").agg(
        F.min(is_("fail")).alias("f1"), F.max(is_("fail")).alias("f2"), F.min(is_("start")).alias("s"), F.min(is_("complete")).alias("c")
    )
    # only keys whose first complete came too early need another look
    early = bounds.filter("c < s").select(F.col("_k").alias("_j"), "s")
    later = events.filter(F.col("e.event") == "complete").join(early, F.col("_k").eqNullSafe(F.col("_j"))).filter(F.struct("e.t", "e.id") > F.struct("s.t", "s.id"))
    later = later.groupBy("_j").agg(F.min("e").alias("c2"))
    whole = bounds.join(later, F.col("_k").eqNullSafe(F.col("_j")), "left")
    return whole.select(F.col("_k").alias(key), F.array_distinct(F.array_compact(F.array("f1", "f2", "s", "c", "c2"))).alias("events"))


def lifecycle_stream(stream: DataFrame, out: str, ckpt: str, key: str) -> StreamingQuery:
    """J6 on a stream with (key, ts, id, event, message) whose batches arrive in time order.

    Writes the new state of every key with events in the batch.  A key without
    events for IDLE_DAYS is forgotten: its state has that time to live.
    """

    def stage(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return batch.select(key).limit(0), _deciding(batch, key)

    def finish(_: DataFrame | None, found: DataFrame) -> DataFrame:
        times = {"start_time": F.timestamp_micros("start"), "completion_time": F.timestamp_micros("done")}
        return found.withColumns(times).select(key, "state", "start_time", "completion_time", "error")

    events = "events array<struct<t:long,id:long,event:string,message:string>>"
    return _keyed(stream, out, ckpt, key, stage, events, _Lifecycle(), "state string, start long, done long, error string", finish)
