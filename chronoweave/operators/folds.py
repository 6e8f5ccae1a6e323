"""J5, J6 in batch: the TTL cache and the lifecycle of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.ordered import broadcast_if_small, hot_keys, with_last_seen
from chronoweave.schema import CACHE_TTL_SECONDS
from chronoweave.session import cut_lineage

# One key's instants a single sorted pass may take alone.
HOT_CACHE_ROWS = 1_000_000


def ttl_cache(
    events: DataFrame,
    key: str,
    ts: str,
    id: str,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    hot_rows: int = HOT_CACHE_ROWS,
) -> DataFrame:
    """Which events a cache with a fixed life time serves.

    Adds `hit` and `served_from` (time of the entry that answers: the event's
    own time on a miss).  A hit does not renew the entry.  Whether an event is
    a miss depends on the miss before it, so ordinary keys are walked in time
    order, with the state of one key in memory at a time; keys too large for
    one task are solved by path doubling.
    """
    ttl = ttl_seconds * 1_000_000
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = timed.filter(F.col("_t").isNotNull())
    never = timed.filter(F.col("_t").isNull()).withColumns({"_kept": F.lit(None).cast("long"), "hit": F.lit(False)})
    hot = hot_keys(rows, [key], hot_rows)
    if hot is None:
        return _served(_walk(rows, key, id, ttl).unionByName(never))
    names = broadcast_if_small(hot.select(F.col(key).alias("_h")))
    is_hot = F.col(key).eqNullSafe(F.col("_h"))
    small = _walk(rows.join(names, is_hot, "left_anti"), key, id, ttl)
    return _served(never.unionByName(small).unionByName(_double(rows.join(names, is_hot, "left_semi"), key, id, ttl, hot_rows)))


def _served(df: DataFrame) -> DataFrame:
    return df.withColumn("served_from", F.timestamp_micros("_kept")).drop("_t", "_kept")


def _walk(rows: DataFrame, key: str, id: str, ttl: int) -> DataFrame:
    """One pass over partitions sorted by (key, time); state is (key, last entry)."""
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("_kept", T.LongType()), T.StructField("hit", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, entry = None, None  # no entry yet
        for batch in batches:
            t = batch.column("_t").to_numpy()
            coded = batch.column(key).dictionary_encode(null_encoding="encode")
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(t) else []
            kept = np.empty(len(t), dtype=np.int64)
            miss = np.zeros(len(t), dtype=bool)
            for a, b in zip(starts, [*starts[1:], len(t)]):
                at = a
                if entry is not None and name == names[codes[a]]:
                    # rows still served by the entry of the batch before
                    at = a + int(np.searchsorted(t[a:b], entry + ttl))
                    kept[a:at] = entry
                name = names[codes[a]]
                while at < b:
                    entry = int(t[at])
                    after = at + int(np.searchsorted(t[at:b], entry + ttl))
                    kept[at:after], miss[at] = entry, True
                    at = after
            columns = [*batch.columns, pa.array(kept), pa.array(~miss)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    ordered = rows.repartition(key).sortWithinPartitions(key, "_t", id)
    return ordered.mapInArrow(run, schema)


def _double(rows: DataFrame, key: str, id: str, ttl: int, hot_rows: int) -> DataFrame:
    """Hot keys: entries are the path from the first instant along "first
    instant at least ttl later"; doubling the jumps reaches all of it in
    log2(path length) rounds, each a join on (key, instant)."""
    instants = rows.select(F.col(key).alias("k"), "_t").distinct()
    # backward order: the last instant seen at or after _t + ttl
    looks = instants.select("k", (-F.col("_t")).alias("o"), F.lit(0).alias("p"), F.col("_t").alias("v"))
    asks = instants.select("k", (-F.col("_t") - ttl).alias("o"), F.lit(1).alias("p"), F.lit(None).cast("long").alias("v"))
    seen = with_last_seen(looks.unionByName(asks), ["k"], ["o", "p"], "v", "n", hot_rows)
    jumps = cut_lineage(
        seen.filter((F.col("p") == 1) & F.col("n").isNotNull()).select("k", (-F.col("o") - ttl).alias("_t"), "n")
    )
    kept = cut_lineage(instants.groupBy("k").agg(F.min("_t").alias("_t")))
    same = lambda a, b, ta, tb: F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k")) & (F.col(f"{a}.{ta}") == F.col(f"{b}.{tb}"))
    while True:
        step = kept.alias("a").join(jumps.alias("b"), same("a", "b", "_t", "_t")).select("a.k", F.col("b.n").alias("_t"))
        more = cut_lineage(kept.unionByName(step).distinct())
        if more.count() == kept.count():
            break
        kept = more
        jumps = cut_lineage(
            jumps.alias("a").join(jumps.alias("b"), same("a", "b", "n", "_t")).select("a.k", "a._t", "b.n")
        )
    return served_by(rows, kept.withColumn("fresh", F.lit(True)), key, id, hot_rows)


def served_by(rows: DataFrame, entries: DataFrame, key: str, id: str, hot_rows: int) -> DataFrame:
    """`rows` plus `_kept`, the last of the `entries` (k, _t, fresh) of their key at or before `_t`, and `hit`.

    A fresh entry is made by the first row at its instant; another one, at most one
    per key and before its fresh ones, was there before.
    """
    entry = entries.filter("fresh").select(F.col("k").alias("_k"), F.col("_t").alias("_e"))
    carried = entries.filter("NOT fresh").select(F.col("k").alias("_c"), F.col("_t").alias("_before"))
    marked = rows.join(entry, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_e")), "left").drop("_k")
    found = with_last_seen(marked, [key], ["_t", id], "_e", "_kept", hot_rows)
    # of several rows at an entry's instant the first is the miss; a null id comes first
    place = F.struct(F.col(id).isNotNull(), F.col(id))
    firsts = found.filter(F.col("_e").isNotNull()).groupBy(F.col(key).alias("_k"), F.col("_t").alias("_ft")).agg(
        F.min(place).alias("_first")
    )
    joined = found.join(firsts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_ft")), "left")
    hit = F.col("_first").isNull() | ~place.eqNullSafe(F.col("_first"))
    joined = joined.withColumn("hit", hit).join(broadcast_if_small(carried), F.col(key).eqNullSafe(F.col("_c")), "left")
    return joined.withColumn("_kept", F.coalesce("_kept", "_before")).select(*rows.columns, "_kept", "hit")


# The states of a key.
NOT_STARTED, IN_PROGRESS, COMPLETED, FAILED = "not_started", "in_progress", "completed", "failed"


def _bounds(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: first fail, accepted start, accepted complete, last fail.

    Minima and maxima only, so each pass combines map-side.
    """
    at = F.struct("ts", "id")
    is_ = lambda kind: F.col("event") == kind
    first = events.groupBy(*keys).agg(
        F.min(F.when(is_("fail"), at)).alias("first_fail"),
        F.max(F.when(is_("fail"), at)).alias("last_fail"),
        F.max_by("message", F.when(is_("fail"), at)).alias("error"),
        F.min(F.when(is_("start"), at)).alias("first_start"),
        F.min(F.when(is_("complete"), at)).alias("first_complete"),
    )
    before_fail = F.col("first_fail").isNull() | (F.col("first_start") < F.col("first_fail"))
    first = first.withColumn("start", F.when(before_fail, F.col("first_start"))).drop("first_start")
    # a complete before the start is ignored, so the accepted one needs the start
    completes = (
        events.filter(is_("complete"))
        .select(*keys, at.alias("_c"))
        .join(_renamed(first.filter(F.col("first_complete").isNotNull()), keys, ["start", "first_fail"]), _same_keys(keys))
        .filter((F.col("_c") > F.col("start")) & (F.col("first_fail").isNull() | (F.col("_c") < F.col("first_fail"))))
        .groupBy(*keys)
        .agg(F.min("_c").alias("complete"))
    )
    known = _renamed(completes, keys, ["complete"])
    return first.drop("first_complete").join(known, _same_keys(keys), "left").drop(*[f"_k_{k}" for k in keys])


def _renamed(df: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *others)


def _same_keys(keys: list[str]) -> list[Column]:
    """Equal keys, null with null."""
    return [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]


def lifecycle(events: DataFrame, keys: list[str], now: str | None = None) -> DataFrame:
    """The state each key ends in.

    `events` has the keys and (ts, id, event, message); events are start,
    complete and fail, ordered by (ts, id).
    """
    b = _bounds(events, keys)
    state = (
        F.when(F.col("first_fail").isNotNull(), FAILED)
        .when(F.col("complete").isNotNull(), COMPLETED)
        .when(F.col("start").isNotNull(), IN_PROGRESS)
        .otherwise(NOT_STARTED)
    )
    completion = F.coalesce("last_fail.ts", "complete.ts")
    seconds = lambda a, b: F.round((F.unix_micros(a) - F.unix_micros(b)) / 1e6, 6)
    until = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return b.select(
        *keys,
        state.alias("state"),
        F.col("start.ts").alias("start_time"),
        completion.alias("completion_time"),
        seconds(completion, F.col("start.ts")).alias("duration_seconds"),
        "error",
        F.when(state == IN_PROGRESS, seconds(until, F.col("start.ts"))).alias("elapsed_seconds"),
    )


def lifecycle_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """J6 per event: `ignored` marks transitions the state did not allow."""
    b = _bounds(events, keys).select(*keys, "start", "complete")
    at = F.struct("ts", "id")
    accepted = (
        F.when(F.col("event") == "fail", F.lit(True))
        .when(F.col("event") == "start", at == F.col("start"))
        .otherwise(at == F.col("complete"))
    )
    joined = events.join(_renamed(b, keys, ["start", "complete"]), _same_keys(keys), "left")
    return joined.withColumn("ignored", ~F.coalesce(accepted, F.lit(False))).drop("start", "complete", *[f"_k_{k}" for k in keys])
