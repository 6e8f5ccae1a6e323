"""Streaming ingestion, dead letters and repeated episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoweave.operators.episodes import normalize_episodes
from chronoweave.operators.extraction import validate_entities, with_objects
from chronoweave.operators.facts import apply_facts, relations_of, split_relations
from chronoweave.operators.maintenance import upsert
from chronoweave.operators.ordered import broadcast_if_small
from chronoweave.operators.resolution import build_mentions, fold_into, merge_mentions, resolve_entities
from chronoweave.plans.ingest import extract_candidates, extract_facts, newest_episodes, quarantine
from chronoweave.schema import DEFAULT_GROUP, EPISODES
from chronoweave.session import cut_lineage
from chronoweave.sources.episodes import stream_episodes

BATCH = "batch_id"


def _append(df: DataFrame, out: str, table: str, batch_id: int) -> None:
    """Each micro-batch owns one folder: a replay replaces its own rows only."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{table}/{BATCH}={batch_id}")


def ingest_batch(
    raw: DataFrame,
    batch_id: int,
    out: str,
    default_group: str | None = DEFAULT_GROUP,
    use_custom_entities: bool = True,
    now: Column | None = None,
) -> None:
    """One micro-batch into the log tables; work grows with the batch only."""
    # contents are parsed once; every table of the batch reads the result
    episodes = with_objects(newest_episodes(normalize_episodes(raw, default_group, now))).persist()
    good, failed = quarantine(episodes)
    candidates = extract_candidates(good, use_custom_entities).persist()
    valid, rejected = validate_entities(candidates)
    _append(good.drop("objects"), out, "episodes", batch_id)
    _append(failed, out, "failed", batch_id)
    _append(valid, out, "candidates", batch_id)
    _append(rejected, out, "rejected", batch_id)
    _append(extract_facts(good, use_custom_entities), out, "facts", batch_id)
    candidates.unpersist()
    episodes.unpersist()


def stream_ingest(
    spark: SparkSession,
    in_dir: str,
    out: str,
    ckpt: str,
    fmt: str = "json",
    default_group: str | None = DEFAULT_GROUP,
    use_custom_entities: bool = True,
    now: Column | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Files of raw episodes to the log tables, all that is available."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, out, default_group, use_custom_entities, now)

    return (
        stream_episodes(spark, in_dir, fmt, max_files)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )


def _last_batches(log: dict[str, DataFrame]) -> DataFrame:
    """(uuid, batch) of the last time each episode arrived, whether it was good or failed."""
    arrived = log["episodes"].select("uuid", BATCH).unionByName(log["failed"].select("uuid", BATCH))
    return arrived.groupBy("uuid").agg(F.max(BATCH).alias("_last"))


def _current(df: DataFrame, last: DataFrame, uuid: str) -> DataFrame:
    """Rows that came with the last arrival of their episode.

    Normalised episodes have a uuid, and no row comes after the last arrival:
    the join deals rows by uuid alone, which what follows can build on.
    """
    of = last.select(F.col("uuid").alias("_u"), "_last")
    return df.join(of, (F.col(uuid) == F.col("_u")) & (F.col(BATCH) >= F.col("_last")), "left_semi").drop(BATCH)


def _current_facts(facts: DataFrame, last: DataFrame) -> DataFrame:
    """Facts in the log name the one episode they were seen in."""
    return _current(facts.withColumn("_from", F.get("episodes", F.lit(0))), last, "_from").drop("_from")


def _refreshed(stored: DataFrame, new: DataFrame, again: DataFrame, whole: dict[str, DataFrame], single_valued: list[str]) -> DataFrame:
    """Stored and new facts; relations known from replaced episodes are read from the whole log anew."""
    lost = cut_lineage(relations_of(stored, again))
    if lost.isEmpty():
        return apply_facts(new, stored, single_valued)
    _, others = split_relations(stored, lost)
    _, news = split_relations(new, lost)
    logged, _ = split_relations(whole["facts"], lost)
    anew = apply_facts(_current_facts(logged, _last_batches(whole)), None, single_valued)
    return apply_facts(news, others, single_valued).unionByName(anew, allowMissingColumns=True)


def materialize(
    spark: SparkSession,
    out: str,
    single_valued: list[str] | None = None,
    base: dict[str, DataFrame] | None = None,
    after: int | None = None,
    before: int | None = None,
) -> dict[str, DataFrame]:
    """The graph as of the log: latest episode per uuid, resolved entities, closed facts.

    An episode that arrived again counts with its last arrival only: what was
    extracted from it before, and a failure before, are gone.  Resolution,
    closing and deduplication do not depend on the order or the cut of the
    batches, so the result is that of one batch over everything.

    `before` gives the graph as of an earlier batch.
    With `base` (a graph stored earlier) only the batches `after` it are read
    and folded into the entities, relations and mentions they touch; the rest
    passes through.  Mentions of replaced episodes go, and facts known from
    replaced episodes only; an attribute of a stored entity counts as of the
    entity's time, so later news replace it.
    """
    whole = {t: spark.read.parquet(f"{out}/{t}") for t in ("episodes", "failed", "candidates", "facts")}
    log = dict(whole)
    if after is not None:
        log = {t: df.filter(F.col(BATCH) > after) for t, df in log.items()}
    if before is not None:
        log = {t: df.filter(F.col(BATCH) < before) for t, df in log.items()}
    last = cut_lineage(_last_batches(log))
    episodes = _current(log["episodes"], last, "uuid").select(*EPISODES.names)
    candidates = _current(log["candidates"], last, "episode_uuid")
    facts = _current_facts(log["facts"], last)
    news = {
        "episodes": episodes,
        "failed": _current(log["failed"], last, "uuid"),
        "entities": candidates.withColumnRenamed("reference_time", "created_at"),
        "mentions": build_mentions(candidates),
    }
    if base is None:
        return news | {"entities": resolve_entities(news["entities"]), "facts": apply_facts(facts, None, single_valued or [])}
    again = broadcast_if_small(cut_lineage(base["episodes"].join(broadcast_if_small(last.select("uuid")), "uuid", "left_semi").select("uuid")))
    return {
        "episodes": upsert(base["episodes"].join(again, "uuid", "left_anti"), episodes),
        "failed": news["failed"],
        "entities": fold_into(base["entities"], news["entities"]),
        "facts": _refreshed(base["facts"], facts, again, whole, single_valued or []),
        "mentions": merge_mentions(base["mentions"], news["mentions"], again),
    }


def quarantine_stream(stream: DataFrame, out: str, ckpt: str) -> StreamingQuery:
    """Good episodes to `out`/ok, bad ones with their error to `out`/failed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        good, failed = quarantine(batch)
        _append(good, out, "ok", batch_id)
        _append(failed, out, "failed", batch_id)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )


def dedup_episodes(episodes: DataFrame, ttl: str | None = None) -> DataFrame:
    """One row per uuid.

    On a stream, repetitions within `ttl` of event time are dropped and older
    state is forgotten.  On a table, the earliest row is kept; copies combine
    map-side, so one uuid with very many copies is one row per task.
    """
    if episodes.isStreaming:
        if ttl is None:
            raise ValueError("a stream needs a ttl")
        return episodes.withWatermark("reference_time", ttl).dropDuplicatesWithinWatermark(["uuid"])
    columns = [c for c in episodes.columns if c != "uuid"]
    earliest = F.min_by(F.struct(*columns), F.struct("reference_time", *[c for c in columns if c != "reference_time"]))
    return episodes.groupBy("uuid").agg(earliest.alias("_r")).select("uuid", "_r.*").select(*episodes.columns)
