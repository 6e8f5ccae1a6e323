"""A5, G: upserts, deletions and the status of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.lookup import meeting, unknown_ids
from chronoweave.operators.ordered import broadcast_if_small
from chronoweave.schema import GRAPH_TABLES
from chronoweave.session import cut_lineage


def upsert(target: DataFrame, updates: DataFrame, key: str = "uuid", order: list[str] | None = None) -> DataFrame:
    """A5: replaces rows with the updates' keys and appends the rest.

    Several updates of one key are reduced to the last in `order` (by default
    all columns that have an order; maps have none), combined map-side.  Target
    rows are not shuffled while the updates are small.
    """
    columns = [c for c in updates.columns if c != key]
    by = order or [c for c in columns if "map<" not in updates.schema[c].dataType.simpleString()]
    last = F.max_by(F.struct(*columns), F.struct(*by) if by else F.lit(0))
    newest = updates.groupBy(key).agg(last.alias("_u")).select(key, "_u.*")
    kept = target.join(broadcast_if_small(updates.select(key).distinct()), key, "left_anti")
    return kept.unionByName(newest)


def delete_facts(facts: DataFrame, uuids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: facts without the given ones, and the uuids that do not exist."""
    gone, facts = meeting(uuids, facts)
    return facts.join(gone, "uuid", "left_anti"), unknown_ids(gone, facts)


def delete_episodes(
    episodes: DataFrame, mentions: DataFrame, uuids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes and their mentions without the given ones, unknown uuids.

    Entities and facts stay.
    """
    gone, episodes = meeting(uuids, episodes)
    kept = episodes.join(gone, "uuid", "left_anti")
    kept_mentions = mentions.join(gone.withColumnRenamed("uuid", "episode_uuid"), "episode_uuid", "left_anti")
    return kept, kept_mentions, unknown_ids(gone, episodes)


def delete_group_episodes(
    episodes: DataFrame, mentions: DataFrame, group_ids: list[str]
) -> tuple[DataFrame, DataFrame]:
    """G2 by group."""
    other = ~F.coalesce(F.col("group_id").isin(group_ids), F.lit(False))
    return episodes.filter(other), mentions.filter(other)


def clear_graph(tables: dict[str, DataFrame], group_ids: list[str] | None = None) -> dict[str, DataFrame]:
    """Every table emptied, or freed of the given groups; schemas stay."""
    if group_ids is None:
        return {name: df.filter(F.lit(False)) for name, df in tables.items()}
    keep: Column = ~F.coalesce(F.col("group_id").isin(group_ids), F.lit(False))
    return {name: df.filter(keep) for name, df in tables.items()}


def graph_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts, newest episode, active facts and referential checks per group.

    References are counted per (group, node) before they meet the entities, so
    a hub node is one row there.  Tables may be the ends of long plans: facts,
    mentions and entities are gone through once each, their counts kept.
    """
    episodes, entities, facts, mentions = (
        tables[n] for n in list(GRAPH_TABLES) if n != "postings"
    )
    one = F.lit(1)
    # each fact stands here twice, once per end
    ends = facts.select(
        "group_id", F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("node"), F.lit("fact").alias("kind"),
        F.col("invalid_at").isNull().alias("active"),
    )
    named = mentions.select("group_id", F.col("entity_uuid").alias("node"), F.lit("mention").alias("kind"), F.lit(False).alias("active"))
    counted = [F.count(one).alias("n"), F.count_if("active").alias("active")]
    references = cut_lineage(ends.unionByName(named).groupBy("group_id", "node", "kind").agg(*counted))
    entities = cut_lineage(entities.select("uuid", "group_id"))
    facts_by_group = references.filter("kind = 'fact'").groupBy("group_id")
    half = lambda c: F.expr(f"sum({c}) div 2")
    per_table = [
        episodes.groupBy("group_id").agg(
            F.count(one).alias("episodes"), F.max("reference_time").alias("newest_episode")
        ),
        entities.groupBy("group_id").agg(F.count(one).alias("entities")),
        facts_by_group.agg(half("n").alias("facts"), half("active").alias("active_facts")),
        references.filter("kind = 'mention'").groupBy("group_id").agg(F.sum("n").alias("mentions")),
    ]
    dangling = (
        references.join(entities.select(F.col("uuid").alias("node")), "node", "left_anti")
        .groupBy("group_id")
        .agg(
            F.sum(F.when(F.col("kind") == "fact", F.col("n"))).alias("_facts_off"),
            F.sum(F.when(F.col("kind") == "mention", F.col("n"))).alias("_mentions_off"),
        )
    )
    whole = per_table[0]
    for part in [*per_table[1:], dangling]:
        whole = whole.join(part, "group_id", "full")
    zero = F.lit(0).cast("long")
    counts = ["episodes", "entities", "facts", "active_facts", "mentions"]
    facts_off, mentions_off = F.coalesce("_facts_off", zero), F.coalesce("_mentions_off", zero)
    error = F.concat_ws(
        "; ",
        F.when(facts_off > 0, F.concat(facts_off.cast("string"), F.lit(" fact endpoints without entity"))),
        F.when(mentions_off > 0, F.concat(mentions_off.cast("string"), F.lit(" mentions without entity"))),
    )
    return whole.select(
        "group_id",
        *[F.coalesce(c, zero).alias(c) for c in counts],
        "newest_episode",
        F.when(error == "", "ok").otherwise("error").alias("status"),
        F.when(error != "", error).alias("error"),
    )
