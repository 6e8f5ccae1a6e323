"""Node summaries and bi-temporal facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.lookup import top_k
from chronoweave.operators.ordered import (
    HOT_ROWS,
    broadcast_if_small,
    joined_in_order,
    with_last_seen,
    with_next,
    with_position,
)

_RELATION = ["group_id", "source_node_uuid", "name"]


def _incident(facts: DataFrame) -> DataFrame:
    """(node, uuid, created_at, fact): valid facts from each of their ends."""
    valid = facts.filter(F.col("invalid_at").isNull())
    ends = F.array_distinct(F.array("source_node_uuid", "target_node_uuid"))
    return valid.select(F.explode(ends).alias("node"), "uuid", "created_at", "fact")


def node_facts(facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """F14, one row per fact: (node, position, uuid, fact), the valid facts around each node, oldest first."""
    rows = _incident(facts).filter(F.col("fact").isNotNull())
    return with_position(rows, ["node"], ["created_at", "uuid"], "position", hot_rows).select("node", "position", "uuid", "fact")


def node_summary(entities: DataFrame, facts: DataFrame, max_chars: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """the valid facts around each node, oldest first, in one text; degree.

    With `max_chars` the text is cut there.  Each sentence takes at least its
    separator, so it is complete after max_chars + 1 facts: a hub's facts are
    then limited per task before the shuffle, while the degree counts all of them.
    """
    incident = _incident(facts)
    degree = incident.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    if max_chars is None:
        ordered = incident.withColumn("_at", F.struct("created_at", "uuid")).select("node", "_at", "fact")
        text = joined_in_order(ordered, ["node"], "_at", F.col("fact"), " ", "summary", hot_rows=hot_rows)
    else:
        first = top_k(
            incident.filter(F.col("fact").isNotNull()), max_chars + 1, [F.asc("created_at")], ["uuid"], ["node"]
        )
        ranked = F.sort_array(F.collect_list(F.struct("rank", "fact")))
        text = first.groupBy("node").agg(
            F.substring(F.array_join(F.transform(ranked, lambda x: x["fact"]), " "), 1, max_chars).alias("summary")
        )
    return (
        entities.select("uuid")
        .join(degree.withColumnRenamed("node", "uuid"), "uuid", "left")
        .join(text.select(F.col("node").alias("uuid"), "summary"), "uuid", "left")
        .select(
            "uuid",
            F.coalesce("summary", F.lit("")).alias("summary"),
            F.coalesce("degree", F.lit(0)).cast("long").alias("degree"),
        )
    )


def relations_of(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Distinct (group, source, name) of the facts seen in one of the `episodes` (uuid)."""
    rows = facts.select(*_RELATION, F.explode("episodes").alias("uuid"))
    return rows.join(episodes, "uuid", "left_semi").select(*_RELATION).distinct()


def split_relations(facts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of the given relations, and the others."""
    keys = broadcast_if_small(relations.select(*[F.col(c).alias(f"_k_{c}") for c in _RELATION]))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in _RELATION]
    return facts.join(keys, same, "left_semi"), facts.join(keys, same, "left_anti")


def _united() -> Column:
    """Sources of all sightings of a fact, united map-side."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("episodes"))))


def _with_sources(kept: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    """`kept` with the episodes of all rows of `whole` that have the same key."""
    if "episodes" not in whole.columns:
        return kept
    united = whole.groupBy(*key).agg(_united().alias("_episodes")).select(*[F.col(c).alias(f"_k_{c}") for c in key], "_episodes")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    joined = kept.join(united, same, "left").withColumn("episodes", F.coalesce("_episodes", "episodes"))
    return joined.drop("_episodes", *[f"_k_{c}" for c in key])


def _is_single(single_valued: list[str]) -> Column:
    return F.coalesce(F.col("name").isin(single_valued), F.lit(False)) if single_valued else F.lit(False)


def _close(facts: DataFrame, hot_rows: int) -> DataFrame:
    """Each fact of a single-valued relation ends where the next one starts."""
    order = ["valid_at", "uuid", *[c for c in ("fact", "created_at") if c in facts.columns]]
    followed = with_next(facts, _RELATION, order, ["valid_at", "created_at", "uuid"], "_next", hot_rows)
    # a repeated fact stands next to its copy; the last one stays
    distinct = followed.filter(
        ~F.coalesce((F.col("_next.uuid") == F.col("uuid")) & (F.col("_next.valid_at") == F.col("valid_at")), F.lit(False))
    )
    expired = F.when(F.col("_next").isNotNull(), F.greatest("created_at", F.col("_next.created_at")))
    return distinct.withColumns({"invalid_at": F.col("_next.valid_at"), "expired_at": expired}).drop("_next")


def fact_sightings(seen: DataFrame, facts: DataFrame, single_valued: list[str]) -> DataFrame:
    """(uuid, valid_at, episode_uuid), one row for every episode a fact was seen in.

    `seen` holds all rows ever given to `apply_facts` with their `episodes`, and
    `facts` its result.  Sightings are freed of repetitions under their whole
    row and then find the fact that stands for them by a join with one row per
    fact, so a fact seen in a third of all episodes is many rows in many tasks.
    Rows whose `episodes` are null or empty are no sightings.
    """
    rows = seen.select(*_RELATION, "target_node_uuid", "valid_at", "uuid", F.explode("episodes").alias("episode_uuid"))
    exact = rows.filter(_is_single(single_valued)).distinct()
    standing = facts.select(*[F.col(c).alias(f"_k_{c}") for c in (*_RELATION, "target_node_uuid", "valid_at", "uuid")])

    def found(sightings: DataFrame, which: Column, key: list[str]) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
        return sightings.join(standing.filter(which), same).select(
            F.col("_k_uuid").alias("uuid"), F.col("_k_valid_at").alias("valid_at"), "episode_uuid"
        )

    any_of = rows.filter(~_is_single(single_valued)).select(*_RELATION, "target_node_uuid", "episode_uuid").distinct()
    single = F.coalesce(F.col("_k_name").isin(single_valued), F.lit(False)) if single_valued else F.lit(False)
    return found(exact, single, [*_RELATION, "valid_at", "uuid"]).unionByName(found(any_of, ~single, [*_RELATION, "target_node_uuid"]))


def apply_facts(
    new: DataFrame, facts: DataFrame | None, single_valued: list[str], hot_rows: int = HOT_ROWS, unite_episodes: bool = True
) -> DataFrame:
    """stored and new facts with their validity recomputed.

    Single-valued relations are closed over the whole (group, source, name)
    key, so arrival order does not matter; the others are only freed of
    repetitions, keeping the earliest with the episodes of all.  Stored facts of keys without news are
    passed through; they are not even shuffled while the news are small.

    With `unite_episodes` a fact's episodes are one array; without it a fact keeps
    those of its own row, and `fact_sightings` gives all of them as rows, however
    many they are.
    """
    if facts is None:
        return _validity(new, single_valued, hot_rows, unite_episodes)
    touched = broadcast_if_small(new.select(*[F.col(c).alias(f"_t_{c}") for c in _RELATION]).distinct())
    same_key = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in _RELATION]
    affected = facts.join(touched, same_key, "left_semi").unionByName(new, allowMissingColumns=True)
    recomputed = _validity(affected, single_valued, hot_rows, unite_episodes)
    return facts.join(touched, same_key, "left_anti").unionByName(recomputed, allowMissingColumns=True)


def _validity(whole: DataFrame, single_valued: list[str], hot_rows: int, unite_episodes: bool = True) -> DataFrame:
    alone = whole.filter(_is_single(single_valued))
    single = _close(alone, hot_rows)
    if unite_episodes:
        single = _with_sources(single, alone, [*_RELATION, "valid_at", "uuid"])
    others = whole.filter(~_is_single(single_valued))
    columns = [c for c in whole.columns if c not in [*_RELATION, "target_node_uuid"]]
    # the earliest row and the episodes of all rows come from one pass over them
    united = [_united().alias("_episodes")] if unite_episodes and "episodes" in columns else []
    own = [c for c in columns if not (united and c == "episodes")]
    tie = [c for c in ("fact",) if c in columns]
    earliest = F.min_by(F.struct(*own), F.struct("valid_at", "created_at", "uuid", *tie))
    kept = (
        others.groupBy(*_RELATION, "target_node_uuid")
        .agg(earliest.alias("_f"), *united)
        .select(*_RELATION, "target_node_uuid", *[F.col(f"_f.{c}") if c in own else F.col("_episodes").alias(c) for c in columns])
    )
    if "invalid_at" not in whole.columns:
        kept = kept.withColumns({c: F.lit(None).cast("timestamp") for c in ("invalid_at", "expired_at")})
    return single.unionByName(kept)


def facts_as_of(
    facts: DataFrame,
    valid_t: Column,
    known_t: Column | None = None,
    single_valued: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """F16: facts true at valid_t, as known now or at known_t.

    With known_t the validity is recomputed from what was known then.
    """
    if known_t is not None:
        facts = facts.filter(F.col("created_at") <= known_t)
        if "invalid_at" in facts.columns:
            # an end recorded later was not known then
            later = F.col("expired_at") > known_t
            facts = facts.withColumns(
                {c: F.when(later, None).otherwise(F.col(c)) for c in ("invalid_at", "expired_at")}
            )
        facts = apply_facts(facts, None, single_valued or [], hot_rows)
    at = F.col("valid_at") <= valid_t
    return facts.filter(at & (F.col("invalid_at").isNull() | (F.col("invalid_at") > valid_t)))


def facts_as_of_keys(
    facts: DataFrame, probes: DataFrame, keys: list[str], at: str = "at", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """F16 for a table of (keys, at): the latest fact at or before each time.

    Facts and probes are put in one time order per key and each probe takes the
    last fact seen; no theta join, no pairs.  Probes keep their other columns.
    """
    extra = [c for c in probes.columns if c not in [*keys, at]]
    fact = F.struct(*[c for c in facts.columns if c not in keys])
    events = facts.select(
        *keys,
        F.col("valid_at").alias("_at"),
        F.lit(0).alias("_kind"),
        F.col("uuid").alias("_tie"),
        fact.alias("_fact"),
        F.lit(None).cast(probes.select(*extra, at).schema).alias("_probe"),
    )
    asked = probes.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit("").alias("_tie"),
        F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("_fact"),
        F.struct(*extra, at).alias("_probe"),
    )
    seen = with_last_seen(events.unionByName(asked), keys, ["_at", "_kind", "_tie"], "_fact", "_found", hot_rows)
    found = seen.filter(F.col("_kind") == 1).select(*keys, "_probe.*", F.col("_found").alias("found"))
    still = F.col("found.invalid_at").isNull() | (F.col("found.invalid_at") > F.col(at))
    return found.withColumn("found", F.when(still, F.col("found")))
