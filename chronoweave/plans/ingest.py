"""From episodes to the rows of a graph, in batch; streams run the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import normalized_name, stable_id
from chronoweave.operators.extraction import (
    PROJECT,
    extract_requirements,
    json_objects,
    json_relations,
    requirement_facts,
    typed_extract,
    validate_entities,
    with_objects,
)
from chronoweave.operators.facts import apply_facts
from chronoweave.operators.ordered import HOT_ROWS
from chronoweave.operators.resolution import build_mentions, resolve_entities
from chronoweave.session import cut_lineage

EXTRACTED = ["episode_uuid", "group_id", "reference_time", "label", "name", "attributes"]


def quarantine(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes that can be processed, and the failed ones with the reason.

    A condition on the row alone: a bad episode holds up nobody in its group.
    Episodes that with_objects has staged keep their objects.
    """
    staged = "error" in episodes.columns
    judged = episodes if staged else with_objects(episodes)
    good = judged.filter(F.col("error").isNull()).drop("error")
    return good if staged else good.drop("objects"), judged.filter(F.col("error").isNotNull()).drop("objects")


def extract_candidates(episodes: DataFrame, use_custom_entities: bool = True) -> DataFrame:
    """Entity candidates of all kinds, one row per occurrence."""
    objects = json_objects(episodes).select(*EXTRACTED)
    if not use_custom_entities:
        return objects
    itself = F.struct("label", "name", "attributes")
    # a requirement brings the project it belongs to
    project = F.struct(
        F.lit(PROJECT).alias("label"),
        F.col("attributes")["project_name"].alias("name"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
    entities = F.when(F.col("label") == "Requirement", F.array(itself, project)).otherwise(F.array(itself))
    typed = typed_extract(episodes).select(*EXTRACTED[:3], F.inline(entities))
    return objects.unionByName(typed)


def _node_id(side: str) -> Column:
    return stable_id(F.col("group_id"), F.col(f"{side}_label"), normalized_name(F.col(f"{side}_name")))


def extract_facts(episodes: DataFrame, use_custom_entities: bool = True) -> DataFrame:
    """Facts between the extracted entities, valid from the episode's time."""
    columns = [
        "episode_uuid", "group_id", "reference_time", "source_label", "source_name",
        "target_label", "target_name", "name", "fact",
    ]
    rows = json_relations(episodes).select(*columns)
    if use_custom_entities:
        rows = rows.unionByName(requirement_facts(extract_requirements(episodes)).select(*columns))
    ends = rows.withColumns({"source_node_uuid": _node_id("source"), "target_node_uuid": _node_id("target")})
    uuid = stable_id(
        F.col("group_id"), F.col("source_node_uuid"), F.col("name"), F.col("target_node_uuid"),
        F.unix_micros("reference_time"),
    )
    return ends.select(
        uuid.alias("uuid"),
        "group_id",
        "source_node_uuid",
        "target_node_uuid",
        "name",
        "fact",
        F.array("episode_uuid").alias("episodes"),
        F.col("reference_time").alias("created_at"),
        F.col("reference_time").alias("valid_at"),
    )


def build_graph(
    episodes: DataFrame,
    single_valued: list[str] | None = None,
    use_custom_entities: bool = True,
    hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Normalised episodes to episodes, entities, facts, mentions and failures.

    Of several episodes with one uuid the newest counts.  Contents are parsed
    once: everything below reads the staged result.
    """
    staged = cut_lineage(with_objects(newest_episodes(episodes)))
    good, failed = quarantine(staged)
    valid, rejected = validate_entities(extract_candidates(good, use_custom_entities))
    return {
        "episodes": good.drop("objects"),
        "entities": resolve_entities(valid.withColumnRenamed("reference_time", "created_at")),
        "facts": apply_facts(extract_facts(good, use_custom_entities), None, single_valued or [], hot_rows),
        "mentions": build_mentions(valid),
        "failed": failed,
        "rejected": rejected,
    }


def newest_episodes(episodes: DataFrame) -> DataFrame:
    """One row per uuid: the newest, ties to the greater name and content.  Null uuids all stay."""
    columns = [c for c in episodes.columns if c != "uuid"]
    newest = F.max_by(F.struct(*columns), F.struct("reference_time", "name", "content"))
    known = episodes.filter(F.col("uuid").isNotNull())
    one = known.groupBy("uuid").agg(newest.alias("_r")).select("uuid", "_r.*").select(*episodes.columns)
    return one.unionByName(episodes.filter(F.col("uuid").isNull()))
