"""entity identity and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import normalized_name, stable_id
from chronoweave.operators.ordered import broadcast_if_small, tasks_for
from chronoweave.session import cut_lineage


def entity_id(group: str = "group_id", label: str = "label", name: str = "name") -> Column:
    """Same group, label and normalised name: same entity."""
    return stable_id(F.col(group), F.col(label), normalized_name(F.col(name)))


def resolve_entities(candidates: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """candidates and stored entities folded to one row per identity.

    `candidates` has (group_id, label, name, created_at, attributes).  The
    earliest row names the entity and gives its vector, labels are united, the
    latest value of each attribute wins.  The folds combine map-side, so an
    entity mentioned by a third of all rows sends one partial row per task.
    """
    if entities is None:
        return _fold_named(candidates)
    return _fold(_as_rows(candidates).unionByName(_stored(entities)))


def fold_into(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """F11, incremental: stored entities that the candidates name are folded with them, the others pass."""
    rows = _as_rows(candidates)
    touched = broadcast_if_small(rows.select("uuid").distinct())
    stored = _stored(entities)
    changed = _fold(stored.join(touched, "uuid", "left_semi").unionByName(rows))
    return entities.join(touched, "uuid", "left_anti").unionByName(changed, allowMissingColumns=True)


_ROW = ["uuid", "name", "labels", "group_id", "created_at", "attributes", "summary", "name_embedding"]


def _as_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        entity_id().alias("uuid"), "name", F.array("label").alias("labels"), "group_id", "created_at", "attributes",
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<float>").alias("name_embedding"),
    )


def _stored(entities: DataFrame) -> DataFrame:
    none = {"name_embedding": F.lit(None).cast("array<float>"), "summary": F.lit(None).cast("string")}
    return entities.withColumns({c: v for c, v in none.items() if c not in entities.columns}).select(*_ROW)


def _fold(rows: DataFrame) -> DataFrame:
    """One entity per uuid.

    One pass folds rows per (entity, attribute); what a row says of the entity
    itself stands beside its first attribute only.  A vector stays with the name
    it was made for.
    """
    itself = F.struct("created_at", "name", F.col("name_embedding").isNull().alias("bare"), "name_embedding")
    split = rows.select(
        "uuid", "created_at", itself.alias("_self"), "labels", "group_id", "summary",
        F.posexplode_outer("attributes").alias("_pos", "k", "v"),
    )
    head = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    value = F.struct("created_at", "v")
    folded = split.groupBy("uuid", "k").agg(
        F.max_by("v", F.when(F.col("_pos").isNotNull(), value)).alias("v"),
        F.min(F.when(head, F.col("_self"))).alias("_first"),
        F.collect_set(F.when(head, F.col("labels"))).alias("labels"),
        F.first("group_id").alias("group_id"),
        F.max(F.when(head, F.col("summary"))).alias("summary"),
    )
    pair = F.when(F.col("k").isNotNull(), F.struct("k", "v"))
    whole = folded.groupBy("uuid").agg(
        F.min("_first").alias("_first"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_set("labels"))))).alias("labels"),
        F.first("group_id").alias("group_id"),
        F.max("summary").alias("summary"),
        F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("attributes"),
    )
    return whole.select(
        "uuid",
        "_first.name",
        F.coalesce("summary", F.lit("")).alias("summary"),
        "labels",
        "group_id",
        "_first.created_at",
        "attributes",
        "_first.name_embedding",
    )


def _fold_named(candidates: DataFrame) -> DataFrame:
    """`_fold` of candidates alone: folded by what the id is made of.

    The id is a long hash that no compression shortens; it is made when all
    shuffles are over.
    """
    itself = [F.col("group_id"), F.col("label"), normalized_name(F.col("name")).alias("_same")]
    split = candidates.select(*itself, "created_at", "name", F.posexplode_outer("attributes").alias("_pos", "k", "v"))
    head = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    named = ["group_id", "label", "_same"]
    folded = split.groupBy(*named, "k").agg(
        F.max(F.when(F.col("_pos").isNotNull(), F.struct("created_at", "v"))).getField("v").alias("v"),
        F.min(F.when(head, F.struct("created_at", "name"))).alias("_first"),
    )
    pair = F.when(F.col("k").isNotNull(), F.struct("k", "v"))
    whole = folded.groupBy(*named).agg(
        F.min("_first").alias("_first"), F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("attributes")
    )
    return whole.select(
        stable_id(*[F.col(c) for c in named]).alias("uuid"),
        "_first.name",
        F.lit("").alias("summary"),
        F.array("label").alias("labels"),
        "group_id",
        "_first.created_at",
        "attributes",
        F.lit(None).cast("array<float>").alias("name_embedding"),
    )


def build_mentions(extracted: DataFrame, entities: DataFrame | None = None, episodes: int | None = None) -> DataFrame:
    """distinct (episode, entity) pairs; with `entities`, only of known ones.

    With the number of `episodes` the rows are dealt by episode to tasks of
    bounded size before they are made distinct.

    The id is computed from the row, so the pairs are made distinct before
    they meet the entities, and by what the id is made of, which is shorter.
    """
    named = extracted.select("episode_uuid", "group_id", "label", normalized_name(F.col("name")).alias("_same"))
    if episodes is not None:
        named = named.repartition(tasks_for(named, episodes), "episode_uuid")
    named = named.distinct()
    entity = stable_id(F.col("group_id"), F.col("label"), F.col("_same"))
    pairs = named.select("episode_uuid", entity.alias("entity_uuid"), "group_id")
    if entities is None:
        return pairs
    known = entities.select(F.col("uuid").alias("entity_uuid"))
    return pairs.join(known, "entity_uuid", "left_semi").select("episode_uuid", "entity_uuid", "group_id")


def merge_mentions(stored: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """Stored mentions without those of `replaced` episodes, and the new ones that are not there yet."""
    kept = stored.join(replaced.select(F.col("uuid").alias("episode_uuid")), "episode_uuid", "left_anti")
    touched = broadcast_if_small(new.select("episode_uuid").distinct())
    known = kept.join(touched, "episode_uuid", "left_semi")
    return kept.unionByName(new.join(known, ["episode_uuid", "entity_uuid"], "left_anti"))


def similar_names(entities: DataFrame) -> DataFrame:
    """Pairs (a, b) of entities of one group with a label in common, a < b, whose names differ by one edit.

    Two such names share the text left when one letter is taken out of either,
    so the pairs come from an equi-join on those texts.  Names are distinct per
    group and label, and those sharing a text differ only in the letter taken
    out and its place: a join group holds at most (length + 1) * alphabet names,
    however many entities there are.
    """
    names = entities.select(
        "uuid", "group_id", F.explode(F.array_distinct("labels")).alias("label"), normalized_name(F.col("name")).alias("_name")
    )
    shorter = F.transform(
        F.sequence(F.lit(1), F.length("_name")),
        lambda i: F.concat(F.substring("_name", F.lit(1), i - 1), F.substring("_name", i + 1, F.length("_name"))),
    )
    texts = F.array_distinct(F.concat(F.array("_name"), F.when(F.length("_name") > 0, shorter).otherwise(F.array())))
    keyed = names.select("*", F.explode(texts).alias("_text"))
    other = keyed.select("group_id", "label", "_text", F.col("uuid").alias("b"), F.col("_name").alias("_other"))
    return (
        keyed.withColumnRenamed("uuid", "a")
        .join(other, ["group_id", "label", "_text"])
        .filter((F.col("a") < F.col("b")) & (F.levenshtein("_name", "_other") <= 1))
        .select("a", "b")
        .distinct()
    )


def connected(pairs: DataFrame) -> DataFrame:
    """(uuid, root): the least id each id is linked to, directly or not.

    Every round takes the least root among the neighbours and then the root of
    that root, which halves the distance to go.  Labels are checkpointed.
    """
    links = cut_lineage(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(links.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "uuid"))
    while True:
        near = (
            links.join(labels, F.col("b") == F.col("uuid"))
            .groupBy("a")
            .agg(F.min("root").alias("_near"))
            .withColumnRenamed("a", "uuid")
        )
        step = labels.join(near, "uuid").select("uuid", F.least("root", "_near").alias("root"), F.col("root").alias("_old"))
        of_root = labels.select(F.col("uuid").alias("root"), F.col("root").alias("_up"))
        new = cut_lineage(
            step.join(of_root, "root", "left").select("uuid", F.least("root", "_up").alias("root"), "_old")
        )
        labels = new.select("uuid", "root")
        if new.filter(F.col("root") != F.col("_old")).isEmpty():
            return labels


def merge_similar(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F11, fuzzy pass: entities whose names are linked by single edits become one.

    Returns the merged entities and (uuid, root) for those that moved, to
    redirect facts and mentions.
    """
    roots = connected(similar_names(entities))
    rows = _stored(entities).join(roots, "uuid", "left").withColumn("uuid", F.coalesce("root", "uuid")).drop("root")
    return _fold(rows), roots.filter(F.col("uuid") != F.col("root"))
