"""C and D: group and label filters, point lookups, recent episodes, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.ordered import broadcast_if_small, is_small, tasks_for
from chronoweave.operators.projection import format_fact
from chronoweave.schema import (
    AVAILABLE,
    BAD_GROUP,
    BAD_LIMIT,
    CHECK_SKIPPED,
    DEFAULT_GROUP,
    DEFAULT_LIMIT,
    FACT_ERROR,
    NO_MODELS,
    NOT_FOUND,
    SHOWN_MODELS,
)


def filter_groups(
    df: DataFrame,
    group_ids: list[str] | DataFrame | None = None,
    default_group: str | None = DEFAULT_GROUP,
) -> DataFrame:
    """Null means the default group; an empty list means every group."""
    if isinstance(group_ids, DataFrame):
        wanted = group_ids.select("group_id").distinct()
        return df.join(broadcast_if_small(wanted), "group_id", "left_semi")
    if group_ids is None:
        group_ids = [default_group] if default_group else []
    return df.filter(F.col("group_id").isin(list(group_ids))) if group_ids else df


def filter_label(entities: DataFrame, label: str = "") -> DataFrame:
    """Entities carrying the label; an empty label keeps all."""
    return entities.filter(F.array_contains("labels", label)) if label != "" else entities


def get_fact(facts: DataFrame, uuid: str) -> DataFrame:
    """C3, one fact: its formatted row, or one row with only `uuid` and `error`."""
    found = format_fact(facts.filter(F.col("uuid") == uuid)).withColumn("error", F.lit(None).cast("string"))
    error = F.lit(f"{FACT_ERROR}edge {uuid} not found")
    hits = found.agg(F.count(F.lit(1)).alias("_n"))
    missing = hits.filter(F.col("_n") == 0).select(F.lit(uuid).alias("uuid"), error.alias("error"))
    return found.unionByName(missing, allowMissingColumns=True)


def get_facts(facts: DataFrame, uuids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C3, many facts: the formatted rows, and the uuids that do not exist."""
    wanted, facts = meeting(uuids, facts)
    return format_fact(facts.join(wanted, "uuid", "left_semi")), unknown_ids(wanted, facts)


def meeting(ids: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct `ids` (uuid), and `table` as it is to be joined with them.

    Few ids are broadcast.  Many, and the table, are dealt by uuid to tasks of
    bounded size before anything is made distinct: a scan that makes millions
    of different ids distinct holds them all, and Spark, which takes a packed
    file for a small one, would broadcast them.
    """
    ids = ids.select("uuid")
    if is_small(ids):
        return F.broadcast(ids.distinct()), table
    n = tasks_for(table, max(table.count(), ids.count()))
    return ids.repartition(n, "uuid").distinct().hint("merge"), table.repartition(n, "uuid")


def unknown_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The `ids` (uuid) that `table` does not have.

    The ids found are looked up first, so that the join against them has two
    small sides and the table is not shuffled while the ids are few.
    """
    found = table.select("uuid").join(ids, "uuid", "left_semi").distinct()
    return ids.join(found, "uuid", "left_anti")


def episodes_before(episodes: DataFrame, reference_time: Column) -> DataFrame:
    """C4: episodes up to and including the given time."""
    return episodes.filter(F.col("reference_time") <= reference_time)


def check_membership(
    requests: DataFrame, catalog: DataFrame | None, key: str = "key", noun: str = "Model"
) -> DataFrame:
    """Is each requested key in the catalogue; if not, name its first five.

    `catalog` has the key column and `position`; a missing catalogue lets every
    request pass.
    """
    asked = requests.select(F.col(key).alias("key"))
    if catalog is None:
        return asked.select("key", F.lit(True).alias("available"), F.lit(CHECK_SKIPPED % noun).alias("message"))

    head = catalog.orderBy("position").limit(SHOWN_MODELS)  # as many as the message shows
    names = F.transform(F.sort_array(F.collect_list(F.struct("position", key))), lambda x: x[key])
    shown = head.agg(F.array_join(names, ", ").alias("_shown"))
    known = catalog.select(F.col(key).alias("key"), F.lit(True).alias("_known")).distinct()
    listed = F.when(F.col("_shown") == "", NO_MODELS).otherwise(F.col("_shown"))
    missing = F.format_string(NOT_FOUND, F.lit(noun), "key", listed)
    available = F.coalesce("_known", F.lit(False))
    # `known` has one row per key, so a hot requested key cannot multiply
    return (
        asked.join(known, "key", "left")
        .join(F.broadcast(shown))
        .select(
            "key",
            available.alias("available"),
            F.when(available, AVAILABLE % noun).otherwise(missing).alias("message"),
        )
    )


def check_limit(name: str, value: int) -> None:
    if value <= 0:
        raise ValueError(BAD_LIMIT % name)


def get_episodes(
    episodes: DataFrame,
    group_id: str | None = None,
    last_n: int = DEFAULT_LIMIT,
    reference_time: Column | None = None,
    default_group: str | None = DEFAULT_GROUP,
) -> DataFrame:
    """The newest episodes of one group, newest first."""
    check_limit("last_n", last_n)
    group = group_id if group_id is not None else default_group
    if not isinstance(group, str):
        raise ValueError(BAD_GROUP)
    bounded = episodes_before(episodes, F.current_timestamp() if reference_time is None else reference_time)
    return filter_groups(bounded, [group]).orderBy(F.desc("reference_time"), "uuid").limit(last_n)


def get_episodes_by_group(
    episodes: DataFrame, last_n: int = DEFAULT_LIMIT, reference_time: Column | None = None
) -> DataFrame:
    """The newest episodes of every group.

    The rank filter becomes a per-task group limit before the shuffle, so a hot
    group sends at most last_n rows per task.
    """
    check_limit("last_n", last_n)
    bounded = episodes_before(episodes, F.current_timestamp() if reference_time is None else reference_time)
    return top_k(bounded, last_n, [F.desc("reference_time")], ["uuid"], ["group_id"], rank="position")


def top_k(
    scored: DataFrame,
    k: int,
    by: list[Column],
    tie: list[str],
    keys: list[str] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """D3: the first k rows in a total order, per key when keys are given."""
    check_limit("k", k)
    if not keys:
        return scored.orderBy(*by, *tie).limit(k)
    order = W.partitionBy(*keys).orderBy(*by, *tie)
    return scored.withColumn(rank, F.row_number().over(order).cast("long")).filter(F.col(rank) <= k)
