"""layered deep merge of nested settings, as joins over leaf rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

EMPTY_OBJECT = "{}"


def _with_prefixes(df: DataFrame) -> DataFrame:
    """One row per strict prefix of the path, in `_prefix`."""
    lengths = F.sequence(F.lit(0), F.size("path") - 1)
    prefixes = F.transform(lengths, lambda n: F.slice("path", F.lit(1), n))
    return df.filter(F.size("path") > 0).withColumn("_prefix", F.explode(prefixes))


def deep_merge(rows: DataFrame) -> DataFrame:
    """Merges layers per key; the later layer wins.

    `rows` has (key, layer, path array<string>, value_json): one row per
    scalar, null or list, and one with value `{}` per empty object.  Returns the
    surviving leaves.  One aggregation, combined map-side, leaves one row per
    (key, path) with its latest leaf and the latest layer below it; it is
    checkpointed, since the joins that follow read it four times.  Both sides
    of them are unique per (key, path): the work does not grow with the layers.
    """
    is_marker = F.col("value_json") == EMPTY_OBJECT
    keys = F.col("key"), F.col("path"), F.col("layer")
    none = F.lit(None).cast(rows.schema["layer"].dataType)
    solid = F.when(F.coalesce(~is_marker, F.lit(True)), F.col("layer"))
    own = rows.select(*keys, "value_json", solid.alias("_solid"), none.alias("_below"), F.lit(True).alias("_leaf"))
    above = _with_prefixes(rows.select(*keys)).select(
        "key", F.col("_prefix").alias("path"), none.alias("layer"), F.lit(None).cast("string").alias("value_json"),
        none.alias("_solid"), F.col("layer").alias("_below"), F.lit(False).alias("_leaf"),
    )
    latest = F.when(F.col("_leaf"), F.struct("layer", "value_json"))
    paths = cut_lineage(
        own.unionByName(above)
        .groupBy("key", "path")
        .agg(F.max(latest).alias("_at"), F.max("_solid").alias("_solid"), F.max("_below").alias("_below"))
        .select("key", "path", "_at.*", "_solid", "_below", F.col("_at").isNotNull().alias("_leaf"))
    )
    leaves = paths.filter("_leaf")
    # paths that are both a leaf and a parent: the only ones that can hide others
    conflicts = leaves.filter(F.col("_solid").isNotNull() & F.col("_below").isNotNull()).select(
        "key", F.col("path").alias("_prefix"), F.col("_solid").alias("_above")
    )
    hidden = (
        _with_prefixes(leaves.select(*keys))
        .join(conflicts, ["key", "_prefix"])
        .filter(F.col("_above") > F.col("layer"))
        .select("key", "path")
        .distinct()
    )
    survivors = (
        leaves.filter(F.col("_below").isNull() | (F.col("_below") <= F.col("layer")))
        .join(hidden, ["key", "path"], "left_anti")
        .select("key", "path", "layer", "value_json")
    )
    # an empty object that got members is no leaf any more
    filled = _with_prefixes(survivors.select("key", "path")).select("key", F.col("_prefix").alias("path"))
    markers = survivors.filter(is_marker).join(filled, ["key", "path"], "left_anti")
    return survivors.filter(F.col("value_json").isNull() | ~is_marker).unionByName(markers)
