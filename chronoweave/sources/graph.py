"""A3: graphs on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.schema import GRAPH_TABLES

BUCKETS = 64
_BUCKET = "group_bucket"


def group_bucket(group: Column, buckets: int = BUCKETS) -> Column:
    """Folder of a group: many small groups share one, names stay data."""
    return F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, buckets: int = BUCKETS, whole: bool = False) -> None:
    """One table, in folders by group bucket.

    `whole` replaces the table; otherwise only the buckets present in `df` are
    replaced.  The rebalance hint lets AQE merge small buckets into fewer files
    and split a bucket that holds a hot group over several tasks.
    """
    bucketed = df.withColumn(_BUCKET, group_bucket(F.col("group_id"), buckets))
    (
        bucketed.hint("rebalance", _BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(_BUCKET)
        .parquet(path)
    )


def write_graph(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """A3: the tables of a graph.  A graph read from `path` goes to a new path."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", buckets, whole=True)


def read_graph(
    spark: SparkSession, path: str, group_ids: list[str] | None = None, buckets: int = BUCKETS
) -> dict[str, DataFrame]:
    """A3: the stored tables; with groups, only their folders are read."""
    return {
        name: read_table(spark, f"{path}/{name}", schema, group_ids, buckets) for name, schema in GRAPH_TABLES.items()
    }


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    group_ids: list[str] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
    df = spark.read.schema(stored).parquet(path)
    if group_ids is not None:
        # constant folding turns the hashes into partition filters
        wanted = F.lit(False)
        for g in group_ids:
            wanted = wanted | (F.col(_BUCKET) == group_bucket(F.lit(g), buckets))
        df = df.filter(wanted & F.col("group_id").isin(list(group_ids)))
    return df.drop(_BUCKET)
