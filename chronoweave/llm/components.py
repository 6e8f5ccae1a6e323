"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

# Tables of (id, id) rows are broadcast up to this many rows (16 bytes each).
BROADCAST_ROWS = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """Broadcast behind a count; without it Spark joins by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def components(links: DataFrame) -> DataFrame:
    """(id, group): the least id that each linked id can reach over `links` (a, b).

    Every round maps each node to its least neighbour and puts the links between
    the images; what is one component stays one, and the links shrink until none
    is left.  Then the maps are followed from first to last.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        least = few(cut_lineage(both.groupBy("id").agg(F.least("id", F.min("to")).alias("group"))))
        maps.append(least)
        of_a = least.select(F.col("id").alias("a"), F.col("group").alias("x"))
        of_b = least.select(F.col("id").alias("b"), F.col("group").alias("y"))
        moved = edges.join(of_a, "a").join(of_b, "b").filter("x <> y")
        edges = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            break
    found = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("id").alias("group"), F.col("group").alias("_next"))
        found = found.join(step, "group", "left").select("id", F.coalesce("_next", "group").alias("group"))
    return cut_lineage(found) if len(maps) > 1 else found
