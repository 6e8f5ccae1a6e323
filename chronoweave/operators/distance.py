"""E5: hop distance in the fact graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

_BROADCAST_ROWS = 200_000
# A node reached from a goal costs as much as so many reached from a centre.
_FAR_COST = 8


def _ends(facts: DataFrame) -> DataFrame:
    """(node, other): every fact from both of its ends."""
    a, b = F.col("source_node_uuid"), F.col("target_node_uuid")
    ends = F.array(F.struct(a.alias("node"), b.alias("other")), F.struct(b.alias("node"), a.alias("other")))
    return facts.filter(a != b).select(F.explode(ends).alias("e")).select("e.*")


def node_distance(facts: DataFrame, centers: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Least number of facts between each centre and each node within reach.

    `centers` has (center).  Returns (center, node, distance); nodes out of
    reach, or further than `max_hops` when given, are absent.  Runs one job per
    hop: the frontier is checkpointed, its size decides whether it is broadcast,
    and an empty one ends the search.  The facts are never shuffled for a frontier
    below the bound; above it the join is a shuffle join, which AQE splits at
    hub nodes.
    """
    edges = _ends(facts)
    zero = F.lit(0).cast("long").alias("distance")
    frontier = cut_lineage(centers.select("center", F.col("center").alias("node"), zero).distinct())
    reached, last_two = frontier, frontier
    hop = 0
    while (max_hops is None or hop < max_hops) and (n := frontier.count()):
        hop += 1
        here = frontier.select("center", "node")
        step = (
            edges.join(F.broadcast(here) if n <= _BROADCAST_ROWS else here, "node")
            .select("center", F.col("other").alias("node"))
            .distinct()
        )
        # facts are walked both ways, so a step leads at most one level back
        new = step.join(last_two, ["center", "node"], "left_anti")
        previous, frontier = frontier, cut_lineage(new.withColumn("distance", F.lit(hop).cast("long")))
        last_two = previous.unionByName(frontier)
        reached = reached.unionByName(frontier)
    return reached


class _Side:
    """One end of a search from both ends: nodes reached from each start, and how far it has gone."""

    def __init__(self, starts: DataFrame, start: str):
        self.start, self.radius = start, 0
        self.frontier = cut_lineage(starts.select(start, F.col(start).alias("node"), F.lit(0).cast("long").alias("d")).distinct())
        self.reached, self.last_two = self.frontier, self.frontier
        self.size = self.frontier.count()

    def expand(self, edges: DataFrame, pairs: DataFrame) -> None:
        """One hop further, from the starts that still have open pairs."""
        self.radius += 1
        here = self.frontier.join(pairs.select(self.start).distinct(), self.start, "left_semi").select(self.start, "node")
        step = edges.join(F.broadcast(here) if self.size <= _BROADCAST_ROWS else here, "node")
        new = step.select(self.start, F.col("other").alias("node")).distinct().join(self.last_two, [self.start, "node"], "left_anti")
        previous, self.frontier = self.frontier, cut_lineage(new.withColumn("d", F.lit(self.radius).cast("long")))
        self.last_two = previous.unionByName(self.frontier)
        self.reached = self.reached.unionByName(self.frontier)
        self.size = self.frontier.count()


def distances_to(facts: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(center, node, distance) of the given (center, node) pairs; null when there is no path.

    Searches from both ends, on the side with the cheaper frontier, and only from
    ends whose pairs are still open.  After r hops on one side and s on
    the other every path of at most r + s facts has met in the middle, so the
    first meeting gives the least distance.
    """
    edges = _ends(facts)
    open_ = cut_lineage(pairs.select("center", F.col("node").alias("goal")).distinct())
    everything = open_
    near, far = _Side(open_, "center"), _Side(open_, "goal")
    found, moved = None, None
    while True:
        # a pair that is still open can only meet in what was reached last
        of_near = near.frontier if moved is not far else near.reached
        of_far = far.frontier if moved is not near else far.reached
        # the goals' side first: few nodes each; then both columns of the centres' side
        met = open_.join(of_far.select("goal", "node", F.col("d").alias("d2")), "goal").join(
            of_near.select("center", "node", F.col("d").alias("d1")), ["center", "node"]
        )
        settled = cut_lineage(met.groupBy("center", "goal").agg(F.min(F.col("d1") + F.col("d2")).alias("distance")))
        found = settled if found is None else found.unionByName(settled)
        open_ = cut_lineage(open_.join(settled, ["center", "goal"], "left_anti"))
        hops = near.radius + far.radius
        if (max_hops is not None and hops >= max_hops) or near.size == 0 or far.size == 0 or open_.isEmpty():
            break
        # a step of the goals' side multiplies the pairs that meet, so it must be much the smaller one
        moved = far if far.size * _FAR_COST < near.size else near
        moved.expand(edges, open_)
    return everything.join(found, ["center", "goal"], "left").select("center", F.col("goal").alias("node"), "distance")
