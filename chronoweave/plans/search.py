"""Hybrid search over entities and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.distance import distances_to
from chronoweave.operators.lookup import check_limit, filter_groups, filter_label, top_k
from chronoweave.operators.ordered import is_small
from chronoweave.operators.projection import format_fact, project_node_result
from chronoweave.operators.ranking import by_distance_then_score, rrf_fuse
from chronoweave.operators.text_index import TextIndex, bm25_search, build_index
from chronoweave.operators.vectors import cosine_search, embed_column
from chronoweave.schema import DEFAULT_GROUP, DEFAULT_LIMIT
from chronoweave.session import cut_lineage

# Each method hands this many times the result size to the fusion.
CANDIDATES_PER_RESULT = 2
# Size of the vectors made here when the tables bring none.
EMBEDDING_SIZE = 64
_BROADCAST_HITS = 200_000


def one_query(spark: SparkSession, text: str, embedding: list[float] | None = None, center: str | None = None) -> DataFrame:
    """A single query as the one-row table the searches take; its text alone is enough."""
    row = spark.createDataFrame(
        [(0, text, embedding, center)],
        "query_id bigint, text string, embedding array<float>, center_node_uuid string",
    )
    return row if embedding is not None else row.drop("embedding")


def _embedded(df: DataFrame, text: Column, column: str) -> DataFrame:
    """`df` with vectors: its own, or those of the built-in embedder if no row brings one.

    A row without a vector among rows with some is no candidate: vectors of
    different embedders cannot be compared.
    """
    if column in df.columns and not df.filter(F.col(column).isNotNull()).select(column).isEmpty():
        return df
    return embed_column(df.drop(column), text, EMBEDDING_SIZE, out=column)


def node_text() -> Column:
    return F.concat_ws(" ", "name", "summary")


def _hybrid(
    index: TextIndex,
    vectors: DataFrame,
    queries: DataFrame,
    limit: int,
    groups: tuple[list[str] | None, str | None],
    per_result: int,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """BM25 and cosine candidates, fused: (query_id, uuid, rrf).

    Postings know their group, so groups are filtered without a join.
    """
    depth = per_result * limit
    words = None if index.words is None else filter_groups(index.words, *groups)
    in_groups = TextIndex(filter_groups(index.postings, *groups), index.terms, index.stats, words)
    by_text = bm25_search(in_groups, queries, depth, allowed, in_place=True)
    return rrf_fuse([by_text, cosine_search(vectors, queries, depth)])


def _few_hits(queries: DataFrame, limit: int, per_result: int) -> bool:
    """Whether all candidates of all queries fit a broadcast."""
    per_query = 2 * per_result * limit
    return is_small(queries.select("query_id"), _BROADCAST_HITS // per_query)


def _centers(queries: DataFrame) -> DataFrame | None:
    if "center_node_uuid" not in queries.columns:
        return None
    return queries.select("query_id", F.col("center_node_uuid").alias("center")).filter(F.col("center").isNotNull())


def _results(fused: DataFrame, source: DataFrame, few: bool, limit: int, ordered: list[Column]) -> DataFrame:
    hits = top_k(fused, limit, ordered, ["uuid"], ["query_id"])
    return (F.broadcast(hits) if few else hits).join(source, "uuid")


def search_nodes(
    entities: DataFrame,
    queries: DataFrame,
    group_ids: list[str] | None = None,
    max_nodes: int = DEFAULT_LIMIT,
    entity: str = "",
    facts: DataFrame | None = None,
    index: TextIndex | None = None,
    default_group: str | None = DEFAULT_GROUP,
    max_hops: int | None = None,
    candidates_per_result: int = CANDIDATES_PER_RESULT,
) -> DataFrame:
    """The best entities per query, as (query_id, rank, rrf, distance, node...).

    `queries` has (query_id, text) and may bring an embedding and a
    center_node_uuid; with a centre the candidates nearest to it in `facts` come
    first, those without a path last.  Missing vectors of queries and entities
    are made from their texts.  Without `group_ids` the default group is
    searched; an empty list means every group.
    """
    check_limit("max_nodes", max_nodes)
    groups = group_ids, default_group
    candidates = filter_label(filter_groups(entities, *groups), entity)
    allowed = candidates.select("uuid") if entity != "" else None
    queries = _embedded(queries, F.col("text"), "embedding")
    candidates = _embedded(candidates, node_text(), "name_embedding")
    few = _few_hits(queries, max_nodes, candidates_per_result)
    index = index or build_index(entities, "uuid", node_text(), kind="node", group="group_id")
    vectors = candidates.select("uuid", F.col("name_embedding").alias("embedding"))
    fused = _hybrid(index, vectors, queries, max_nodes, groups, candidates_per_result, allowed)

    centers = _centers(queries)
    if centers is not None and facts is not None:
        # only the candidates' distances are looked for
        fused = cut_lineage(fused)
        wanted = fused.select("query_id", F.col("uuid").alias("node")).join(centers, "query_id")
        near = wanted.join(distances_to(facts, wanted, max_hops), ["center", "node"])
        fused = fused.join(near.select("query_id", F.col("node").alias("uuid"), "distance"), ["query_id", "uuid"], "left")
        order = by_distance_then_score()
    else:
        fused = fused.withColumn("distance", F.lit(None).cast("long"))
        order = [F.desc("rrf")]
    nodes = project_node_result(entities)
    return _results(fused, nodes, few, max_nodes, order).select(
        "query_id", "rank", "rrf", "distance", *nodes.columns
    )


def search_facts(
    facts: DataFrame,
    queries: DataFrame,
    group_ids: list[str] | None = None,
    max_facts: int = DEFAULT_LIMIT,
    index: TextIndex | None = None,
    default_group: str | None = DEFAULT_GROUP,
    max_hops: int | None = None,
    candidates_per_result: int = CANDIDATES_PER_RESULT,
) -> DataFrame:
    """The best facts per query; around a centre, the nearest end counts.

    Groups and missing vectors as for search_nodes.
    """
    check_limit("max_facts", max_facts)
    groups = group_ids, default_group
    candidates = filter_groups(facts, *groups)
    queries = _embedded(queries, F.col("text"), "embedding")
    candidates = _embedded(candidates, F.col("fact"), "fact_embedding")
    few = _few_hits(queries, max_facts, candidates_per_result)
    index = index or build_index(facts, "uuid", F.col("fact"), kind="fact", group="group_id")
    vectors = candidates.select("uuid", F.col("fact_embedding").alias("embedding"))
    fused = _hybrid(index, vectors, queries, max_facts, groups, candidates_per_result)

    centers = _centers(queries)
    if centers is not None:
        fused = cut_lineage(fused)
        ends = facts.select("uuid", F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("node"))
        # candidates are few per query: they pick their facts' ends first
        pairs = fused.select("query_id", "uuid")
        wanted = cut_lineage((F.broadcast(pairs) if few else pairs).join(ends, "uuid").join(centers, "query_id"))
        near = distances_to(facts, wanted, max_hops)
        reach = wanted.join(near, ["center", "node"]).groupBy("query_id", "uuid").agg(F.min("distance").alias("distance"))
        fused = fused.join(reach, ["query_id", "uuid"], "left")
        order = by_distance_then_score()
    else:
        fused = fused.withColumn("distance", F.lit(None).cast("long"))
        order = [F.desc("rrf")]
    rows = format_fact(facts)
    return _results(fused, rows, few, max_facts, order).select(
        "query_id", "rank", "rrf", "distance", *rows.columns
    )
