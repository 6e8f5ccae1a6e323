"""One query per operator: (spark, sf_dir) -> DataFrame over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.time import iso_utc
from chronoweave.operators import episodes as E
from chronoweave.operators import extraction as X
from chronoweave.operators import facts as FA
from chronoweave.operators import lookup as L
from chronoweave.operators import maintenance as M
from chronoweave.operators import projection as P
from chronoweave.operators.distance import distances_to, node_distance
from chronoweave.operators.folds import lifecycle, lifecycle_events, ttl_cache
from chronoweave.operators.merge import deep_merge
from chronoweave.operators.plugins import with_extractor
from chronoweave.operators.ordered import HOT_ROWS
from chronoweave.operators.ranking import passthrough_rerank, rrf_fuse, with_reranker
from chronoweave.operators.resolution import build_mentions, merge_similar, resolve_entities
from chronoweave.operators.text_index import bm25_search, build_index
from chronoweave.operators.vectors import cosine_search, cosine_search_ann, embed_column, with_embedder
from chronoweave.plans.ingest import build_graph, extract_candidates
from chronoweave.plans.search import node_text, one_query, search_facts, search_nodes
from chronoweave.session import cut_lineage, scratch_path, spread
from chronoweave.sources.episodes import read_episodes, stream_episodes
from chronoweave.sources.index import append_index, clear_index, compact_index, read_index, remove_documents
from chronoweave.sources.graph import read_graph, write_graph
from chronoweave.streaming.ingest import dedup_episodes, materialize, quarantine_stream, stream_ingest
from chronoweave.streaming.keyed import lifecycle_stream, sequence_by_group, ttl_cache_stream
from workload.views import Views

NOW = "2025-01-01 00:00:00"
CACHE_TTL = 21_600
AS_OF, KNOWN = "2024-01-10 00:00:00", "2024-01-12 00:00:00"
REPORT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return fn


def at(text: str):
    return F.lit(text).cast("timestamp")


def iso(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: iso_utc(F.col(c)) for c in columns})


def pairs_text(column: str):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


# --- A
@query
def a1_read_episodes(v: Views) -> DataFrame:
    parts = []
    for fmt in ("json", "parquet"):
        path = scratch_path(v.spark, "raw")
        _arrive(v.json_ep().drop("created_at"), path, fmt)
        parts.append(read_episodes(v.spark, path, fmt).withColumn("fmt", F.lit(fmt)))
    return iso(parts[0].unionByName(parts[1]), "reference_time")


@query
def a2_normalize_episodes(v: Views) -> DataFrame:
    return iso(E.normalize_episodes(v.messy_ep(), now=at(NOW)), "reference_time", "created_at")


@query
def a3_graph_round_trip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "graph")
    good = v.json_ep()
    tables = {
        "episodes": good,
        "entities": v.ent(),
        "facts": v.edge(),
        "mentions": build_mentions(extract_candidates(good, False)),
        "postings": build_index(v.ent(), "uuid", node_text(), "node", "group_id").postings,
    }
    write_graph(tables, path, buckets=8)
    back = read_graph(v.spark, path, buckets=8)
    return (
        back["entities"].select(F.lit("entities").alias("kind"), "uuid", "group_id", F.col("name").alias("body"))
        .unionByName(back["facts"].select(F.lit("facts").alias("kind"), "uuid", "group_id", F.col("fact").alias("body")))
        .unionByName(back["episodes"].select(F.lit("episodes").alias("kind"), "uuid", "group_id", F.col("content").alias("body")))
        .unionByName(back["mentions"].select(F.lit("mentions").alias("kind"), F.col("episode_uuid").alias("uuid"), "group_id", F.lit("").alias("body")))
        .unionByName(back["postings"].select(F.lit("postings").alias("kind"), F.col("doc_uuid").alias("uuid"), "group_id", F.col("term").alias("body")))
    )


@query
def a4_queue_position(v: Views) -> DataFrame:
    return E.queue_position(v.json_ep()).select("uuid", "group_id", "position", "message")


@query
def a5_upsert(v: Views) -> DataFrame:
    columns = ["uuid", "name", "summary", "group_id"]
    large = v.t("part").filter(F.col("p_size") >= 45).select(
        F.col("p_partkey").cast("string").alias("uuid"), F.col("p_name").alias("name"),
        F.concat(F.lit("large "), F.col("p_type")).alias("summary"), F.col("p_brand").alias("group_id"),
    )
    new = v.ent().filter(F.array_contains("labels", "Supplier")).select(*columns)
    return M.upsert(v.node().select(*columns), large.unionByName(new))


@query
def a4_queue_position_hot(v: Views) -> DataFrame:
    """Every larger group cut into pieces."""
    return E.queue_position(v.json_ep(), hot_rows=20).select("uuid", "group_id", "position", "message")


@query
def a5_upsert_entities(v: Views) -> DataFrame:
    """Whole entity rows, with attributes and vectors; suppliers are renamed, twice."""
    suppliers = v.ent().filter(F.array_contains("labels", "Supplier"))
    renamed = [suppliers.withColumns({"name": F.concat(F.lit(f"{n} "), F.col("name")), "created_at": F.col("created_at") + F.expr(f"INTERVAL {n} DAYS")}) for n in (1, 2)]
    after = M.upsert(v.ent(), renamed[0].unionByName(renamed[1]), order=["created_at"])
    return iso(after, "created_at").select(
        "uuid", "name", "group_id", "created_at", F.array_join("labels", ",").alias("labels"),
        pairs_text("attributes").alias("attributes"), F.size("name_embedding").cast("long").alias("dim"),
    )


# --- B
@query
def b1_project_node_result(v: Views) -> DataFrame:
    return P.project_node_result(v.node()).withColumns(
        {"labels": F.array_join("labels", ","), "attributes": pairs_text("attributes")}
    )


@query
def b2_format_fact(v: Views) -> DataFrame:
    return P.format_fact(v.edge()).withColumns(
        {"episodes": F.array_join("episodes", ","), "attributes": pairs_text("attributes")}
    )


@query
def b3_episodes_to_json(v: Views) -> DataFrame:
    fields = ["name", "content", "source", "source_description", "group_id", "reference_time", "created_at"]
    rows = P.episodes_to_json(v.msg_ep())
    return rows.select("uuid", *[F.get_json_object("json", f"$.{f}").alias(f) for f in fields])


@query
def b4_iso_utc(v: Views) -> DataFrame:
    orders = v.t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), iso_utc(F.col("o_orderdate")).alias("iso"))
    events = v.t("events").select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), iso_utc(F.col("ts")).alias("iso"))
    return orders.unionByName(events)


@query
def b5_normalize_urls(v: Views) -> DataFrame:
    return P.normalize_urls(v.urls(), "url", "page_id")


_CLEAN = {
    "as_float": ("float", 0.5, False),
    "as_int": ("int", -1, False),
    "as_bool": ("bool", True, False),
    "as_text": ("str", "blank", True),
}


@query
def b6_clean_columns(v: Views) -> DataFrame:
    return P.clean_columns(v.strings(), _CLEAN)[0]


@query
def b6_fallback_counts(v: Views) -> DataFrame:
    return P.clean_columns(v.strings(), _CLEAN)[1]


# --- C
@query
def c1_filter_groups(v: Views) -> DataFrame:
    node = v.node().select("uuid", "group_id")
    wanted = v.t("nation").select(F.concat(F.lit("Brand#"), F.col("n_regionkey")).alias("group_id"))
    parts = {
        "named": L.filter_groups(node, ["Brand#2", "Brand#17"]),
        "all": L.filter_groups(node, []),
        "default": L.filter_groups(node, None, "Brand#3"),
        "joined": L.filter_groups(node, wanted),
    }
    whole = None
    for name, df in parts.items():
        df = df.select("uuid", "group_id", F.lit(name).alias("form"))
        whole = df if whole is None else whole.unionByName(df)
    return whole


@query
def c2_filter_label(v: Views) -> DataFrame:
    return L.filter_label(v.node(), "ECONOMY").select("uuid", "name", "group_id")


def _asked_facts(v: Views) -> DataFrame:
    """Every supplier's residence and home; only the home exists."""
    uuid = F.concat(F.lit("s:"), F.col("s_suppkey"))
    ends = F.array(F.concat(uuid, F.lit(">based_in")), F.concat(uuid, F.lit(">lives_in")))
    return v.t("supplier").select(F.explode(ends).alias("uuid"))


@query
def c3_get_facts(v: Views) -> DataFrame:
    found, missing = L.get_facts(v.edge(), _asked_facts(v))
    return found.select("uuid", "fact", "valid_at").unionByName(missing, allowMissingColumns=True)


@query
def c3_get_fact(v: Views) -> DataFrame:
    columns = ["uuid", "fact", "error"]
    return L.get_fact(v.edge(), "n:3>part_of").select(*columns).unionByName(
        L.get_fact(v.edge(), "n:3>unknown").select(*columns)
    )


@query
def c4_episodes_before(v: Views) -> DataFrame:
    return iso(L.episodes_before(v.json_ep(), at(AS_OF)), "reference_time").select("uuid", "group_id", "reference_time")


@query
def c5_check_membership(v: Views) -> DataFrame:
    part = v.t("part")
    kinds = part.select(F.col("p_type").alias("key"))
    asked = kinds.unionByName(part.select(F.col("p_brand").alias("key")))
    catalog = kinds.distinct().withColumn("position", F.col("key"))
    return L.check_membership(asked, catalog)


# --- D
@query
def d1_get_episodes(v: Views) -> DataFrame:
    return iso(L.get_episodes(v.json_ep(), "7", 10, at(AS_OF)), "reference_time").select("uuid", "group_id", "reference_time")


@query
def d2_get_episodes_by_group(v: Views) -> DataFrame:
    return iso(L.get_episodes_by_group(v.json_ep(), 10, at(AS_OF)), "reference_time").select(
        "uuid", "group_id", "reference_time", "position"
    )


@query
def d2_conversation_episodes(v: Views) -> DataFrame:
    """Conversations as episodes, the newest of each group, as JSON."""
    newest = L.get_episodes_by_group(E.normalize_episodes(v.msg_ep(), now=at(NOW)), 5, at(NOW))
    rows = P.episodes_to_json(newest.drop("position"))
    fields = ["group_id", "source", "content", "reference_time"]
    return rows.select("uuid", *[F.get_json_object("json", f"$.{f}").alias(f) for f in fields])


@query
def d3_top_k(v: Views) -> DataFrame:
    part = v.t("part").select("p_brand", F.col("p_partkey").cast("string").alias("uuid"), "p_retailprice")
    return L.top_k(part, 5, [F.desc("p_retailprice")], ["uuid"], ["p_brand"])


# --- E
def _doc_index(v: Views):
    docs = v.t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return build_index(docs, "doc_id", F.col("text"))


@query
def e1_postings(v: Views) -> DataFrame:
    return _doc_index(v).postings.select("doc_uuid", "term", "tf", "dl")


@query
def e1_terms(v: Views) -> DataFrame:
    return _doc_index(v).terms


@query
def e1_stats(v: Views) -> DataFrame:
    return _doc_index(v).stats.withColumn("avgdl", F.round("avgdl", 6))


def _stored_index(v: Views):
    """The documents in two segments: half of them come first with another text, a few are removed and come again."""
    docs = v.t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"), "text")
    path = scratch_path(v.spark, "index")
    early = docs.filter("n % 2 = 0").withColumn("text", F.concat(F.lit("early draft "), F.coalesce("text", F.lit(""))))
    append_index(early, path, "doc_id", F.col("text"))
    gone = early.filter("n % 10 = 0").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("doc_uuid"))
    remove_documents(v.spark, path, gone)
    append_index(docs, path, "doc_id", F.col("text"))
    return path


@query
def e1_segments(v: Views) -> DataFrame:
    """Frequencies as sums over segments equal those of the live documents."""
    return read_index(v.spark, _stored_index(v)).index.terms


@query
def e1_segments_stats(v: Views) -> DataFrame:
    return read_index(v.spark, _stored_index(v)).index.stats.withColumn("avgdl", F.round("avgdl", 6))


@query
def e2_bm25_search_stored(v: Views) -> DataFrame:
    """The same search over the segments on disk, compacted."""
    queries = v.t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    path = _stored_index(v)
    compact_index(v.spark, path)
    found = bm25_search(read_index(v.spark, path).index, queries, 10)
    return found.withColumn("score", F.round("score", 6))


@query
def g3_clear_index(v: Views) -> DataFrame:
    """Terms of a stored index after one group has left it."""
    path = scratch_path(v.spark, "index")
    append_index(v.ent(), path, "uuid", node_text(), "node", "group_id")
    clear_index(v.spark, path, ["customer"])
    return read_index(v.spark, path).index.terms


@query
def e2_bm25_search(v: Views) -> DataFrame:
    """Which documents contain the benchmark passages."""
    queries = v.t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25_search(_doc_index(v), queries, 10, in_place=True).withColumn("score", F.round("score", 6))


def _vectors(v: Views) -> DataFrame:
    return v.t("embeddings").select(F.col("vec_id").cast("string").alias("uuid"), "embedding")


@query
def e3_cosine_search(v: Views) -> DataFrame:
    found = cosine_search(_vectors(v), v.query(), 10, min_score=0.0)
    return found.withColumn("score", F.round("score", 6))


@query
def e3_cosine_search_ann(v: Views) -> DataFrame:
    """Small tables have one bucket and are searched whole."""
    return cosine_search_ann(_vectors(v), v.query(), 10, min_score=0.0).withColumn("score", F.round("score", 6))


@query
def e3_cosine_search_ann_scores(v: Views) -> DataFrame:
    """Buckets of eight planes, every vector divisible by 10 as a query: how many answers have their exact score."""
    vectors = _vectors(v)
    queries = vectors.filter(F.col("uuid").cast("long") % 10 == 0).select(F.col("uuid").cast("long").alias("query_id"), "embedding")
    found = cosine_search_ann(vectors, queries, 5, bits=8)
    a, b = vectors.select("uuid", F.col("embedding").alias("x")), queries.select("query_id", F.col("embedding").alias("y"))
    both = found.join(a, "uuid").join(b, "query_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    exact = dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    own = F.count_if((F.col("uuid").cast("long") == F.col("query_id")) & (F.col("rank") == 1))
    return both.groupBy("query_id").agg(own.alias("own_first"), F.count_if(F.abs(exact - F.col("score")) > 1e-6).alias("wrong"))


@query
def e4_rrf_fuse(v: Views) -> DataFrame:
    node = v.node()
    by_text = bm25_search(build_index(node, "uuid", node_text()), v.query(), 20)
    by_vector = cosine_search(node.select("uuid", F.col("name_embedding").alias("embedding")), v.query(), 20)
    return rrf_fuse([by_text, by_vector]).withColumn("rrf", F.round("rrf", 6))


@query
def e5_node_distance(v: Views) -> DataFrame:
    """From every nation, over all facts; nodes out of reach stay null."""
    ent = v.ent()
    centers = ent.filter(F.array_contains("labels", "Nation")).select(F.col("uuid").alias("center"))
    return node_distance(v.edge(), centers, 3)


@query
def e5_distances_to(v: Views) -> DataFrame:
    """From the nation after a customer's own to the customer; null without a path."""
    center = F.concat(F.lit("n:"), (F.col("c_nationkey") + 1) % 25)
    pairs = v.t("customer").select(center.alias("center"), F.concat(F.lit("c:"), F.col("c_custkey")).alias("node"))
    return distances_to(v.edge(), pairs)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("rrf", F.round("rrf", 6))


@query
def e6_search_nodes(v: Views) -> DataFrame:
    return _shown(search_nodes(v.node(), v.query(), group_ids=[])).select(
        "query_id", "rank", "rrf", "uuid", "name", "summary", "group_id", "created_at", F.array_join("labels", ",").alias("labels")
    )


@query
def e6_search_nodes_filtered(v: Views) -> DataFrame:
    found = search_nodes(v.node(), v.query(), group_ids=["Brand#2", "Brand#17", "Brand#4"], max_nodes=5, entity="ECONOMY")
    return _shown(found).select("query_id", "rank", "rrf", "uuid", "name", "group_id")


@query
def e6_search_nodes_default_group(v: Views) -> DataFrame:
    """Without groups a search stays in the default one."""
    found = search_nodes(v.node(), v.query(), default_group="Brand#3")
    return _shown(found).select("query_id", "rank", "rrf", "uuid", "name", "group_id")


def _centered(v: Views) -> DataFrame:
    """Per nation: its customers' segment words, its own vector, itself as the centre."""
    emb = v.t("embeddings").select(F.col("vec_id").alias("n_nationkey"), "embedding")
    return v.t("nation").join(emb, "n_nationkey").select(
        F.col("n_nationkey").cast("long").alias("query_id"),
        F.concat(F.lit("buys machinery supplier based in "), F.col("n_name")).alias("text"),
        "embedding",
        F.concat(F.lit("n:"), F.col("n_nationkey")).alias("center_node_uuid"),
    )


@query
def e6_search_nodes_centered(v: Views) -> DataFrame:
    found = search_nodes(v.ent(), _centered(v), group_ids=[], facts=v.edge())
    return _shown(found).select("query_id", "rank", "rrf", "distance", "uuid", "name")


@query
def e6_search_built_graph(v: Views) -> DataFrame:
    """A graph is searched as it was built: its entities bring no vectors, so all of them are embedded."""
    entities = cut_lineage(build_graph(_nested_ep(v), use_custom_entities=False)["entities"])
    text = one_query(v.spark, "automobile segment")
    built = search_nodes(entities, text, group_ids=[], max_nodes=10).select("uuid", "rank")
    bare = search_nodes(entities.drop("name_embedding"), text, group_ids=[], max_nodes=10).select("uuid", F.col("rank").alias("other"))
    return built.join(bare, "uuid", "full").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("rank") == F.col("other")).alias("same"))


@query
def e7_search_facts(v: Views) -> DataFrame:
    found = search_facts(v.edge(), _centered(v).drop("center_node_uuid"), group_ids=[])
    return _shown(found).select("query_id", "rank", "rrf", "uuid", "fact", "valid_at")


@query
def e7_search_facts_centered(v: Views) -> DataFrame:
    return _shown(search_facts(v.edge(), _centered(v), group_ids=[], max_facts=5)).select("query_id", "rank", "rrf", "distance", "uuid", "fact")


@query
def e8_passthrough_rerank(v: Views) -> DataFrame:
    rows = v.t("part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("rank"), F.col("p_name").alias("document"))
    return passthrough_rerank(rows, ["rank"])


# --- F
@query
def f1_split_turns(v: Views) -> DataFrame:
    return X.split_turns(v.msg_ep())


@query
def f2_json_entities(v: Views) -> DataFrame:
    return X.json_entities(spread(v.json_ep())).select(
        "episode_uuid", "group_id", "label", "name", "path", pairs_text("attributes").alias("attributes")
    )


def _nested_ep(v: Views) -> DataFrame:
    """Orders with their customer inside, as JSON episodes."""
    customer = v.t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    body = F.to_json(
        F.struct(
            F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("title")).alias("segment")).alias("customer"),
            F.array(
                F.struct(F.col("o_orderstatus").alias("id"), F.lit(1).alias("n")),
                F.struct(F.col("o_orderpriority").alias("id"), F.lit(None).cast("int").alias("n")),
            ).alias("marks"),
        )
    )
    return v.t("orders").join(customer, "o_custkey").select(
        F.concat(F.lit("o-"), F.col("o_orderkey")).alias("uuid"), F.lit("order").alias("name"), body.alias("content"),
        F.lit("json").alias("source"), F.lit("").alias("source_description"), F.col("o_orderstatus").alias("group_id"),
        F.col("o_orderdate").alias("reference_time"), F.col("o_orderdate").alias("created_at"),
    )


@query
def f2_json_entities_nested(v: Views) -> DataFrame:
    return X.json_entities(_nested_ep(v)).select(
        "episode_uuid", "group_id", "label", "name", "path", pairs_text("attributes").alias("attributes")
    )


@query
def f2_json_entities_deep(v: Views) -> DataFrame:
    return X.json_entities(v.deep_ep()).select("episode_uuid", "label", "name", "path", pairs_text("attributes").alias("attributes"))


@query
def f2_json_entities_deep40(v: Views) -> DataFrame:
    return X.json_entities(v.deep_ep("customer", 40)).select("episode_uuid", "label", "name", "path", pairs_text("attributes").alias("attributes"))


@query
def f3_json_relations(v: Views) -> DataFrame:
    return X.json_relations(_nested_ep(v)).select("episode_uuid", "source_name", "target_name", "name", "fact")


@query
def f4_extract_requirements(v: Views) -> DataFrame:
    return X.extract_requirements(v.text_ep()).select("episode_uuid", "project_name", "description", "priority")


@query
def f5_extract_preferences(v: Views) -> DataFrame:
    return X.extract_preferences(v.text_ep()).select("episode_uuid", "category", "description", "polarity")


@query
def f6_extract_procedures(v: Views) -> DataFrame:
    return X.extract_procedures(v.text_ep()).select("episode_uuid", "description", "trigger", "step", "action")


@query
def f7_typed_extract(v: Views) -> DataFrame:
    on = X.typed_extract(v.text_ep(), True).select("episode_uuid", "label", "name")
    return on.unionByName(X.typed_extract(v.text_ep(), False).select("episode_uuid", "label", "name"))


def _typed(episodes: DataFrame) -> DataFrame:
    return X.typed_extract(episodes).select("episode_uuid", "turn", "label", "name", pairs_text("attributes").alias("attributes"))


@query
def f7_chat_statements(v: Views) -> DataFrame:
    return _typed(v.chat_ep())


@query
def f7_line_statements(v: Views) -> DataFrame:
    return _typed(v.line_ep())


@query
def f8_validate_entities(v: Views) -> DataFrame:
    kind = F.col("event_type")
    rows = v.t("events").select(
        "event_id",
        F.when(kind == "purchase", "Preference").when(kind == "error", "Requirement").when(kind == "click", "Procedure")
        .otherwise("Unregistered").alias("label"),
        F.map_filter(
            F.create_map(F.lit("description"), F.when(F.col("value") >= 5, kind), F.lit("category"), F.when(F.col("value") < 20, F.lit("x"))),
            lambda _, x: x.isNotNull(),
        ).alias("attributes"),
    )
    valid, rejected = X.validate_entities(rows)
    return valid.select("event_id", "label", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("event_id", "label", "reason")
    )


@query
def f9_parse_structured(v: Views) -> DataFrame:
    return X.parse_structured(v.struct_ep(), "content", REPORT).select(
        "uuid", "status", F.col("parsed.name").alias("p_name"), F.col("parsed.type").alias("p_type"),
        F.col("parsed.confidence").alias("p_confidence"),
    )


@query
def f10_normalize_extracted(v: Views) -> DataFrame:
    return X.normalize_extracted(v.list_ep(), "content", ["uuid"])


def _seen_parts(v: Views) -> DataFrame:
    """Parts as entity candidates named with messy case and blanks."""
    messy = F.when(F.col("p_size") >= 25, F.concat(F.lit("  "), F.upper("p_name"))).otherwise(F.col("p_name"))
    return v.t("part").select(
        F.col("p_partkey").cast("string").alias("episode_uuid"), F.col("p_brand").alias("group_id"), F.col("p_type").alias("label"),
        messy.alias("name"), F.timestamp_seconds(F.col("p_partkey") * 60).alias("created_at"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.col("p_type"), F.col("p_partkey").cast("string")).alias("attributes"),
    )


@query
def f11_resolve_entities(v: Views) -> DataFrame:
    found = resolve_entities(_seen_parts(v))
    return iso(found, "created_at").select(
        "uuid", "name", F.array_join("labels", ",").alias("labels"), "group_id", "created_at", pairs_text("attributes").alias("attributes")
    )


@query
def f11_stored_labels(v: Views) -> DataFrame:
    """Stored entities keep their labels, vectors and summaries when seen again."""
    stored = resolve_entities(_seen_parts(v)).withColumns(
        {"labels": F.array(F.lit("Stored"), F.get("labels", F.lit(0))), "name_embedding": F.array(F.lit(0.5).cast("float")), "summary": F.lit("kept")}
    )
    again = _seen_parts(v).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    return resolve_entities(again, stored).select(
        "uuid", F.array_join("labels", ",").alias("labels"), "summary", F.size("name_embedding").cast("long").alias("dim")
    )


@query
def f11_merge_similar(v: Views) -> DataFrame:
    """Suppliers and customers, whose names are numbers, linked digit by digit."""
    people = v.ent().filter(F.array_contains("labels", "Customer") | F.array_contains("labels", "Supplier"))
    merged, moved = merge_similar(people)
    return moved.unionByName(merged.select("uuid", F.col("uuid").alias("root")))


@query
def f12_build_mentions(v: Views) -> DataFrame:
    lines = v.t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("episode_uuid"), F.col("l_partkey").cast("string").alias("k")
    )
    part = _seen_parts(v)
    rows = lines.join(part.withColumnRenamed("episode_uuid", "k").drop("k2"), "k").select(
        "episode_uuid", "group_id", "label", "name", "created_at", "attributes"
    )
    known = resolve_entities(part.filter(F.col("label") != "PROMO"))
    return build_mentions(rows, known)


@query
def f13_deep_merge(v: Views) -> DataFrame:
    return deep_merge(v.layers()).select("key", F.array_join("path", ".").alias("path"), "layer", "value_json")


@query
def f14_node_summary(v: Views) -> DataFrame:
    return FA.node_summary(v.ent(), v.edge(), 300)


@query
def f14_node_summary_full(v: Views) -> DataFrame:
    return FA.node_summary(v.ent(), v.edge())


_SINGLE = ["view", "purchase", "signup"]


@query
def f15_apply_facts(v: Views) -> DataFrame:
    applied = FA.apply_facts(v.fact(), None, _SINGLE)
    return iso(applied, "valid_at", "created_at", "invalid_at", "expired_at").drop("fact")


@query
def f15_apply_facts_hot(v: Views) -> DataFrame:
    applied = FA.apply_facts(v.fact(), None, _SINGLE, hot_rows=20)
    return iso(applied, "valid_at", "created_at", "invalid_at", "expired_at").drop("fact")


@query
def f15_provenance(v: Views) -> DataFrame:
    """A fact seen in several episodes names them all."""
    seen = v.fact().withColumn("episodes", F.array(F.col("uuid")))
    return FA.apply_facts(seen, None, []).select(
        "source_node_uuid", "name", "target_node_uuid", F.array_join("episodes", ",").alias("episodes")
    )


@query
def f15_sightings(v: Views) -> DataFrame:
    """Facts and the episodes they were seen in as rows."""
    seen = v.fact().withColumn("episodes", F.array(F.col("uuid")))
    facts = FA.apply_facts(seen, None, _SINGLE, unite_episodes=False)
    return FA.fact_sightings(seen, facts, _SINGLE).select("uuid", "episode_uuid")


@query
def f16_facts_as_of(v: Views) -> DataFrame:
    stored = FA.apply_facts(v.fact(), None, _SINGLE)
    return FA.facts_as_of(stored, at(AS_OF)).select("uuid", "source_node_uuid", "name", "target_node_uuid")


@query
def f16_facts_as_known(v: Views) -> DataFrame:
    stored = FA.apply_facts(v.fact(), None, _SINGLE)
    return FA.facts_as_of(stored, at(KNOWN), at(AS_OF), _SINGLE).select("uuid", "source_node_uuid", "name", "target_node_uuid")


@query
def f16_facts_as_of_keys(v: Views) -> DataFrame:
    """What each user last viewed before each purchase."""
    return _last_viewed(v, HOT_ROWS)


def _last_viewed(v: Views, hot_rows: int) -> DataFrame:
    facts = v.fact().filter(F.col("name") == "view").select("uuid", "source_node_uuid", "target_node_uuid", "valid_at")
    facts = facts.withColumn("invalid_at", F.col("valid_at") + F.expr("INTERVAL 2 DAYS"))
    probes = v.t("events").filter(F.col("event_type") == "purchase").select(
        F.col("user_id").cast("string").alias("source_node_uuid"), F.col("ts").alias("at"), "event_id"
    )
    found = FA.facts_as_of_keys(facts, probes, ["source_node_uuid"], hot_rows=hot_rows)
    return found.select("event_id", "source_node_uuid", F.col("found.uuid").alias("fact_uuid"), F.col("found.target_node_uuid").alias("target"))


@query
def f16_facts_as_of_keys_hot(v: Views) -> DataFrame:
    return _last_viewed(v, 20)


@query
def f17_embed_column(v: Views) -> DataFrame:
    docs = embed_column(v.t("documents").select("doc_id", "text"), F.col("text"), 64)
    norm = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return docs.select("doc_id", F.size("embedding").cast("long").alias("dim"), F.round(F.sqrt(norm), 3).alias("norm"))


# --- G
@query
def g1_delete_facts(v: Views) -> DataFrame:
    kept, unknown = M.delete_facts(v.edge(), _asked_facts(v))
    return kept.select("uuid", F.lit("kept").alias("state")).unionByName(unknown.select("uuid", F.lit("unknown").alias("state")))


@query
def g2_delete_episodes(v: Views) -> DataFrame:
    ep = v.json_ep()
    mentions = build_mentions(extract_candidates(ep, False), episodes=ep.count())
    gone = v.t("orders").select(F.concat(F.lit("ev-"), F.col("o_orderkey") + 5000).alias("uuid"))
    kept, kept_mentions, unknown = M.delete_episodes(ep, mentions, gone)
    return (
        kept.select("uuid", F.lit("episode").alias("state"))
        .unionByName(kept_mentions.select(F.col("episode_uuid").alias("uuid"), F.lit("mention").alias("state")))
        .unionByName(unknown.select("uuid", F.lit("unknown").alias("state")))
    )


@query
def g3_clear_graph(v: Views) -> DataFrame:
    tables = {"entities": v.ent(), "facts": v.edge(), "episodes": v.json_ep()}
    some = M.clear_graph(tables, ["customer", "based_in", "7"])
    none = M.clear_graph(tables)
    whole = None
    for form, cleared in (("some", some), ("all", none)):
        for name, df in cleared.items():
            n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(form).alias("form"), F.lit(name).alias("name"), "n")
            whole = n if whole is None else whole.unionByName(n)
    return whole


@query
def g4_graph_status(v: Views) -> DataFrame:
    ep = v.json_ep()
    valid = extract_candidates(cut_lineage(X.with_objects(spread(ep))), False)
    facts = FA.apply_facts(v.fact(), None, _SINGLE).withColumn("group_id", F.col("source_node_uuid"))
    tables = {
        "episodes": ep,
        "entities": resolve_entities(valid.withColumnRenamed("reference_time", "created_at")),
        "facts": facts,
        "mentions": build_mentions(valid),
    }
    return iso(M.graph_status(tables), "newest_episode")


@query
def g4_graph_status_ok(v: Views) -> DataFrame:
    """A graph built from nested episodes refers to nothing it does not hold."""
    return iso(M.graph_status(build_graph(_nested_ep(v), use_custom_entities=False)), "newest_episode")


# --- H
@query
def h1_messages_to_prompt(v: Views) -> DataFrame:
    return E.messages_to_prompt(v.t("conversations"))


@query
def h2_conversations_to_episodes(v: Views) -> DataFrame:
    return E.conversations_to_episodes(v.t("conversations"))


# --- J
# JSON keeps milliseconds unless told otherwise.
ARRIVAL_ROWS = 50_000
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _halves(df: DataFrame, at_column: str) -> list[DataFrame]:
    """The rows in two parts, the earlier ones first."""
    middle = df.agg(F.percentile_approx(F.unix_micros(at_column), 0.5)).first()[0]
    early = F.unix_micros(at_column) <= middle
    return [df.filter(early), df.filter(~early)]


def _arrive(df: DataFrame, inbox: str, fmt: str = "json") -> None:
    files = df.write.mode("append").format(fmt).option("timestampFormat", MICROS)
    if fmt != "parquet":  # a packed text file is one split, so files stay small
        files = files.option("compression", "gzip").option("maxRecordsPerFile", ARRIVAL_ROWS)
    files.save(inbox)


@query
def j1_stream_ingest(v: Views) -> DataFrame:
    """Episodes arriving in two parts, the second part twice: the graph of one batch."""
    ep = v.text_ep().unionByName(v.json_ep().withColumn("uuid", F.concat(F.lit("js-"), F.col("uuid")))).drop("created_at")
    inbox, halves = scratch_path(v.spark, "arrivals"), _halves(ep, "reference_time")
    out, ckpt = scratch_path(v.spark, "log"), scratch_path(v.spark, "ckpt")
    for half in [*halves, halves[1]]:
        _arrive(half, inbox)
        stream_ingest(v.spark, inbox, out, ckpt, now=at(NOW)).awaitTermination()
    graph = materialize(v.spark, out, ["requirement_of"])
    none = F.lit(None).cast("string")

    def rows(name: str, uuid: str, body: str, attributes=none, since=none, until=none) -> DataFrame:
        return graph[name].select(
            F.lit(name).alias("kind"), F.col(uuid).alias("uuid"), "group_id", F.col(body).alias("body"),
            attributes.alias("attributes"), since.alias("since"), until.alias("until"),
        )

    at_ = lambda c: iso_utc(F.col(c))
    return (
        rows("episodes", "uuid", "content", since=at_("reference_time"))
        .unionByName(rows("entities", "uuid", "name", pairs_text("attributes"), at_("created_at")))
        .unionByName(rows("facts", "uuid", "fact", since=at_("valid_at"), until=at_("invalid_at")))
        .unionByName(rows("mentions", "entity_uuid", "episode_uuid"))
    )


@query
def j1_replaced_episode(v: Views) -> DataFrame:
    """Every second episode comes again as a note without statements: nothing of its first text is left."""
    ep = v.text_ep().drop("created_at")
    again = ep.filter(F.regexp_extract("uuid", "[0-9]+", 0).cast("long") % 2 == 0).withColumn("content", F.lit("Nothing to say"))
    inbox, out, ckpt = (scratch_path(v.spark, x) for x in ("arrivals", "log", "ckpt"))
    for part in (ep, again):
        _arrive(part, inbox)
        stream_ingest(v.spark, inbox, out, ckpt, now=at(NOW)).awaitTermination()
    whole = materialize(v.spark, out)
    # the same from a graph stored after the first arrival
    stored = {n: cut_lineage(df) for n, df in materialize(v.spark, out, base=None, after=None, before=1).items()}
    later = materialize(v.spark, out, base=stored, after=0)
    parts = [
        g[name].select(F.lit(form).alias("form"), F.lit(name).alias("kind"), F.col(uuid).alias("uuid"), F.col(body).alias("body"))
        for form, g in (("whole", whole), ("later", later))
        for name, uuid, body in (("episodes", "uuid", "content"), ("mentions", "entity_uuid", "episode_uuid"), ("facts", "uuid", "fact"))
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


@query
def j2_sequence_by_group(v: Views) -> DataFrame:
    ep = v.json_ep().drop("created_at")
    inbox, halves = scratch_path(v.spark, "arrivals"), _halves(ep, "reference_time")
    out, ckpt = scratch_path(v.spark, "sequence"), scratch_path(v.spark, "ckpt")
    for half in halves:
        _arrive(half, inbox)
        sequence_by_group(stream_episodes(v.spark, inbox, "json"), out, ckpt).awaitTermination()
    return v.spark.read.parquet(f"{out}/rows").select("uuid", "group_id", "sequence")


@query
def j3_quarantine(v: Views) -> DataFrame:
    inbox, halves = scratch_path(v.spark, "arrivals"), _halves(v.struct_ep().drop("created_at"), "reference_time")
    out, ckpt = scratch_path(v.spark, "quarantine"), scratch_path(v.spark, "ckpt")
    for half in halves:
        _arrive(half, inbox)
        quarantine_stream(stream_episodes(v.spark, inbox, "json"), out, ckpt).awaitTermination()
    read = lambda name: v.spark.read.parquet(f"{out}/{name}")
    return read("ok").select("uuid", F.lit(None).cast("string").alias("error")).unionByName(read("failed").select("uuid", "error"))


@query
def j4_dedup_episodes(v: Views) -> DataFrame:
    """Lines of an order arrive as episodes of the same uuid; batch form."""
    rows = v.t("lineitem").select(
        F.concat(F.lit("o-"), F.col("l_orderkey")).alias("uuid"), F.col("l_shipdate").alias("reference_time")
    )
    return iso(dedup_episodes(rows), "reference_time")


@query
def j4_dedup_stream(v: Views) -> DataFrame:
    ep = v.json_ep().drop("created_at")
    inbox = scratch_path(v.spark, "arrivals")
    out, ckpt = scratch_path(v.spark, "dedup"), scratch_path(v.spark, "ckpt")
    for part in (ep, ep):
        _arrive(part, inbox)
    stream = dedup_episodes(stream_episodes(v.spark, inbox, "json"), "40 days")
    (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return v.spark.read.parquet(out).select("uuid", "group_id", "content")


@query
def j5_ttl_cache(v: Views) -> DataFrame:
    events = v.t("events").select("event_id", "user_id", "ts")
    return iso(ttl_cache(events, "user_id", "ts", "event_id", CACHE_TTL), "ts", "served_from")


@query
def j5_ttl_cache_hot(v: Views) -> DataFrame:
    """Every larger key solved by path doubling."""
    events = v.t("events").select("event_id", "user_id", "ts")
    return iso(ttl_cache(events, "user_id", "ts", "event_id", CACHE_TTL, hot_rows=20), "ts", "served_from")


@query
def j5_ttl_cache_stream(v: Views) -> DataFrame:
    events = v.t("events").select("event_id", "user_id", "ts")
    inbox, halves = scratch_path(v.spark, "arrivals"), _halves(events, "ts")
    out, ckpt = scratch_path(v.spark, "cache"), scratch_path(v.spark, "ckpt")
    for half in halves:
        _arrive(half, inbox, "parquet")
        stream = v.spark.readStream.schema(events.schema).parquet(inbox)
        ttl_cache_stream(stream, out, ckpt, "user_id", "ts", "event_id", CACHE_TTL).awaitTermination()
    return iso(v.spark.read.parquet(f"{out}/rows").drop("batch_id"), "ts", "served_from")


@query
def j6_lifecycle(v: Views) -> DataFrame:
    return iso(lifecycle(v.life(), ["user_id", "day"], NOW), "start_time", "completion_time")


@query
def j6_lifecycle_events(v: Views) -> DataFrame:
    return lifecycle_events(v.life(), ["user_id", "day"]).select("id", "event", "ignored")


@query
def j6_lifecycle_stream(v: Views) -> DataFrame:
    """The last state of every key after the events arrived in two parts."""
    life = v.life().withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "day")).drop("user_id", "day")
    inbox, halves = scratch_path(v.spark, "arrivals"), _halves(life, "ts")
    out, ckpt = scratch_path(v.spark, "life"), scratch_path(v.spark, "ckpt")
    for half in halves:
        _arrive(half, inbox, "parquet")
        stream = v.spark.readStream.schema(life.schema).parquet(inbox)
        lifecycle_stream(stream, out, ckpt, "key").awaitTermination()
    columns = ["state", "start_time", "completion_time", "error"]
    rows = v.spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("key").agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select("key", "r.*")
    return iso(last, "start_time", "completion_time")


# --- K
def _labels_by_length(batch: pd.DataFrame) -> pd.DataFrame:
    out = batch[["uuid"]].copy()
    out["label"] = ["Procedure" if c.startswith("First") else "Preference" for c in batch["content"]]
    out["attributes"] = [{"description": c} if c.startswith("First") else {} for c in batch["content"]]
    return out


@query
def k1_with_extractor(v: Views) -> DataFrame:
    valid, rejected = with_extractor(
        v.text_ep().select("uuid", "content"), _labels_by_length, "uuid string, label string, attributes map<string,string>"
    )
    return valid.select("uuid", "label", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("uuid", "label", "reason"))


def _letter_counts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: [float(len(s)), float(s.count("e")), float(s.count("\n"))])


@query
def k2_with_embedder(v: Views) -> DataFrame:
    docs = with_embedder(v.t("documents").select("doc_id", "text"), F.col("text"), _letter_counts, 3)
    value = lambda i: F.element_at("embedding", i).cast("double")
    return docs.select("doc_id", value(1).alias("x1"), value(2).alias("x2"), value(3).alias("x3"))


def _in_order(query_text: str, documents: list[str]) -> list[tuple[int, float]]:
    return [(i, round(1.0 - 0.01 * i, 9)) for i in range(len(documents))]


@query
def k3_with_reranker(v: Views) -> DataFrame:
    found = bm25_search(build_index(v.node(), "uuid", node_text()), v.query(), 10).drop("score")
    docs = v.node().select("uuid", node_text().alias("document"))
    rows = found.join(docs, "uuid").join(v.query().select("query_id", "text"), "query_id")
    return with_reranker(rows, _in_order).select("query_id", "uuid", "rank", "score")
