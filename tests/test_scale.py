"""Work that has to grow no faster than its input."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.operators.facts import apply_facts
from chronoweave.operators.maintenance import delete_episodes, delete_facts, graph_status
from chronoweave.operators import resolution as R
from chronoweave.operators.resolution import build_mentions, resolve_entities
from chronoweave.operators import extraction as X
from chronoweave.operators import text_index as I
from chronoweave.operators import vectors as VEC
from chronoweave.streaming import ingest
from tests.test_extraction import ep
from workload.views import Views

SMALL = "/root/testdata/sf0.001"


def test_deep_texts_are_walked_by_every_core(spark):
    for table in ("customer", "orders"):
        deep = Views(spark, SMALL).deep_ep(table)
        assert deep.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_walked_members_are_not_written_out_at_every_level(spark, table):
    content = '{"a": {"b": [[1, "{"], [[{"id": 7, "c": {}}]]], "d": [1, "x{"]}, "e": [], "f": [{"g": "\\\\"}]}'
    found = X.json_entities(ep(table, content, source="json"))
    assert sorted((r.path, r.name, sorted(r.attributes.items())) for r in found.collect()) == [
        ("$", "n", [("e", "[]")]),
        ("$.a", "$.a", [("d", '[1,"x{"]')]),
        ("$.a.b[1][0][0]", "7", [("id", "7")]),
        ("$.a.b[1][0][0].c", "$.a.b[1][0][0].c", []),
        ("$.f[0]", "$.f[0]", [("g", '"\\\\"')]),
    ]


def test_names_with_escapes(table):
    found = X.json_entities(ep(table, '{"name": "a\\"b\\\\c", "x": {"name": ""}, "y": {"title": "t\\u00e4"}}', source="json"))
    assert sorted(r.name for r in found.collect()) == ["", 'a"b\\c', "tä"]


def _batch(texts):
    words = pa.array([t.split() for t in texts], pa.list_(pa.string()))
    ids = pa.array([str(i) for i in range(len(texts))])
    return pa.RecordBatch.from_arrays([pa.array(["doc"] * len(texts)), pa.nulls(len(texts), pa.string()), ids, words], names=["kind", "group_id", "doc_uuid", "_words"])


def test_postings_of_a_large_batch_come_in_spans(monkeypatch):
    batch = _batch(["a b a", "", "b c d e f g h", "a"] * 25)
    whole = pa.Table.from_batches(I._count_words(iter([batch]))).to_pylist()
    monkeypatch.setattr(I, "WORDS_AT_ONCE", 10)
    spans = list(I._count_words(iter([batch])))
    assert len(spans) > 10 and max(s.num_rows for s in spans) <= 17
    key = lambda r: (r["doc_uuid"], r["term"])
    assert sorted(pa.Table.from_batches(spans).to_pylist(), key=key) == sorted(whole, key=key)


@pytest.mark.parametrize("k", [1, 3, 100])
def test_documents_scored_in_place_equal_the_joined_postings(spark, table, k):
    rng = np.random.default_rng(1)
    docs = [(str(i), "x", " ".join(rng.choice(list("abcdefg"), rng.integers(0, 9)))) for i in range(60)]
    index = I.build_index(table(docs, "id string, g string, text string"), "id", F.col("text"), group="g")
    queries = table([(1, "a b"), (2, "g"), (3, "nowhere"), (None, "b b c"), (5, "")], "query_id int, text string")
    joined = I.bm25_search(I.TextIndex(index.postings, index.terms, index.stats), queries, k)
    found = I.bm25_search(index, queries, k, in_place=True)
    rows = lambda df: sorted(((r.query_id, r.uuid, round(r.score, 8), r["rank"]) for r in df.collect()), key=repr)
    assert rows(found) == rows(joined) and found.schema == joined.schema
    # only the best rows of a task leave it: no sum over all (query, document) pairs
    assert "sum(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_many_approximate_queries_meet_in_tiles(table, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(str(i), [float(x) for x in rng.standard_normal(8).round(1)]) for i in range(120)]
    df = table(rows + rows[:1] + [("null", None), ("short", [1.0])], "uuid string, embedding array<float>")
    q = table([(int(i), v) for i, v in rows[::5]], "query_id int, embedding array<float>")
    found = lambda: sorted(map(tuple, VEC.cosine_search_ann(df, q, 3, tables=3, probes=2, bits=3).collect()))
    want = found()
    for name, n in (("QUERY_BLOCK", 7), ("_BLOCK_ROWS", 50), ("_PROBED_ROWS", 9)):
        monkeypatch.setattr(VEC, name, n)
    assert found() == want
    # no row per (pair, table): the tiles keep the best of their pairs only
    plan = VEC.cosine_search_ann(df, q, 3, tables=3, probes=2, bits=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan


def test_rows_of_one_id_are_one_document(table):
    docs = table([("a", "red fox"), ("a", "red"), ("b", "red red")], "id string, text string")
    index, q = I.build_index(docs, "id", F.col("text")), table([(1, "red fox")], "query_id int, text string")
    joined = I.bm25_search(index, q, 5).collect()
    assert sorted(I.bm25_search(index, q, 5, in_place=True).collect()) == sorted(joined) and len(joined) == 2


def _planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entities_and_facts_are_folded_in_one_pass(spark):
    candidates = spark.createDataFrame([("g", "L", "n", {"a": "1"})], "group_id string, label string, name string, attributes map<string,string>")
    candidates = candidates.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert "Join" not in _planned(resolve_entities(candidates))
    at = F.lit("2024-01-01").cast("timestamp")
    facts = spark.createDataFrame([("u", "g", "a", "b", "knows", ["e"])], "uuid string, group_id string, source_node_uuid string, target_node_uuid string, name string, episodes array<string>")
    facts = facts.withColumns({"fact": F.lit("f"), "created_at": at, "valid_at": at})
    assert "Join" not in _planned(apply_facts(facts, None, []))


def test_status_goes_through_derived_tables_once(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    episodes = spark.createDataFrame([("e", "g")], "uuid string, group_id string").withColumn("reference_time", at)
    entities = spark.createDataFrame([("a", "g")], "uuid string, group_id string")
    facts = spark.createDataFrame([("f", "g", "a", "b"), ("h", None, "a", "a")], "uuid string, group_id string, source_node_uuid string, target_node_uuid string").withColumn("invalid_at", at)
    mentions = spark.createDataFrame([("e", "a", "g"), ("e", "a", None)], "episode_uuid string, entity_uuid string, group_id string")
    status = graph_status({"episodes": episodes, "entities": entities, "facts": facts, "mentions": mentions})
    plan = _planned(status)
    assert "invalid_at" not in plan and "entity_uuid" not in plan
    got = sorted((r["group_id"] or "", r["facts"], r["active_facts"], r["mentions"], r["status"]) for r in status.collect())
    assert got == [("", 0, 0, 1, "ok"), ("", 1, 0, 0, "ok"), ("g", 1, 0, 1, "error")]


CANDIDATES = "episode_uuid string, group_id string, label string, name string, attributes map<string,string>, hour int"


def _candidates(table):
    rows = [
        ("e1", "g", "L", " Ann  Lee", {"a": "1", "b": "x"}, 1), ("e2", "g", "L", "ann lee", {"a": "2"}, 2), ("e2", "g", "L", "ANN LEE", {"a": "3"}, 2),
        ("e1", "g", "L", "Ann Lee", {}, None), ("e3", None, "L", "ann lee", None, 1), ("e3", "", "L", None, {"z": None}, 1),
        ("e3", "", None, "", {"z": "q"}, 1), ("e3", "", None, None, {"z": "r"}, 1), (None, "g", "M", "x", {"a": "1"}, 3),
    ]
    hour = F.make_interval(hours=F.col("hour"))
    return table(rows, CANDIDATES).withColumn("created_at", F.lit("2024-01-01").cast("timestamp") + hour).drop("hour")


def test_candidates_fold_alike_by_name_and_by_id(table):
    rows = _candidates(table)
    text = lambda df: sorted(map(repr, df.withColumn("attributes", F.sort_array(F.map_entries("attributes"))).collect()))
    by_name, by_id = resolve_entities(rows), R._fold(R._as_rows(rows))
    assert by_name.columns == by_id.columns and text(by_name) == text(by_id)
    pairs = rows.select("episode_uuid", R.entity_id().alias("entity_uuid"), "group_id").distinct()
    assert sorted(map(repr, build_mentions(rows).collect())) == sorted(map(repr, pairs.collect()))


def test_ids_are_made_when_shuffles_are_over(table):
    for df in (resolve_entities(_candidates(table)), build_mentions(_candidates(table))):
        keys = re.findall(r"Aggregate \[(.*?)\]", _planned(df))
        assert keys and not [k for k in keys if re.search(r"\b(entity_)?uuid#", k)]


def test_the_last_arrivals_are_dealt_by_uuid_alone(spark, table):
    rows = table([("a", 0), ("a", 1), ("b", 0), ("b", 0)], "uuid string, batch_id long")
    last = ingest._last_batches({"episodes": rows, "failed": rows.limit(0)})
    current = ingest._current(rows.withColumn("x", F.lit(1)), last, "uuid")
    assert sorted(map(tuple, current.collect())) == [("a", 1), ("b", 1), ("b", 1)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # what is made distinct afterwards is where it has to be
        plan = current.distinct()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not [x for x in dealt if not re.fullmatch(r"uuid#\d+|_u#\d+", x)]


def test_many_ids_are_neither_broadcast_nor_held_by_a_scan(spark, table):
    many = spark.range(150_000).select(F.concat(F.lit("e"), F.col("id") % 149_000 + 5).alias("uuid"))
    rows = table([("e1",), ("e7",), ("e7",), (None,)], "uuid string")
    mentions = table([("e1", "x"), ("e7", "y")], "episode_uuid string, entity_uuid string")
    kept, kept_mentions, unknown = delete_episodes(rows, mentions, many)
    assert sorted(str(r.uuid) for r in kept.collect()) == ["None", "e1"] and kept_mentions.collect() == [("e1", "x")]
    assert unknown.count() == 148_999 and unknown.filter("uuid IN ('e1', 'e7')").isEmpty()
    few = many.filter("uuid < 'e2'").limit(10).unionByName(rows.filter("uuid = 'e7'"))
    assert delete_facts(rows, few)[0].count() == 2
    for df in (kept, kept_mentions, unknown, delete_facts(rows, many)[1]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Exchange hashpartitioning") :]
        assert "Broadcast" not in plan and "HashAggregate" not in below[below.rindex("Exchange") :]


def test_mentions_of_counted_episodes_are_dealt_before_they_are_made_distinct(table):
    rows = _candidates(table)
    dealt = build_mentions(rows, episodes=1_000_000_000)
    assert "RepartitionByExpression" in _planned(dealt) and ", 4000" in _planned(dealt)
    assert sorted(map(repr, build_mentions(rows, episodes=9).collect())) == sorted(map(repr, build_mentions(rows).collect()))
