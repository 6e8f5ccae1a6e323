"""The text index on disk: segments, dead documents, compaction, pruned scans."""

import pytest
from conftest import same
from pyspark.sql import functions as F

from chronoweave.operators.text_index import bm25_search, build_index, document_lengths
from chronoweave.sources import index as I

SCHEMA = "id string, grp string, text string"
FIRST = [("a", "x", "red fox red"), ("b", "x", "blue fox"), ("c", "y", "green"), ("d", "y", ""), ("e", None, None), (None, "x", "no id")]
SECOND = [("b", "y", "blue whale and fox"), ("f", "x", "fox"), ("c", "y", "")]


def add(spark, rows, path):
    I.append_index(spark.createDataFrame(rows, SCHEMA), path, "id", F.col("text"), group="grp")


def equals(spark, path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    want, got = build_index(docs, "id", F.col("text"), group="grp"), I.read_index(spark, path)
    same(want.postings, got.index.postings.drop("term_bucket"))
    same(want.terms, got.index.terms)
    same(document_lengths(docs, "id", F.col("text"), group="grp"), got.documents)
    n, total = len(rows), sum(len((r[2] or "").split()) for r in rows)
    stats = got.index.stats.collect()
    assert [tuple(r) for r in stats] == [(n, total / n if n else None)]


def test_segments_replace_remove_clear_and_compact(spark, tmp_path):
    path = str(tmp_path / "i")
    add(spark, FIRST, path)
    equals(spark, path, FIRST)
    add(spark, SECOND, path)
    now = [r for r in FIRST if r[0] not in ("b", "c")] + SECOND
    equals(spark, path, now)
    ids = spark.createDataFrame([("doc", "a"), ("doc", "unknown"), ("other", "f"), ("doc", "a")], "kind string, doc_uuid string")
    I.remove_documents(spark, path, ids)
    now = [r for r in now if r[0] != "a"]
    equals(spark, path, now)
    I.remove_documents(spark, path, ids)  # again: nothing is counted twice
    equals(spark, path, now)
    I.compact_index(spark, path)
    assert len(I._manifest(spark, path)) == 1
    equals(spark, path, now)
    add(spark, [("a", "x", "back again")], path)
    now = [*now, ("a", "x", "back again")]
    equals(spark, path, now)
    I.clear_index(spark, path, ["y"])
    now = [r for r in now if r[1] != "y"]
    equals(spark, path, now)
    I.clear_index(spark, path)
    equals(spark, path, [])


def test_unfinished_segments_do_not_count(spark, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError):
        I.read_index(spark, path)
    add(spark, FIRST, path)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{path}/segment-2-broken/postings")
    equals(spark, path, FIRST)


@pytest.mark.parametrize("by_name", [1000, 1])
def test_a_search_reads_the_folders_of_its_words(spark, tmp_path, monkeypatch, by_name):
    monkeypatch.setattr("chronoweave.operators.text_index.TERMS_BY_NAME", by_name)
    path = str(tmp_path / "i")
    rows = [(str(i), "x", f"word{i % 50} other{i % 7} fox") for i in range(300)]
    add(spark, rows[:200], path)
    add(spark, rows[150:], path)
    queries = spark.createDataFrame([(0, "word3 other2"), (1, "absent"), (2, "other5")], "query_id long, text string")
    stored = bm25_search(I.read_index(spark, path).index, queries, 5)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "PartitionFilters: [" in line and "term_bucket" in line.split("PartitionFilters: [")[1].split("]")[0]]
    assert filters
    want = bm25_search(build_index(spark.createDataFrame(rows, SCHEMA), "id", F.col("text"), group="grp"), queries, 5)
    same(want, stored)
