"""A text index on disk, in segments.

Every batch of documents adds one segment: its postings in folders by a hash of
the term and sorted by term inside, its documents with their lengths, and what
it changes in the document frequencies and corpus statistics.  Documents that
come again, or are removed, are named as dead for all earlier segments; the
segment carries their counts with a minus sign, so frequencies and statistics
are sums over segments and no posting is read for them.  `compact_index` folds
the segments into one.

A segment counts once its row in the manifest is written, which is the last
step: a failed append leaves a folder that nobody reads.  One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.ordered import broadcast_if_small
from chronoweave.operators.text_index import TERM_BUCKET, TextIndex, build_index, document_lengths, term_bucket

_ID = ["kind", "doc_uuid"]


@dataclass
class StoredIndex:
    """The live rows of all segments; `documents` has (kind, group_id, doc_uuid, dl)."""

    index: TextIndex
    documents: DataFrame


def _manifest(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the segments in force, oldest first; compaction keeps them few."""
    try:
        rows = spark.read.schema("number long, folder string, replaces boolean").parquet(f"{path}/manifest").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    since = max((r["number"] for r in rows if r["replaces"]), default=0)
    return sorted((r["number"], r["folder"]) for r in rows if r["number"] >= since)


def _segments(spark: SparkSession, path: str, table: str, listed: list[tuple[int, str]]) -> DataFrame:
    """One table of all segments, with the segment's number."""
    whole = None
    for number, folder in listed:
        at = f"{path}/{folder}"
        stored = _read_postings(spark, at) if table == "postings" else spark.read.parquet(f"{at}/{table}")
        part = stored.withColumn("_segment", F.lit(number))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def _read_postings(spark: SparkSession, segment: str) -> DataFrame:
    """Postings of one segment; a segment without any has no file that could tell its columns."""
    id_type = spark.read.parquet(f"{segment}/documents").schema["doc_uuid"].dataType.simpleString()
    schema = f"kind string, group_id string, doc_uuid {id_type}, term string, tf long, dl long, {TERM_BUCKET} int"
    return spark.read.schema(schema).parquet(f"{segment}/postings")


def _live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows whose document is not named dead by a later segment."""
    last = broadcast_if_small(dead.groupBy(*_ID).agg(F.max("_segment").alias("_dead")))
    same = [rows[c].eqNullSafe(last[c]) for c in _ID]
    return rows.join(last, [*same, F.col("_segment") < F.col("_dead")], "left_anti").drop("_segment")


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index as of the last complete segment."""
    listed = _manifest(spark, path)
    if not listed:
        raise ValueError(f"no index at {path}")
    tables = {t: _segments(spark, path, t, listed) for t in ("postings", "documents", "dead", "terms", "stats")}
    terms = tables["terms"].groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    sums = tables["stats"].agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
    stats = sums.select("n_docs", F.when(F.col("n_docs") > 0, F.col("words") / F.col("n_docs")).alias("avgdl"))
    postings, documents = tables["postings"], tables["documents"]
    if len(listed) > 1:
        postings, documents = _live(postings, tables["dead"]), _live(documents, tables["dead"])
    else:
        postings, documents = postings.drop("_segment"), documents.drop("_segment")
    return StoredIndex(TextIndex(postings, terms, stats), documents)


def _write_segment(
    spark: SparkSession, path: str, number: int, postings: DataFrame, documents: DataFrame, dead: DataFrame,
    old: StoredIndex | None, replaces: bool = False,
) -> None:
    folder = f"segment-{number}-{uuid.uuid4().hex}"
    to = f"{path}/{folder}"
    bucketed = postings.withColumn(TERM_BUCKET, term_bucket(F.col("term")))
    bucketed = bucketed.hint("rebalance", TERM_BUCKET).sortWithinPartitions(TERM_BUCKET, "term")
    bucketed.write.option("partitionOverwriteMode", "static").partitionBy(TERM_BUCKET).parquet(f"{to}/postings")
    documents.write.parquet(f"{to}/documents")
    dead.select(*_ID).distinct().write.parquet(f"{to}/dead")
    added = _read_postings(spark, to).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lengths = spark.read.parquet(f"{to}/documents").select("dl", F.lit(1).alias("_n"))
    if old is not None:  # what the dead documents had counted
        gone = broadcast_if_small(spark.read.parquet(f"{to}/dead"))
        lost = [_of(t, gone) for t in (old.index.postings, old.documents)]
        added = added.unionByName(lost[0].groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
        lengths = lengths.unionByName(lost[1].select((-F.col("dl")).alias("dl"), F.lit(-1).alias("_n")))
    added.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{to}/terms")
    zero = F.lit(0).cast("long")
    sums = lengths.agg(F.coalesce(F.sum("_n"), zero).alias("n_docs"), F.coalesce(F.sum("dl"), zero).alias("words"))
    sums.write.parquet(f"{to}/stats")
    entry = spark.createDataFrame([(number, folder, replaces)], "number long, folder string, replaces boolean")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, [rows[c].eqNullSafe(ids[c]) for c in _ID], "left_semi")


def append_index(docs: DataFrame, path: str, id: str, text: Column, kind: str = "doc", group: str | None = None) -> None:
    """E1, incremental: one more segment.  A document that is there already is replaced."""
    spark = docs.sparkSession
    listed = _manifest(spark, path)
    postings = build_index(docs, id, text, kind, group).postings
    documents = document_lengths(docs, id, text, kind, group)
    old = read_index(spark, path) if listed else None
    number = listed[-1][0] + 1 if listed else 1
    _write_segment(spark, path, number, postings, documents, documents, old)


def remove_documents(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Documents (kind, doc_uuid) leave the index; unknown ones change nothing."""
    old = read_index(spark, path)
    nothing = F.lit(False)
    dead = _of(old.documents, broadcast_if_small(ids.select(*_ID).distinct()))
    postings = old.index.postings.drop(TERM_BUCKET).filter(nothing)
    _write_segment(spark, path, _manifest(spark, path)[-1][0] + 1, postings, old.documents.filter(nothing), dead, old)


def clear_index(spark: SparkSession, path: str, group_ids: list[str] | None = None) -> None:
    """G3 for the stored index: all documents, or those of the given groups, leave it; terms and statistics follow."""
    documents = read_index(spark, path).documents
    remove_documents(spark, path, documents if group_ids is None else documents.filter(F.col("group_id").isin(group_ids)))


def compact_index(spark: SparkSession, path: str) -> None:
    """Folds all segments into one.  Older folders stay for readers that still use them."""
    listed = _manifest(spark, path)
    old = read_index(spark, path)
    dead = old.documents.filter(F.lit(False))
    postings = old.index.postings.drop(TERM_BUCKET)
    _write_segment(spark, path, listed[-1][0] + 1, postings, old.documents, dead, None, replaces=True)
