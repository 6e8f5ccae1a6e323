"""Filter interaction audit over sorted posting lists.

Every document gets an id when its marks are read, and every part keeps, per
range of ids, one sorted list of failing ids for each filter and one of flagged
ids for each flag.  A range is worked on alone: the union of the filters that
come first is a galloping k-way merge (the longest list is the spine, the others
search through it and only what is missing is merged in), and what the next
filter removes is a galloping difference.  Only sizes leave a range; their sums
over the ranges answer for every order of the filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.components import few
from chronoweave.session import scratch_path

# The five filters and their bounds.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"
FLAGS = ("good", "toxic")

# Ids of one posting list at most: the memory of a range, whatever the size of a part.
RANGE = 65_536
SPREAD = 1024

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))


def failing(data: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails A, B, C and D."""
    words = data.split()  # at blank and U+0009 to U+000D, as bytes
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _CONTINUATION))
    return (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        100 * capitals > MOST_CAPITALS_PERCENT * points,
        len(data.translate(None, SYMBOLS)) < len(data),
    )


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, digests = [], []
        for text in batch.column(2):
            data = text.as_py() or b""
            marks.append(failing(data))
            digests.append(hashlib.sha256(data).digest()[:16])
        columns = [pa.array([m[k] for m in marks], pa.bool_()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *columns, pa.array(digests, pa.binary())], ["doc_id", "part", *FILTERS[:4], "digest"]
        )


def marked(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, A to E, good, toxic): what each document fails and how it is labelled.

    `docs` has (doc_id, text) and the column `part`; a null text is empty and a
    null part the empty string.  A document fails E if the same text has a smaller
    doc_id anywhere in the table; a null doc_id neither fails E nor makes another
    fail, and has no label.  `labels` has (doc_id, quality, toxic); a doc_id
    labelled repeatedly has every flag that one of its labels has.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "audit")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"
    slim.mapInArrow(_mark, schema).write.parquet(path)
    marks = spark.read.parquet(path)

    copied = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = few(copied.filter("first < last").select("digest", "first"))
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("salt")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # rows without a doc_id find no label; the salt keeps them out of one task
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0).cast("int")
    joined = marks.join(copied, "digest", "left").withColumn("salt", salt).join(few(flags), ["doc_id", "salt"], "left")
    no = F.lit(False)
    return joined.select(
        "part", *FILTERS[:4], F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), *[F.coalesce(f, no).alias(f) for f in FLAGS]
    )


def posting_lists(marks: DataFrame, filters: str = FILTERS, flags: tuple[str, ...] = FLAGS, width: int = RANGE) -> DataFrame:
    """(part, range, n_docs, and one sorted id list per filter and flag).

    `marks` has `part` and one boolean column per filter and flag, false for null.
    It is written first, so that every retry of a task sees the same ids.
    """
    path = scratch_path(marks.sparkSession, "postings")
    marks.write.parquet(path)
    rows = marks.sparkSession.read.parquet(path).withColumn("id", F.monotonically_increasing_id())
    listed = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("id")))).alias(c) for c in (*filters, *flags)]
    return rows.groupBy("part", F.floor(F.col("id") / width).alias("range")).agg(F.count(F.lit(1)).alias("n_docs"), *listed)


def absent(ids: np.ndarray, spine: np.ndarray) -> np.ndarray:
    """The ids that `spine` does not hold; both sorted.  Each search starts where the last one ended."""
    if not len(ids) or not len(spine):
        return ids
    at = np.searchsorted(spine, ids)
    return ids[spine[np.minimum(at, len(spine) - 1)] != ids]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """k-way merge of sorted lists without repetitions."""
    spine, *others = sorted(lists, key=len, reverse=True)
    missing = [m for x in others if len(m := absent(x, spine))]
    if not missing:
        return spine
    more = union(missing)
    return np.insert(spine, np.searchsorted(spine, more), more)


def _differences(batches: Iterator[pa.RecordBatch], filters: str, flags: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Per range, earlier filters and next filter: how many documents the next one removes, in all and per flag."""
    names = ["part", "before", "filter", "n_docs", "removed", *[f"{f}_lost" for f in flags]]
    befores = [c for k in range(len(filters)) for c in combinations(filters, k)]
    for batch in batches:
        rows = {n: [] for n in names}
        for r in range(batch.num_rows):
            lists = {c: batch.column(c)[r].values.to_numpy() for c in (*filters, *flags)}
            n_docs = batch.column("n_docs")[r].as_py()
            part = batch.column("part")[r].as_py()
            for before in befores:
                gone = union([lists[f] for f in before]) if before else np.zeros(0, np.int64)
                for f in filters:
                    if f in before:
                        continue
                    left = absent(lists[f], gone)
                    values = (part, "".join(before), f, n_docs, len(left), *[len(left) - len(absent(left, lists[x])) for x in flags])
                    for n, v in zip(names, values):
                        rows[n].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], pa.string() if n in names[:3] else pa.int64()) for n in names], names)


def removal_sizes(postings: DataFrame, filters: str = FILTERS, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """(part, before, filter, n_docs, removed, and `<flag>_lost`) for every set of earlier filters and every next one."""
    counts = ["n_docs", "removed", *[f"{f}_lost" for f in flags]]
    schema = "part string, before string, filter string, " + ", ".join(f"{c} long" for c in counts)
    found = postings.mapInArrow(partial(_differences, filters=filters, flags=flags), schema)
    return found.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in counts])


def audit_orders(sizes: DataFrame, filters: str = FILTERS, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """One row per part, order of the filters and step; see `audit_filters`."""
    spark = sizes.sparkSession
    steps = [("".join(o), k + 1, "".join(sorted(o[:k])), o[k]) for o in permutations(filters) for k in range(len(filters))]
    # bounded: the filters are a handful, so their orders are too
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before string, filter string"))
    applied = sizes.join(orders, ["before", "filter"])
    along = W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    everywhere = W.partitionBy("part", "filter")
    alone = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(everywhere)
    return applied.select(
        "part", "filter_order", "step",
        (F.col("n_docs") - F.sum("removed").over(along)).alias("kept"),
        "removed",
        (alone - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("step") == len(filters), F.col("removed"))).over(everywhere).alias("unique_fails"),
        *[f"{f}_lost" for f in flags],
        F.sum("removed").over(everywhere).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What each filter does in every order of the five, per part.

    Counts of documents within the part: `kept` after the step, `removed` by it,
    `redundant` (its filter fails them, an earlier one removed them),
    `unique_fails` (no other filter fails them), `good_lost` and `toxic_lost`
    among the removed, and `shapley`, what the filter removes in all orders
    together.  Nulls as in `marked`.  Repeated rows and doc_ids are documents of
    their own; equal texts under one doc_id do not fail E.  Texts of any length
    are read whole, one at a time.  An empty table has no parts and no rows.
    Other columns of both tables, whatever their names, are ignored.
    """
    return audit_orders(removal_sizes(posting_lists(marked(docs, labels, part))))
