"""Fusing and re-ordering ranked lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.operators.ordered import HOT_ROWS, with_position
from chronoweave.operators.text_index import SCORE_DIGITS
from chronoweave.schema import RERANK_STEP, RERANK_TOP_SCORE

RRF_K = 60


def rrf_fuse(ranked_lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists of (query_id, uuid, rank)."""
    whole = ranked_lists[0].select("query_id", "uuid", "rank")
    for other in ranked_lists[1:]:
        whole = whole.unionByName(other.select("query_id", "uuid", "rank"))
    share = F.sum(1.0 / (F.lit(k) + F.col("rank")))
    return whole.groupBy("query_id", "uuid").agg(F.round(share, SCORE_DIGITS).alias("rrf"))


def passthrough_rerank(df: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keeps each query's order, with scores falling by a fixed step."""
    placed = with_position(df, ["query_id"], order, "_i", hot_rows)
    score = F.lit(RERANK_TOP_SCORE) - (F.col("_i") - 1) * F.lit(RERANK_STEP)
    return placed.withColumn("score", F.round(score, SCORE_DIGITS)).drop("_i")


def with_reranker(
    candidates: DataFrame,
    fn: Callable[[str, list[str]], list[tuple[int, float]]],
    query: str = "text",
    document: str = "document",
    order: str = "rank",
) -> DataFrame:
    """K3: a caller's reranker over each query's candidates.

    `fn(query, documents)` returns (index of the document, score) pairs.
    Candidates are a search's top k, so a query's group is small.
    """
    kept = [f for f in candidates.schema.fields if f.name != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable").reset_index(drop=True)
        scored = fn(group[query].iloc[0], group[document].tolist())
        out = group.iloc[[i for i, _ in scored]].copy()
        out["score"] = [float(s) for _, s in scored]
        return out[schema.names]

    return candidates.groupBy("query_id").applyInPandas(rerank, schema)


def by_distance_then_score(distance: str = "distance") -> list[Column]:
    """Order of results around a centre: nearest first, unreachable last."""
    return [F.asc_nulls_last(distance), F.desc("rrf")]
