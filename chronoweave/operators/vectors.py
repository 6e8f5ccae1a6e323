"""Cosine search, exact and by hyperplane signatures, and embedding columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.text import tokens
from chronoweave.operators.lookup import check_limit, top_k
from chronoweave.operators.text_index import SCORE_DIGITS

# Largest query block sent to the tasks: 4,000 vectors of 1,536 doubles are 49 MB.
QUERY_BLOCK = 4_000
_BLOCK_ROWS = 10_000
# Vectors that meet a block of queries in their buckets at once.
_PROBED_ROWS = 1_000
# Rows a bucket of the approximate search should have, and the planes near a query it may cross.
BUCKET_ROWS = 1_000
_CLOSE = 6


def _unit_rows(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows of the batch they came from."""
    fits = np.array([v is not None and len(v) == dim for v in vectors], dtype=bool)
    if not fits.any():
        return np.empty((0, dim)), np.empty(0, dtype=int)
    matrix = np.stack(vectors[fits].to_list()).astype(np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = norms > 0
    return matrix[usable] / norms[usable, None], np.flatnonzero(fits)[usable]


def _best(ids: np.ndarray, sims: np.ndarray, k: int, min_score: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query in the total order (score desc, id asc)."""
    if min_score is not None:
        keep = sims >= min_score
        ids, sims = ids[keep], sims[keep]
    if len(ids) > k:
        edge = np.partition(sims, len(sims) - k)[len(sims) - k]
        keep = sims >= edge  # ties at the edge stay until the ids decide
        ids, sims = ids[keep], sims[keep]
    order = np.lexsort((ids, -sims))[:k]
    return ids[order], sims[order]


def _score_block(
    query_ids: np.ndarray, unit_queries: np.ndarray, k: int, min_score: float | None
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task: one matrix product per batch, k best per query kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [
            (np.empty(0, dtype=object), np.empty(0)) for _ in query_ids
        ]
        for batch in batches:
            rows, at = _unit_rows(batch["embedding"], unit_queries.shape[1])
            if not len(rows):
                continue
            ids = batch["uuid"].to_numpy(dtype=object)[at]
            sims = np.round(unit_queries @ rows.T, SCORE_DIGITS)
            for q, (old_ids, old_sims) in enumerate(kept):
                new_ids, new_sims = _best(ids, sims[q], k, min_score)
                kept[q] = _best(np.concatenate([old_ids, new_ids]), np.concatenate([old_sims, new_sims]), k, None)
        for q, (ids, sims) in enumerate(kept):
            if len(ids):
                yield pd.DataFrame({"query_id": query_ids[q], "uuid": ids, "score": sims})

    return run


def _result_schema(vectors: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("uuid", vectors.schema["uuid"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def cosine_search(
    vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None
) -> DataFrame:
    """The k nearest vectors per query as (query_id, uuid, score, rank).

    `vectors` has (uuid, embedding), `queries` (query_id, embedding).  Null
    vectors, other sizes and zero vectors are no candidates.  Up to QUERY_BLOCK
    queries go to the tasks as one matrix and nothing but each task's k best
    per query is shuffled.  More queries are paired with the vectors block by
    block in a distributed way.
    """
    check_limit("k", k)
    vectors = vectors.select("uuid", "embedding").filter(F.col("embedding").isNotNull())
    queries = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    schema = _result_schema(vectors, queries)
    head = queries.limit(QUERY_BLOCK + 1).toPandas()  # the size check
    if len(head) <= QUERY_BLOCK:
        parts = []
        for dim in sorted({len(v) for v in head["embedding"]}):
            units, at = _unit_rows(head["embedding"], dim)
            if len(units):
                score = _score_block(head["query_id"].to_numpy()[at], units, k, min_score)
                parts.append(vectors.filter(F.size("embedding") == dim).mapInPandas(score, schema))
        best = _union(parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    else:
        best = _blockwise(vectors, queries, lambda ids, units: _score_block(ids, units, k, min_score), schema)
    return top_k(best, k, [F.desc("score")], ["uuid"], ["query_id"])


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _blockwise(
    vectors: DataFrame, queries: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], _Scorer], schema: T.StructType
) -> DataFrame:
    """Tiles of bounded size: every vector block meets every query block once.

    Blocks are drawn by hash, so their size does not depend on any key.
    """
    n_vec = -(-vectors.count() // _BLOCK_ROWS) or 1
    n_q = -(-queries.count() // QUERY_BLOCK) or 1

    def tile(df: DataFrame, mine: str, n_mine: int, id: str, other: str, n_other: int) -> DataFrame:
        last = F.lit(n_other - 1).cast("long")
        return df.withColumn(mine, F.pmod(F.xxhash64(id), F.lit(n_mine))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), last))
        )

    v = tile(vectors, "vb", n_vec, "uuid", "qb", n_q)
    q = tile(queries, "qb", n_q, "query_id", "vb", n_vec)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "uuid": [], "score": []})]
        for dim in {len(x) for x in right["embedding"]}:
            units, at = _unit_rows(right["embedding"], dim)
            if len(units):
                run = scorer(right["query_id"].to_numpy()[at], units)
                out.extend(run(iter([left])))
        return pd.concat([o for o in out if len(o)] or out, ignore_index=True)

    return v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(score, schema)


def cosine_search_ann(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    tables: int = 8,
    probes: int = 8,
    bits: int | None = None,
    seed: int = 42,
    min_score: float | None = None,
) -> DataFrame:
    """E3, approximate: only vectors that share a bucket with the query are scored.

    A bucket is the signs of a vector against `bits` random hyperplanes; there are
    `tables` of them, and of each a query looks into its own bucket and the
    `probes` it is nearest to, those across the planes it lies closest to.  `bits`
    follows from the row count, so that a bucket has about BUCKET_ROWS rows; a
    table of a few buckets is searched whole.  Every score is exact and no pair
    comes twice.  What is missed are neighbours that fall into other buckets in all
    tables: few where neighbours are close, many where all vectors are about
    equally far apart.

    Up to QUERY_BLOCK queries go to the tasks as one matrix with their buckets, and
    vectors are not shuffled; more queries meet the vectors in tiles of bounded
    size, of which only the pairs that share a bucket are scored.
    """
    check_limit("k", k)
    vectors = vectors.select("uuid", "embedding").filter(F.col("embedding").isNotNull())
    queries = queries.select("query_id", "embedding").filter(F.size("embedding") > 0)
    if bits is None:
        bits = max(0, round(np.log2(max(1, vectors.count()) / BUCKET_ROWS)))
    if bits == 0:
        return cosine_search(vectors, queries, k, min_score)
    schema = _result_schema(vectors, queries)
    head = queries.limit(QUERY_BLOCK + 1).toPandas()  # the size check
    if len(head) > QUERY_BLOCK:
        planes = _Planes(tables, bits, probes, seed)
        best = _blockwise(vectors, queries, lambda ids, units: _probe_block(ids, units, planes, k, min_score), schema)
    else:
        parts = []
        # every size of query vectors has planes of its own
        for dim in sorted({len(v) for v in head["embedding"]}):
            units, at = _unit_rows(head["embedding"], dim)
            if len(units):
                score = _probe_block(head["query_id"].to_numpy()[at], units, _Planes(tables, bits, probes, seed), k, min_score)
                parts.append(vectors.filter(F.size("embedding") == dim).mapInPandas(score, schema))
        best = _union(parts) if parts else vectors.sparkSession.createDataFrame([], schema)
    return top_k(best, k, [F.desc("score")], ["uuid"], ["query_id"])


@dataclass
class _Planes:
    """Hyperplanes of all tables, drawn anew from the seed wherever they are needed."""

    tables: int
    bits: int
    probes: int
    seed: int

    def sides(self, units: np.ndarray) -> np.ndarray:
        """Signed distances to the planes: (tables, rows, bits)."""
        planes = np.random.default_rng(self.seed).standard_normal((self.tables, units.shape[1], self.bits))
        return np.matmul(units[None], planes)

    def buckets(self, units: np.ndarray) -> np.ndarray:
        """(tables, rows)."""
        return (self.sides(units) > 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def probed(self, units: np.ndarray) -> np.ndarray:
        """(tables, rows, probes + 1): a query's own bucket and the nearest others, by the planes to be crossed."""
        sides = self.sides(units)
        own = (sides > 0) @ (1 << np.arange(self.bits, dtype=np.int64))
        # crossings of up to three of the closest planes, cheapest first
        close = np.argsort(np.abs(sides), axis=2)[:, :, :_CLOSE]
        margin = np.take_along_axis(np.abs(sides), close, axis=2) ** 2
        groups = [c for n in (1, 2, 3) for c in combinations(range(close.shape[2]), n)]
        cost = np.stack([margin[:, :, list(c)].sum(axis=2) for c in groups], axis=2)
        flips = np.stack([(1 << close[:, :, list(c)]).sum(axis=2) for c in groups], axis=2)
        cheapest = np.argsort(cost, axis=2, kind="stable")[:, :, : self.probes]
        others = own[:, :, None] ^ np.take_along_axis(flips, cheapest, axis=2)
        return np.concatenate([own[:, :, None], others], axis=2)


def _pairs(found: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Row * queries + query of every pair that shares a bucket in some table, once each."""
    n = sought.shape[1]
    seen = np.zeros(found.shape[1] * n, dtype=bool)
    for table in range(len(found)):
        keys = sought[table].ravel()
        order = np.argsort(keys, kind="stable")
        lo, hi = (np.searchsorted(keys[order], found[table], side) for side in ("left", "right"))
        count = hi - lo
        rows = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        seen[rows * n + order[at] // sought.shape[2]] = True
    return np.flatnonzero(seen)


def _probe_block(
    query_ids: np.ndarray, unit_queries: np.ndarray, planes: _Planes, k: int, min_score: float | None
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per _PROBED_ROWS vectors: exact scores of the pairs that share a bucket, k best per query kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sought = planes.probed(unit_queries)
        for batch in batches:
            whole, at = _unit_rows(batch["embedding"], unit_queries.shape[1])
            for first in range(0, len(whole), _PROBED_ROWS):
                units = whole[first : first + _PROBED_ROWS]
                ids = batch["uuid"].to_numpy(dtype=object)[at[first : first + _PROBED_ROWS]]
                rows, asked = np.divmod(_pairs(planes.buckets(units), sought), len(unit_queries))
                sims = np.empty(len(rows))
                for part in range(0, len(rows), _BLOCK_ROWS):
                    here = slice(part, part + _BLOCK_ROWS)
                    sims[here] = np.einsum("ij,ij->i", units[rows[here]], unit_queries[asked[here]])
                sims = np.round(sims, SCORE_DIGITS)
                if min_score is not None:
                    rows, asked, sims = (x[sims >= min_score] for x in (rows, asked, sims))
                if not len(rows):
                    continue
                # ties with a query's last place stay until the ids decide
                order = np.lexsort((-sims, asked))
                rows, asked, sims = rows[order], asked[order], sims[order]
                start = np.searchsorted(asked, np.arange(len(unit_queries)))
                size = np.bincount(asked, minlength=len(unit_queries))
                last = sims[np.where(size > 0, start + np.minimum(size, k) - 1, 0)]
                keep = sims >= last[asked]
                yield pd.DataFrame({"query_id": query_ids[asked[keep]], "uuid": ids[rows[keep]], "score": sims[keep]})

    return run


def _hash_embed(dim: int) -> Callable[[pd.Series], pd.Series]:
    def embed(hashes: pd.Series) -> pd.Series:
        # one scatter-add for the whole batch
        sizes = np.array([len(h) for h in hashes])
        flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes] or [np.empty(0, np.int64)])
        rows = np.repeat(np.arange(len(sizes)), sizes)
        signs = np.where(flat < 0, -1.0, 1.0)
        out = np.zeros((len(sizes), dim))
        np.add.at(out, (rows, flat % dim), signs)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list((out / np.where(norms > 0, norms, 1.0)).astype(np.float32)))

    return embed


def check_dim(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Fails the job on a vector whose size is not `dim`."""
    size_text = F.coalesce(F.size(column).cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit(f"expected vectors of size {dim}, got "), size_text))
    right_size = F.col(column).isNull() | (F.size(column) == dim)
    return df.withColumn(column, F.when(right_size, F.col(column)).otherwise(wrong.cast("array<float>")))


def embed_column(
    df: DataFrame, text: Column, dim: int, fn: Callable[[pd.Series], pd.Series] | None = None, out: str = "embedding"
) -> DataFrame:
    """adds a vector of size `dim`.

    Without `fn`: signed feature hash of the words, unit length.  Words are
    hashed on the JVM side; one pass, no shuffle.
    """
    if fn is not None:
        return with_embedder(df, text, fn, dim, out)
    embed = F.pandas_udf(_hash_embed(dim), T.ArrayType(T.FloatType()))
    hashes = F.transform(tokens(text), lambda t: F.xxhash64(t))
    return check_dim(df.withColumn(out, embed(hashes)), out, dim)


def with_embedder(
    df: DataFrame, text: Column, fn: Callable[[pd.Series], pd.Series], dim: int, out: str = "embedding"
) -> DataFrame:
    """K2: vectors from a caller's batch function (texts in, vectors out)."""
    embed = F.pandas_udf(lambda texts: fn(texts), T.ArrayType(T.FloatType()))
    return check_dim(df.withColumn(out, embed(text)), out, dim)
