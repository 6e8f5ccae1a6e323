"""Exact top-k inner products through a bit-sliced index.

Components are whole numbers, floor(256 * x).  A block of rows is indexed as
bitmaps: one per dimension and bit of the component's upper SLICES bits, over
the rows of the block.  For a query the slices are weighed by the bits of its
own components and added with carry-save adders, so the sum of every row comes
out as bitmaps too.  The k best sums are found from the most significant slice
down.  What the dropped low bits can change is bounded per query; all rows
within that bound of the k-th sum are boundary rows, and their products are
computed exactly.

Queries are taken in blocks of QUERY_BLOCK; each block is one narrow pass over
the vectors, which are not shuffled.  Only k rows per query and task are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
ROW_BLOCK = 1 << 16
SLICES = 7
QUERY_BITS = 8
# words of one bitmap array in work: small enough for the processor's cache
WORK_WORDS = 4096

_RESULT = "query_id long, vec_id long, score long"


def _quantised(values: pa.Array, scale: int) -> np.ndarray:
    return np.floor(np.asarray(values).astype(np.float64) * scale)


def vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number matrix) per vector length; null or non-finite vectors are left out."""
    ids, lists = batch.column(0), batch.column(1)
    lengths = np.array(lists.value_lengths().fill_null(-1))
    whole = lists.flatten()
    offsets = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))
    flat = _quantised(whole.cast(pa.float64()).fill_null(np.nan), scale)
    known = ~np.array(ids.is_null())
    keys = np.array(ids.fill_null(0)).astype(np.int64)
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero((lengths == n) & known)
        rows = flat[offsets[at][:, None] + np.arange(n)]
        fine = np.isfinite(rows).all(axis=1)
        yield keys[at[fine]], rows[fine].astype(np.int64)


class SlicedBlock:
    """Bitmaps of a block of rows: slices[d, b] has bit b of dimension d's upper bits."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.low = int(rows.min())
        self.range = int(rows.max()) - self.low
        self.shift = max(0, self.range.bit_length() - SLICES)
        codes = (rows - self.low) >> self.shift
        self.bits = max(1, int(codes.max()).bit_length())
        words = -(-len(ids) // 64)
        padded = np.zeros((rows.shape[1], self.bits, words * 64), np.uint8)
        for b in range(self.bits):
            padded[:, b, : len(ids)] = ((codes >> b) & 1).T
        self.slices = np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)
        self.live = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)


class _Sum:
    """Carry-save sum of weighted bitmaps: at most two bitmaps wait at each weight."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[np.ndarray]] = {}

    def add(self, weight: int, bitmap: np.ndarray) -> None:
        while True:
            held = self.waiting.setdefault(weight, [])
            if len(held) < 2:
                held.append(bitmap)
                return
            a, b = held.pop(), held.pop()
            half = a ^ b
            carry = (a & b) | (half & bitmap)
            held.append(half ^ bitmap)
            weight, bitmap = weight + 1, carry

    def slices(self) -> list[np.ndarray]:
        """The sum's bitmaps from the least significant on."""
        out: list[np.ndarray] = []
        weight = 0
        carry = None
        while weight <= max(self.waiting, default=-1) or carry is not None:
            parts = self.waiting.get(weight, []) + ([carry] if carry is not None else [])
            carry = None
            if not parts:
                out.append(None)
            elif len(parts) == 1:
                out.append(parts[0])
            elif len(parts) == 2:
                out.append(parts[0] ^ parts[1])
                carry = parts[0] & parts[1]
            else:
                half = parts[0] ^ parts[1]
                out.append(half ^ parts[2])
                carry = (parts[0] & parts[1]) | (half & parts[2])
            weight += 1
        like = next(x for x in out if x is not None)
        return [np.zeros_like(like) if x is None else x for x in out]


def _kth_value(sums: list[np.ndarray], live: np.ndarray, k: int) -> list[int]:
    """k-th largest sum of each query, from the most significant slice down; the least if there are fewer."""
    queries = sums[0].shape[0]
    tied = np.broadcast_to(live, sums[0].shape).copy()
    need = np.minimum(k, np.bitwise_count(tied).sum(axis=1, dtype=np.int64))
    value = [0] * queries
    for b in range(len(sums) - 1, -1, -1):
        ones = tied & sums[b]
        count = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        enough = count >= need
        tied = np.where(enough[:, None], ones, tied & ~sums[b])
        need = np.where(enough, need, need - count)
        for q in np.flatnonzero(enough):
            value[q] |= 1 << b
    return value


def _at_least(sums: list[np.ndarray], live: np.ndarray, bound: list[int]) -> np.ndarray:
    """Bitmap per query of the rows whose sum is at least the query's bound."""
    above = np.zeros_like(sums[0])
    equal = np.broadcast_to(live, sums[0].shape).copy()
    top = len(sums)
    for b in range(top - 1, -1, -1):
        wanted = np.array([np.uint64(0xFFFFFFFFFFFFFFFF) if x >> b & 1 else np.uint64(0) for x in bound])[:, None]
        above |= equal & sums[b] & ~wanted
        equal &= ~(sums[b] ^ wanted)
    return above | equal


def _without_own(block: SlicedBlock, query_ids: np.ndarray) -> np.ndarray:
    """Bitmap per query of the rows that do not bear the query's id."""
    order = np.argsort(block.ids, kind="stable")
    lo, hi = (np.searchsorted(block.ids, query_ids, side, sorter=order) for side in ("left", "right"))
    live = np.repeat(block.live[None, :], len(query_ids), axis=0)
    for q in np.flatnonzero(lo < hi):
        own = order[lo[q] : hi[q]].astype(np.uint64)
        np.bitwise_and.at(live[q], (own >> np.uint64(6)).astype(np.int64), ~(np.uint64(1) << (own & np.uint64(63))))
    return live


def candidates(block: SlicedBlock, queries: np.ndarray, k: int, query_ids: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows of the block) such that the k best rows are among them.

    With query_ids, the k best are those of the rows without the query's own id, however often it occurs.
    """
    n, words = len(block.ids), block.live.shape[0]
    step = max(1, WORK_WORDS // words)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for lo in range(0, len(queries), step):
        part = queries[lo : lo + step]
        size = np.abs(part)
        drop = max(0, int(size.max()).bit_length() - QUERY_BITS)
        weight = size >> drop
        bits = int(weight.max()).bit_length()
        negative = part < 0
        total = _Sum()
        for d in range(part.shape[1]):
            flip = np.where(negative[:, d], ones, np.uint64(0))[:, None]
            chosen = [np.where(weight[:, d] >> p & 1, ones, np.uint64(0))[:, None] for p in range(bits)]
            used = [p for p in range(bits) if chosen[p].any()]
            for b in range(block.bits):
                signed = block.slices[d, b][None, :] ^ flip
                for p in used:
                    total.add(b + p, signed & chosen[p])
        if not total.waiting:  # queries of zeros only: every row has the same product
            for q in range(len(part)):
                yield lo + q, np.arange(n)
            continue
        sums = total.slices()
        # what the dropped bits of row and query add at most, in units of the sum
        slack = (weight << drop).sum(axis=1) * ((1 << block.shift) - 1) + (size - (weight << drop)).sum(axis=1) * block.range
        unit = 1 << (block.shift + drop)
        live = block.live if query_ids is None else _without_own(block, query_ids[lo : lo + step])
        kth = _kth_value(sums, live, k)
        bound = [max(0, v - -(-int(s) // unit)) for v, s in zip(kth, slack, strict=True)]
        near = _at_least(sums, live, bound)
        for q in range(len(part)):
            yield lo + q, np.flatnonzero(np.unpackbits(near[q].view(np.uint8), bitorder="little")[:n])


def best_rows(block: SlicedBlock, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, exact scores) of the block's k best rows, without the query's own."""
    exact = block.rows.astype(np.float64) if _fits(block, queries) else block.rows
    for q, at in candidates(block, queries, k, query_ids):
        scores = (exact[at] @ queries[q].astype(exact.dtype)).astype(np.int64)
        ids = block.ids[at]
        other = ids != query_ids[q]
        ids, scores = ids[other], scores[other]
        order = np.lexsort((ids, -scores))[:k]
        yield int(query_ids[q]), ids[order], scores[order]


def _fits(block: SlicedBlock, queries: np.ndarray) -> bool:
    """Whether products in doubles are exact."""
    largest = max(abs(block.low), abs(block.low + block.range)) * int(np.abs(queries).max(initial=0)) * queries.shape[1]
    return largest < 1 << 53


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[SlicedBlock]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for ids, rows in vectors(batch, scale):
            if not len(ids):
                continue
            parts = held.setdefault(rows.shape[1], [])
            parts.append((ids, rows))
            if sum(len(i) for i, _ in parts) >= ROW_BLOCK:
                yield SlicedBlock(np.concatenate([i for i, _ in parts]), np.concatenate([r for _, r in parts]))
                held[rows.shape[1]] = []
    for parts in held.values():
        if parts:
            yield SlicedBlock(np.concatenate([i for i, _ in parts]), np.concatenate([r for _, r in parts]))


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
    vector: str = "embedding", query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    Ties go to the smaller id.  A candidate is every row but those with the
    query's own id, of the query's length.  Vectors that are null, empty or hold
    null or non-finite components take no part, nor do null ids.  A query with
    fewer candidates gets all.  A query id that occurs several times is answered
    with its first usable vector in id and vector order.  Products must fit a long.
    """
    vectors_of = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    usable = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    wanted = usable.groupBy("id").agg(F.min("v").alias("v"))
    total = wanted.count()
    blocks = max(1, -(-total // query_block))
    found = None
    for b in range(blocks):
        # the ids of one block are a hash class, so that their number is bounded in expectation
        part = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in part.combine_chunks().to_batches():
            for ids, values in vectors(batch, scale):
                matrices[values.shape[1]] = (ids, values)

        def scan(batches: Iterator[pa.RecordBatch], matrices: dict = matrices) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, scale):
                if block.rows.shape[1] not in matrices:
                    continue
                for q, ids, scores in best_rows(block, *matrices[block.rows.shape[1]], k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        hits = vectors_of.mapInArrow(scan, _RESULT)
        found = hits if found is None else found.unionByName(hits)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
