"""Ordered work per key that survives one key holding most of the rows.

A window over a key sorts all its rows in one task.  The functions here look
first for hot keys (one count per key, combined map-side, key columns only).
Without any, they are the plain window.  With some, the rows of each hot key
are cut into order-preserving pieces, the window runs per (key, piece), and
what crosses a piece border is carried over from a table of one row per piece.

A key is hot above `hot_rows` rows, and a piece has about that many, whatever
the size of the table.  The tables of hot keys, cuts and pieces have one row
per key or piece; they are broadcast behind a check of their row count and
joined by shuffle beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
_SAMPLES_PER_PIECE = 20

PIECE = "_piece"
_HOT = "_hot"


@dataclass
class Pieces:
    """`df` with columns `_piece` (0 for ordinary keys) and `_hot`."""

    df: DataFrame
    keys: list[str]
    split: bool

    def window(self) -> W:
        return W.partitionBy(*self.keys, PIECE)

    def per_piece(self, *aggs: Column) -> DataFrame:
        """One row per piece of a hot key."""
        return self.df.filter(F.col(_HOT)).groupBy(*self.keys, PIECE).agg(*aggs)

    def attach(self, df: DataFrame, carried: DataFrame, *columns: str) -> DataFrame:
        """Joins the per-piece `columns` to the rows; null-safe on the keys."""
        right = broadcast_if_small(carried.select(*[F.col(c).alias(f"_r_{c}") for c in [*self.keys, PIECE]], *columns))
        on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*self.keys, PIECE]]
        return df.join(right, on, "left").drop(*[f"_r_{c}" for c in [*self.keys, PIECE]])

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(PIECE, _HOT)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more rows than one task should take; None when there is no such key.  Runs one job."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n")).first()[0]
    return None if top is None or top <= hot_rows else counts.filter(F.col("_n") > hot_rows)


def split_hot_keys(
    df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS
) -> Pieces:
    """Cuts the rows of hot keys into pieces that follow `order` (a total order).

    Cut points come from a hash sample of the hot keys' own rows: the same rows
    are drawn again when a task is retried.  They only place the cuts; every
    row stays in.
    """
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return Pieces(df.withColumn(PIECE, F.lit(0)).withColumn(_HOT, F.lit(False)), keys, False)

    renamed = broadcast_if_small(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    on_hot = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    stride = max(1, hot_rows // _SAMPLES_PER_PIECE)
    drawn = (
        df.select(*keys, F.struct(*order).alias("_at"))
        .filter(F.pmod(F.xxhash64("_at", *keys), F.lit(stride)) == 0)
        .join(renamed, on_hot, "left_semi")
    )
    # sorted sample, thinned to one cut per _SAMPLES_PER_PIECE rows
    every = F.sequence(F.lit(_SAMPLES_PER_PIECE), F.size("_s"), F.lit(_SAMPLES_PER_PIECE))
    cuts = (
        drawn.groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_at")).alias("_s"))
        .select(
            *[F.col(k).alias(f"_h_{k}") for k in keys],
            F.when(
                F.size("_s") >= _SAMPLES_PER_PIECE,
                F.transform(every, lambda i: F.element_at(F.col("_s"), i.cast("int"))),
            ).alias("_cuts"),
        )
    )
    # cuts below the row: first among every _step-th cut, then among those up to the next of them
    here = F.struct(*order)
    step = F.ceil(F.sqrt(F.size("_cuts"))).cast("int")
    cuts = cuts.withColumn("_step", F.greatest(step, F.lit(1)))
    every_step = F.transform(
        F.when(F.size("_cuts") >= F.col("_step"), F.sequence(F.col("_step"), F.size("_cuts"), F.col("_step"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.element_at("_cuts", i),
    )
    cuts = cuts.withColumn("_coarse", F.when(F.col("_cuts").isNotNull(), every_step))
    above = F.size(F.filter("_coarse", lambda c: c < here)) * F.col("_step")
    before = above + F.size(F.filter(F.slice("_cuts", above + 1, F.col("_step")), lambda c: c < here))
    pieces = (
        df.join(broadcast_if_small(cuts), on_hot, "left")
        .withColumn(_HOT, F.col("_cuts").isNotNull())
        .withColumn(PIECE, F.when(F.col(_HOT), before).otherwise(0))
        .drop("_cuts", "_coarse", "_step", *[f"_h_{k}" for k in keys])
    )
    return Pieces(pieces, keys, True)


def with_position(
    df: DataFrame, keys: list[str], order: list[str], out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based position of each row within its key."""
    p = split_hot_keys(df, keys, order, hot_rows)
    here = F.row_number().over(p.window().orderBy(*order)).cast("long")
    ranked = p.df.withColumn(out, here)
    if p.split:
        earlier = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
        offsets = p.per_piece(F.count(F.lit(1)).alias("_rows")).withColumn(
            "_before", F.sum("_rows").over(earlier)
        )
        ranked = p.attach(ranked, offsets, "_before")
        ranked = ranked.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_before")
    return p.finish(ranked)


def with_next(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Struct of `values` of the following row of the same key; null for the last."""
    p = split_hot_keys(df, keys, order, hot_rows)
    row = F.struct(*values)
    result = p.df.withColumn(out, F.lead(row).over(p.window().orderBy(*order)))
    if p.split:
        heads = p.per_piece(F.min_by(row, F.struct(*order)).alias("_head")).withColumn(
            "_next_head", F.lead("_head").over(W.partitionBy(*keys).orderBy(PIECE))
        )
        result = p.attach(result, heads, "_next_head")
        result = result.withColumn(out, F.coalesce(out, "_next_head")).drop("_next_head")
    return p.finish(result)


def with_last_seen(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Last non-null `value` at or before each row of the same key."""
    p = split_hot_keys(df, keys, order, hot_rows)
    upto = p.window().orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    result = p.df.withColumn(out, F.last(value, ignorenulls=True).over(upto))
    if p.split:
        last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
        earlier = W.partitionBy(*keys).orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
        tails = p.per_piece(last.alias("_tail")).withColumn(
            "_carry", F.last("_tail", ignorenulls=True).over(earlier)
        )
        result = p.attach(result, tails, "_carry")
        result = result.withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
    return p.finish(result)


def joined_in_order(
    df: DataFrame,
    keys: list[str],
    order: str,
    text: Column,
    separator: str,
    out: str,
    extra: list[Column] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Text of each key's rows joined in order; null texts are skipped.

    Rows of a hot key are joined piece by piece first, so that no task lists
    all of them.  `extra` are aggregates named like the columns they keep,
    which must hold when applied twice (min, max, sum).
    """
    extra = extra or []
    p = split_hot_keys(df.withColumn("_text", text), keys, [order], hot_rows)

    def gather(source: DataFrame, by: list[str], at: str, more: list[Column]) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct(at, "_text"))))
        return source.groupBy(*by).agg(
            F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda x: x["_text"]), separator)).alias("_text"),
            *more,
        )

    if p.split:
        parts = gather(p.df, [*keys, PIECE], order, extra)
        whole = gather(parts, keys, PIECE, extra)
    else:
        whole = gather(df.withColumn("_text", text), keys, order, extra)
    return whole.withColumn(out, F.coalesce("_text", F.lit(""))).drop("_text")


def is_small(df: DataFrame, max_rows: int = 100_000) -> bool:
    """Whether a table has at most max_rows rows; stops reading beyond them."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint behind a check of the row count; without it Spark shuffles."""
    return F.broadcast(df) if is_small(df, max_rows) else df


# Rows that one task makes distinct or sorts when tasks are counted out.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame, rows: int) -> int:
    """Into how many tasks a shuffle of `rows` rows is dealt, so that memory of a task does not grow with them."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
