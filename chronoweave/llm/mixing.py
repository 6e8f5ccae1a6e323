"""Mixing sources to target weights by Pfair scheduling.

A source with n of the D slots of a round is due its j-th block within the
window from floor((j-1) * D / n) to ceil(j * D / n).  Earliest deadline first
among the released blocks fills the D slots of a round; the weights are whole
numbers of slots, so every round looks the same and the schedule of one round,
D rows, is the schedule of all.  Every source then is less than one block away
from its target at every slot.

Documents are numbered within their source in a seeded random order.  A source
is cut into pieces of that order, so a source holding most of the rows is
numbered by many tasks.  Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

SLOTS = 240
BLOCK_DOCS = 16
PIECE_ROWS = 100_000
MIN_PIECES = 64
MAX_SOURCES = 10_000


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def shares(counts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(_s, rows, n): slots of a round per source, at least one each.

    Target weights are the square roots of the row counts (1000 * sqrt, rounded
    down), brought to whole slots by largest remainder, ties to the lesser name.
    """
    all_ = W.partitionBy()
    x = counts.withColumn("x", F.floor(F.sqrt("rows") * 1000).cast("long"))
    x = x.withColumns({"sources": F.count(F.lit(1)).over(all_), "sum": F.sum("x").over(all_)})
    free = F.greatest(F.lit(slots), F.col("sources")) - F.col("sources")
    x = x.withColumns({"q": _floor_div(free * F.col("x"), F.col("sum")), "free": free})
    x = x.withColumn("rem", F.col("free") * F.col("x") - F.col("q") * F.col("sum"))
    x = x.withColumns({"left": F.col("free") - F.sum("q").over(all_), "rank": F.row_number().over(W.partitionBy().orderBy(F.desc("rem"), "_s"))})
    return x.select("_s", "rows", (1 + F.col("q") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long").alias("n"))


def schedule(weights: DataFrame) -> DataFrame:
    """(_s, k, release, deadline, slot) of one round: earliest deadline first.

    One row per slot.  The state is one counter per source, at most MAX_SOURCES.
    """
    one = weights.agg(F.array_sort(F.collect_list(F.struct("_s", "n"))).alias("a"), F.sum("n").alias("d"))
    item = "struct<_s:string,k:bigint,release:bigint,deadline:bigint,slot:bigint>"

    def step(acc: Column, t: Column) -> Column:
        due = F.transform(
            F.col("a"),
            lambda s, i: F.when(
                (F.get(acc["done"], i) < s["n"]) & (_floor_div(F.get(acc["done"], i) * F.col("d"), s["n"]) <= t),
                F.struct(
                    _floor_div((F.get(acc["done"], i) + 1) * F.col("d") + s["n"] - 1, s["n"]).alias("deadline"),
                    i.cast("long").alias("i"),
                    _floor_div(F.get(acc["done"], i) * F.col("d"), s["n"]).alias("release"),
                    F.get(acc["done"], i).alias("k"),
                ),
            ),
        )
        best = F.array_min(F.filter(due, lambda x: x.isNotNull()))
        picked = F.struct(
            F.get(F.col("a"), best["i"].cast("int"))["_s"].alias("_s"), best["k"].alias("k"), best["release"].alias("release"),
            best["deadline"].alias("deadline"), t.alias("slot"),
        )
        return F.struct(
            F.transform(acc["done"], lambda c, i: c + F.when(i == best["i"], 1).otherwise(0)).alias("done"),
            F.concat(acc["out"], F.array(picked)).alias("out"),
        )

    start = F.struct(F.transform("a", lambda s: F.lit(0).cast("long")).alias("done"), F.array().cast(f"array<{item}>").alias("out"))
    plan = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("d") - 1), start, step, lambda acc: acc["out"])
    return one.filter("d > 0").select(F.explode(plan).alias("p")).select("p.*")


def mix_sources(
    docs: DataFrame, slots: int = SLOTS, block_docs: int = BLOCK_DOCS, seed: str = "", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """`docs` plus seq, block, release, deadline, slot (long, from 0) and in_mix.

    Read the rows by (slot, seq).  Every row stays.  Until a source runs out it is
    less than one block away from its target weight at every slot; later slots of
    it are simply not there, and the others go on in their proportions.  in_mix
    holds until sources with half of the target weights have run out, so a small
    source does not end the mix for all others.  A null source is a source of its own; rows with equal
    doc_id and text are told apart arbitrarily.  Columns of `docs` named like
    the added ones are replaced.  At most MAX_SOURCES sources.
    """
    pieces = max(MIN_PIECES, -(-docs.count() // piece_rows))
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.conv(F.substring(code, 1, 8), 16, 10).cast("long")
    text = F.md5(F.coalesce(F.col("text"), F.lit(""))) if "text" in docs.columns else F.lit("")
    rows = docs.drop("seq", "block", "release", "deadline", "slot", "in_mix").withColumns(
        {
            "_s": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            "_code": code,
            "_piece": F.shiftrightunsigned(place * pieces, 32),
        }
    )
    counts = cut_lineage(rows.groupBy("_s", "_piece").agg(F.count(F.lit(1)).alias("_n")))
    per_source = counts.groupBy("_s").agg(F.sum("_n").alias("rows"))
    weights = cut_lineage(shares(per_source, slots))
    bound = weights.count()
    if bound > MAX_SOURCES:
        raise ValueError(f"{bound} sources; at most {MAX_SOURCES}")
    plan = cut_lineage(schedule(weights))
    # bounded: one row per source and one per slot of a round
    weights, plan = F.broadcast(weights), F.broadcast(plan.withColumnRenamed("_s", "_p"))
    total = weights.agg(F.sum("n")).first()[0] or 0
    # the first slot that a source has no block for, a last partial block counted; the mix ends with the
    # slot at which the sources that have run out hold half of the round
    blocks = _floor_div(F.col("rows") + block_docs - 1, F.lit(block_docs))
    dry = weights.select("_s", "n", (blocks % F.col("n")).alias("_k"), _floor_div(blocks, F.col("n")).alias("_round"))
    dry = dry.join(plan, (F.col("_s") == F.col("_p")) & (F.col("_k") == F.col("k"))).select("n", (F.col("_round") * total + F.col("slot")).alias("_at"))
    gone = dry.withColumn("_gone", F.sum("n").over(W.partitionBy().orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)))
    end = gone.filter(F.col("_gone") * 2 >= total).agg(F.min("_at")).first()[0]
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).join(weights.select("_s", "n"), "_s").drop("_n")
    order = ["_code", "doc_id", "_text"]
    numbered = (
        rows.withColumn("_text", text)
        .withColumn("_at", F.row_number().over(W.partitionBy("_s", "_piece").orderBy(*order)))
        .join(offsets, ["_s", "_piece"])
        .withColumn("seq", F.col("_before") + F.col("_at") - 1)
        .withColumn("block", _floor_div(F.col("seq"), F.lit(block_docs)))
        .withColumns({"_k": F.col("block") % F.col("n"), "_round": _floor_div(F.col("block"), F.col("n"))})
    )
    placed = numbered.join(plan, (F.col("_s") == F.col("_p")) & (F.col("_k") == F.col("k")))
    at = {c: F.col("_round") * total + F.col(c) for c in ("release", "deadline", "slot")}
    done = placed.withColumns(at).withColumn("in_mix", F.col("slot") < F.lit(end))
    return done.drop("_s", "_code", "_piece", "_text", "_at", "_before", "n", "_k", "_round", "_p", "k")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents inside the mix, in the order of the schedule: part files and their rows follow it.

    What sources have left when the mix ends would bring back their raw shares and
    stays out.  An empty table stays empty.
    """
    return mix_sources(docs).filter("in_mix").orderBy("slot", "seq").select(docs.columns)
