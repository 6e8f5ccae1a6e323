"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

A document is the set of its word shingles, hashed to 64 bits.  Two random
permutations give all signature coordinates: the first scatters the shingles
over a circle of 2^32 places, the second is applied after turning the circle
by one more place for every coordinate, and the least value is the coordinate.
Coordinates are cut into bands; documents that agree on a band share a bucket.

Equal sets become one class first, and only class representatives go on.  In
every bucket the members are compared with the least one, on their full sets,
and those that are not near it with PIVOTS other members.  Where a bucket then
still holds several groups, the members outside the least one's group are
compared with all members of other groups: documents already connected need no
comparison, so a group of near copies costs its size, not its square.  Outsiders
are paired with members only where the parities of both sets, PARITY_BITS bits
each, differ in no more places than similar sets can: the places that differ are
never more than the elements that do, so no link is lost.  A pair is made in the
first bucket it shares.  A bucket with more outsiders than OUTSIDERS is divided
by its members' further bands first.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.components import components, few
from chronoweave.llm.words import mix, shingle_sets, slices
from chronoweave.session import cut_lineage, scratch_path

SHINGLE_WORDS = 5
PERCENT = 80
# A pair of similarity 0.8 misses all 40 bands of 5 with probability 1.2e-7.
BANDS = 40
ROWS = 5
OUTSIDERS = 1000
PIVOTS = 8
SKETCH_WORDS = 3
PARITY_BITS = 1024
MAX_DEPTH = 3

_CHUNK = 512
_SIGNED = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"


def _permute(x: np.ndarray, spare: np.ndarray, factors: tuple[int, int]) -> np.ndarray:
    """A permutation of the 32-bit words, in place."""
    for shift, factor in ((16, factors[0]), (15, factors[1])):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def coordinates(members: np.ndarray, count: int) -> np.ndarray:
    """`count` circulant MinHash coordinates of a non-empty set of 64-bit hashes."""
    places = (members ^ (members >> np.uint64(32))).astype(np.uint32)
    places = _permute(places, np.empty_like(places), (0x21F0AAAD, 0x735A2D97))
    turns = np.arange(1, count + 1, dtype=np.uint32)[:, None]
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), _CHUNK):
        turned = places[None, at : at + _CHUNK] + turns
        np.minimum(least, _permute(turned, np.empty_like(turned), (0x2C1B3C6D, 0x297A2D39)).min(axis=1), out=least)
    return least


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band of coordinates; the band's number is part of it."""
    values = values.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return key.view(np.int64)


def sketch(values: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 * SKETCH_WORDS coordinates, as whole numbers."""
    bits = (values[: 64 * SKETCH_WORDS] & np.uint32(1)).astype(np.uint8)
    return np.packbits(np.resize(bits, 64 * SKETCH_WORDS), bitorder="little").view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).fill_null("")
        for lo, hi in slices(texts):
            sets = shingle_sets(texts.slice(lo, hi - lo), size)
            values = [coordinates(s, bands * rows) if len(s) else None for s in sets]
            keys = [np.zeros(0, np.int64) if v is None else np.concatenate((band_keys(v, bands, rows), sketch(v))) for v in values]
            digest = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy()),
                    pa.array(digest[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))),
                ],
                ["doc_id", "n_shingles", "digest_a", "digest_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).fill_null("")
        for lo, hi in slices(texts):
            sets = shingle_sets(texts.slice(lo, hi - lo), size)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), values], ["id", "set"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, parity): whether an odd number of a set's hashes fall on each of PARITY_BITS places, as whole numbers."""
    for batch in batches:
        for lo in range(0, len(batch), _CHUNK):
            rows = batch.slice(lo, _CHUNK)
            sets = rows.column(1)
            row = np.repeat(np.arange(len(rows)), pa.compute.list_value_length(sets).to_numpy())
            place = row * PARITY_BITS + (sets.flatten().to_numpy() & (PARITY_BITS - 1))
            odd = (np.bincount(place, minlength=len(rows) * PARITY_BITS) & 1).astype(np.uint8)
            words = pa.array(np.packbits(odd, bitorder="little").view(np.int64))
            offsets = pa.array(np.arange(0, len(words) + 1, PARITY_BITS // 64, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, words)], ["id", "parity"])


class _Work:
    """Scratch tables of one run and the check of candidate pairs."""

    def __init__(self, texts: DataFrame, size: int, percent: int):
        self.spark, self.texts, self.size, self.percent = texts.sparkSession, texts, size, percent
        self.calls, self.sets = 0, None

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"minhash-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def confirmed(self, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
        """The (a, b) of `pairs` whose full sets are similar enough.

        Pairs that differ too much in size, or in more sketch bits than similar
        sets do but once in 10^8, are left out before the sets are fetched.
        """
        of = self.sketches(firsts)
        return self.compared(pairs.join(of["a"], "a").join(of["b"], "b").filter(self.likely()).select("a", "b"))

    def sketches(self, firsts: DataFrame) -> dict[str, DataFrame]:
        """Sizes and sketches, named for either end of a pair."""
        known = few(firsts.select("id", "n", "sketch"))
        return {x: known.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"}

    def likely(self) -> Column:
        """Condition over n_a, n_b, s_a and s_b."""
        apart = sum((F.bit_count(F.get("s_a", F.lit(w)).bitwiseXOR(F.get("s_b", F.lit(w)))) for w in range(SKETCH_WORDS)), F.lit(0))
        near_size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        return near_size & (apart <= _most_apart(self.percent))

    def parities(self) -> DataFrame:
        """(id, parity) of the sets measured last; null for a document of several texts."""
        found = self.sets.mapInArrow(_parities, "id long, parity array<long>")
        return found.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("parity")).alias("parity"))

    def possible(self) -> Column:
        """Condition over n_a, n_b, p_a and p_b that every similar pair meets; true where a parity is not known."""
        differ = sum((F.bit_count(F.get("p_a", F.lit(w)).bitwiseXOR(F.get("p_b", F.lit(w)))) for w in range(PARITY_BITS // 64)), F.lit(0))
        return F.coalesce(differ * (100 + self.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - self.percent), F.lit(True))

    def compared(self, likely: DataFrame) -> DataFrame:
        """The (a, b) of `likely` whose full sets are similar enough."""
        return self.measured(likely).filter(F.col("both") * 100 >= F.col("union") * self.percent).select("a", "b")

    def measured(self, likely: DataFrame) -> DataFrame:
        """(a, b, both, union): sizes of the intersection and the union of the full sets."""
        self.calls += 1
        likely = self.written(likely, f"likely-{self.calls}")
        ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
        size = self.size
        sets = self.texts.join(few(ids), "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, size), "id long, set array<long>")
        self.sets = sets = self.written(sets, f"sets-{self.calls}")
        of_a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
        of_b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
        sized = likely.join(of_b, "b").join(of_a, "a").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
        return sized.select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("union"))


def _most_apart(percent: int) -> int:
    """Sketch bits in which sets of the given similarity differ, and 5.7 standard deviations more."""
    bits, p = 64 * SKETCH_WORDS, (100 - percent) / 200
    return int(bits * p + 5.7 * (bits * p * (1 - p)) ** 0.5) + 1


def _linked(work: _Work, firsts: DataFrame, outsiders: int) -> DataFrame | None:
    """Links (a, b) that connect every group of the class representatives `firsts` (id, n, bands, sketch).

    None when no two of them share a bucket.
    """
    keyed = firsts.select(F.posexplode("bands").alias("band", "key"), "id", F.lit(0).cast("long").alias("parent"))
    links = None
    for depth in range(MAX_DEPTH + 1):
        star = keyed.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("_top")).filter("center < _top").drop("_top")
        shared = work.written(keyed.join(star, "key"), f"shared-{depth}")
        if shared.isEmpty():
            return links
        pairs = shared.filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
        found = work.written(work.confirmed(pairs, firsts), f"star-{depth}")
        pivots = work.compared(_pivot_pairs(work, shared, found, firsts, depth))
        links = work.written((found if links is None else links.unionByName(found)).unionByName(pivots), f"links-{depth}")
        grouped = shared.join(few(components(links)), "id", "left").withColumn("group", F.coalesce("group", "id"))
        of_center = F.max(F.when(F.col("id") == F.col("center"), F.col("group"))).alias("main")
        mixed = grouped.groupBy("key").agg(of_center, F.min("group").alias("_lo"), F.max("group").alias("_hi")).filter("_lo < _hi")
        still = work.written(grouped.join(mixed.select("key", "main"), "key"), f"open-{depth}")
        if still.isEmpty():
            return links
        # the similarity of every member of these buckets to the least one
        known = work.measured(still.filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct())
        parities = work.written(work.parities(), f"parities-{depth}")
        near = few(work.written(known.groupBy("a", "b").agg(F.when(F.count(F.lit(1)) == 1, F.max(F.col("both") / F.col("union"))).alias("near")), f"near-{depth}"))
        near = near.select(F.col("a").alias("center"), F.col("b").alias("id"), "near")
        out = F.col("group") != F.col("main")
        counted = work.written(still.groupBy("key").agg(F.sum(out.cast("long")).alias("outside")), f"outside-{depth}")
        light = counted.filter(F.col("outside") <= outsiders) if depth < MAX_DEPTH else counted
        rest = still.join(few(light.select("key")), "key").join(few(firsts.select("id", "n", "sketch")), "id")
        rest = rest.join(near, ["center", "id"], "left").withColumn("near", F.when(F.col("id") == F.col("center"), 1.0).otherwise(F.col("near")))
        rest = rest.join(parities, "id").withColumn("keys", F.collect_set("key").over(Window.partitionBy("id", "parent")))
        rest = rest.select("key", "id", "group", "n", "near", out.alias("out"), F.col("sketch").alias("s"), F.col("parity").alias("p"), F.col("keys").alias("k"))
        left, right = [
            rest.select("key", F.col("id").alias(x), F.col("group").alias(f"g_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "near", "out", "s", "p", "k")])
            for x in "ab"
        ]
        # conditions of the join itself, so that pairs that cannot be similar are never made: sizes, sketches, the
        # triangle inequality of Jaccard distances to the bucket's least member, and parities
        other = (F.col("g_a") != F.col("g_b")) & (~F.col("out_b") | (F.col("a") < F.col("b")))
        # (a document of several texts has no single distance)
        triangle = F.coalesce(F.abs(F.col("near_a") - F.col("near_b")) <= 1 - work.percent / 100 + 1e-9, F.lit(True))
        first = F.array_min(F.array_intersect("k_a", "k_b")) == F.col("key")
        cross = left.filter("out_a").join(right, "key").filter(other & triangle & work.likely() & work.possible() & first).select("a", "b").distinct()
        links = work.written(links.unionByName(work.compared(cross)), f"more-{depth}")
        heavy = counted.filter(F.col("outside") > outsiders).select("key")
        if depth == MAX_DEPTH or heavy.isEmpty():
            return links
        crowded = still.join(few(heavy), "key", "left_semi").select("id", F.col("key").alias("_key"), F.col("band").alias("_band"))
        further = crowded.join(firsts.select("id", "bands"), "id").select("*", F.posexplode("bands").alias("band", "_next"))
        keyed = work.written(further.filter("band > _band").select("band", F.xxhash64("_key", "_next").alias("key"), "id", F.col("_key").alias("parent")), f"keyed-{depth}")
    return links


def _pivot_pairs(work: _Work, shared: DataFrame, found: DataFrame, firsts: DataFrame, depth: int) -> DataFrame:
    """Likely pairs (a, b) of members outside their bucket's star and PIVOTS members of the bucket drawn by hash."""
    of = work.sketches(firsts)
    inside = few(found.select(F.col("a").alias("center"), F.col("b").alias("id")))
    outside = shared.filter("id <> center").join(inside, ["center", "id"], "left_anti").select("key", "id")
    outside = work.written(outside, f"outside-star-{depth}")
    open_keys = few(outside.select("key").distinct())
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(i)), "id")).getField("id").alias(f"p{i}") for i in range(PIVOTS)]
    pivots = shared.filter("id <> center").join(open_keys, "key", "left_semi").groupBy("key").agg(*drawn)
    pivots = pivots.select("key", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("b"))
    left = outside.select("key", F.col("id").alias("a")).join(of["a"], "a")
    pairs = left.join(pivots.join(of["b"], "b"), "key").filter((F.col("a") != F.col("b")) & work.likely())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS, outsiders: int = OUTSIDERS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs`.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the least doc_id reachable and kept says that
    it is the document's own.  Without words a document has no shingles and no
    links.  A null doc_id takes no part: its component_id is null and it is kept.
    Rows that share a doc_id are one document with several texts.
    """
    work = _Work(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), size, percent)
    signed = work.written(work.texts.mapInArrow(lambda it: _sign(it, size, bands, rows), _SIGNED), "signed")
    taking = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    digest = ["digest_a", "digest_b"]
    classes = taking.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    first = F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")
    members = work.written(taking.join(classes, digest).select("doc_id", "n_shingles", "rep", first), "members")
    # the array holds the band keys, then the sketch
    keys, sketched = F.slice("bands", 1, bands).alias("bands"), F.slice("bands", bands + 1, SKETCH_WORDS).alias("sketch")
    firsts = members.filter(F.col("bands").isNotNull()).select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), keys, sketched)
    links = _linked(work, firsts, outsiders)
    # documents of several texts connect the classes they are in
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_hi")).filter("a < _hi")
    several = several.join(members.select("doc_id", F.col("rep").alias("b")), "doc_id").filter("a < b").select("a", "b")
    links = several if links is None else links.unionByName(several)
    reps = members.select("doc_id", "n_shingles", "rep").join(few(components(links)).withColumnRenamed("id", "rep"), "rep", "left")
    linked = reps.select("doc_id", "n_shingles", F.coalesce("group", "rep").alias("component_id"))
    alone = signed.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    both = linked.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """`docs` with one document of each group: the one with the least doc_id.

    Of several rows with that doc_id one stays; rows with a null doc_id all stay.
    """
    near = cut_lineage(near_duplicates(docs, **options).filter("doc_id IS NOT NULL").select("doc_id", "kept"))
    repeated = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("kept")).filter("_n > 1")
    others = docs.join(few(near.filter("NOT kept").select("doc_id").unionByName(repeated.select("doc_id")).distinct()), "doc_id", "left_anti")
    if repeated.isEmpty():
        return others.select(docs.columns)
    again = docs.join(few(repeated.filter("kept").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return others.select(docs.columns).unionByName(again.select(docs.columns))
