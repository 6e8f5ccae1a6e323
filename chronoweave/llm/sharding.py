"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's virtual slot follows from its id and text alone and never changes.
Bytes are summed per slot, and a map of one row per slot says which shard holds
it.  Rebalancing and growing edit the map: a shard keeps its heaviest slots up to
its fair share, and what is over goes, heaviest first, to the lightest shard.
Every edit is a new version of the map, so a reader can stay with an old one.

The map has `slots` rows (thousands) however large the data, so edits are made
on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import scratch_path

SLOTS = 4096
MAP_COLUMNS = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus one; one for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record, from the first 60 bits of an MD5 digest of its id and the checksum of its text."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_crc(text).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def placed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record."""
    text, doc_id = F.col("text"), F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), text_bytes(text).alias("size"), text_crc(text).alias("text_crc32"), virtual_slot(doc_id, text, slots).alias("virtual_slot")
    )


def slot_weights(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot that has any; at most one entry per slot, summed map-side first."""
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    return {r["virtual_slot"]: (r["bytes"], r["n_rows"]) for r in found.collect()}


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots dealt out in turn, before anything is known of their bytes."""
    return {slot: slot % shards for slot in range(slots)}


def _kept(owned: list[int], weights: dict[int, tuple[int, int]], share: int) -> tuple[list[int], list[int]]:
    """A shard's slots, heaviest first, up to its share (the first and the empty ones in any case), and the others."""
    ordered = sorted(owned, key=lambda s: (-weights.get(s, (0, 0))[0], s))
    held, stay, over = 0, [], []
    for slot in ordered:
        weight = weights.get(slot, (0, 0))[0]
        held += weight
        (stay if held <= share or not stay or not weight else over).append(slot)
    return stay, over


def fair_share(weights: dict[int, tuple[int, int]], shards: int) -> int:
    """Bytes a shard should hold; slots too heavy for any share have a shard of their own and do not count."""
    total = sum(w for w, _ in weights.values())
    for weight, _ in sorted(weights.values(), reverse=True):
        if shards == 1 or weight * shards < total:
            break
        total, shards = total - weight, shards - 1
    return total // shards


def _edited(slot_map: dict[int, int], weights: dict[int, tuple[int, int]], shards: list[int], takers: list[int]) -> dict[int, int]:
    weight = lambda s: weights.get(s, (0, 0))[0]
    share = fair_share(weights, len(shards))
    edited, loads, pool = dict(slot_map), dict.fromkeys(shards, 0), []
    for shard in shards:
        stay, over = _kept([s for s, x in slot_map.items() if x == shard], weights, share)
        loads[shard] = sum(map(weight, stay))
        pool += over
    for slot in sorted(pool, key=lambda s: (-weight(s), s)):
        best = min(takers, key=lambda x: (loads[x], x))
        edited[slot] = best
        loads[best] += weight(slot)
    return edited


def rebalanced(slot_map: dict[int, int], weights: dict[int, tuple[int, int]]) -> dict[int, int]:
    """The map with the bytes of its shards evened out; slots that need not move stay."""
    shards = sorted(set(slot_map.values()))
    return _edited(slot_map, weights, shards, shards)


def grown(slot_map: dict[int, int], weights: dict[int, tuple[int, int]]) -> dict[int, int]:
    """The map with one more shard: slots move into the new shard only."""
    new = max(slot_map.values()) + 1
    return _edited(slot_map, weights, [*sorted(set(slot_map.values())), new], [new])


def write_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int], weights: dict[int, tuple[int, int]]) -> None:
    """Stores one version of the map; another version is another folder, none is changed."""
    rows = [(version, s, x, *weights.get(s, (0, 0))) for s, x in sorted(slot_map.items())]
    spark.createDataFrame(rows, MAP_COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version-{version:06d}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest without `version`."""
    if version is not None:
        return spark.read.schema(MAP_COLUMNS).parquet(f"{path.rstrip('/')}/version-{version:06d}")
    every = spark.read.schema(MAP_COLUMNS).parquet(f"{path.rstrip('/')}/version-*")
    return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version", "left_semi")


def routed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds `shard` and `slot`, the record's place in its shard, gapless from 0.

    A shard's places follow its virtual slots, so records are ordered within a
    virtual slot only, and each of those starts after the rows of the slots before it.
    """
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    numbered = records.withColumn("_place", F.row_number().over(within).cast("long") - 1)
    # bounded: one row per virtual slot
    joined = numbered.join(F.broadcast(starts), "virtual_slot")
    return joined.withColumn("slot", F.col("_start") + F.col("_place")).drop("_start", "_place")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of every document.

    The law is `bytes`: version 0 of the map deals the slots in turn, version 1
    evens out the bytes found in them; both are stored under `path`, by default in
    the shared folder.  `grown_shard` is null, as another shard changes the shares.
    A null text counts one byte and has the checksum of the empty text; a null
    doc_id is a name like any other, its records part by their texts.  Copies under
    other ids go to slots of their own.  Only rows equal in id and text share a slot
    for certain; which of them has which place does not matter.  A slot heavier than
    a shard's share stays whole and the other shards are evened out.  Texts of any length stay where they are: only sizes
    and checksums are shuffled.  An empty table gives an empty result.  Other columns,
    whatever their names, are not carried.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "slot-map")
    records = placed(docs, slots)
    weights = slot_weights(records)
    start = first_map(shards, slots)
    write_map(spark, path, 0, start, weights)
    write_map(spark, path, 1, rebalanced(start, weights), weights)
    found = routed(records, read_map(spark, path))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
