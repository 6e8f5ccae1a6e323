import random
from zlib import crc32

from chronoweave.llm import sharding

ROWS = [(i, "word " * random.Random(i).randint(0, 60), "de", "x", 7) for i in range(500)]
ROWS += [(900 + i, "the same text", "de", "x", 7) for i in range(250)]
ROWS += [(None, None, None, None, None), (None, "", "en", "x", 1), (None, "née", "en", "x", 1), (3, ROWS[3][1], "de", "x", 7), (2000, "long " * 40000, "en", "x", 1)]
SCHEMA = "doc_id long, text string, lang string, shard string, slot int"


def test_every_record_has_one_place(spark, tmp_path):
    path = str(tmp_path / "map")
    found = sharding.shard_documents(spark.createDataFrame(ROWS, SCHEMA).repartition(5), 8, 512, path).collect()
    key = lambda rows: sorted(rows, key=repr)
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == key(
        (i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, *_ in ROWS
    )
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
    places = {}
    for r in found:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(8))
    slot_map = {r["virtual_slot"]: r for r in sharding.read_map(spark, path).collect()}
    assert all(slot_map[r["virtual_slot"]]["shard"] == r["shard"] for r in found)
    assert sum(r["bytes"] for r in slot_map.values()) == sum(r["size"] for r in found)
    first = {r["virtual_slot"]: r["shard"] for r in sharding.read_map(spark, path, 0).collect()}
    assert first == sharding.first_map(8, 512)


def test_bytes_are_even(spark):
    found = sharding.shard_documents(spark.createDataFrame(ROWS[:-1], SCHEMA)).collect()
    loads = [sum(r["size"] for r in found if r["shard"] == s) for s in range(8)]
    # the lightest and the heaviest shard differ by less than one record
    assert max(loads) - min(loads) <= max(r["size"] for r in found)


def test_edits_move_little_and_growth_only_into_the_new_shard():
    rnd = random.Random(3)
    weights = {s: (rnd.randint(0, 1000), 1) for s in range(0, 4096, 2)}
    weights[5] = (400_000, 9)  # more than a shard's share
    start = sharding.first_map(8)
    even = sharding.rebalanced(start, weights)
    again = sharding.rebalanced(even, weights)
    assert sum(again[s] != even[s] for s in even) <= 8  # an even map stays, but for a slot or so per shard
    load = lambda m, x: sum(w for s, (w, _) in weights.items() if m[s] == x)
    others = [load(even, x) for x in range(8) if x != even[5]]
    assert max(others) - min(others) <= 1000
    more = sharding.grown(even, weights)
    assert {more[s] for s in range(4096) if more[s] != even[s]} == {8}
    assert load(more, 8) > 0


def test_same_input_same_places_and_empty_table(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    one = sharding.shard_documents(docs.repartition(7)).collect()
    two = sharding.shard_documents(docs.repartition(2)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    assert sharding.shard_documents(docs.limit(0)).count() == 0
