from collections import Counter, defaultdict
from math import floor, sqrt

from chronoweave.llm import mixing


def documents(spark, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"t{i}", source, "x"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")


def test_every_prefix_is_within_a_block_of_the_targets(spark):
    sizes = {"a": 700, "b": 300, "c": 90, "d": 40, None: 65}
    got = mixing.mix_sources(documents(spark, sizes), slots=24, block_docs=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(sum(sizes.values())))
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r["slot"]].add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in by_slot.values())
    for source, n in sizes.items():
        assert sorted(r["seq"] for r in got if r["source"] == source) == list(range(n))
    weights = Counter(next(iter(by_slot[t]))[0] for t in range(24))
    x = {s: floor(1000 * sqrt(n)) for s, n in sizes.items()}
    free = 24 - len(x)
    assert all(abs(weights[s] - 1 - free * x[s] / sum(x.values())) < 1 for s in x)
    done = Counter()
    mixed = [r for r in got if r["in_mix"]]
    last = {s: max(r["slot"] for r in got if r["source"] == s) for s in sizes}
    for t in range(max(r["slot"] for r in mixed) + 1):
        for source, _ in by_slot[t]:
            done[source] += 1
        assert all(abs(done[s] - (t + 1) * weights[s] / 24) < 1 for s in weights if t <= last[s])
    assert mixed and len(mixed) < len(got)
    end = max(m["slot"] for m in mixed)
    assert all(r["in_mix"] == (r["slot"] <= end) for r in got)
    # half of the weights have run out where the mix ends
    assert sum(weights[s] for s in sizes if last[s] <= end) * 2 >= 24


def test_a_small_source_does_not_end_the_mix(spark):
    got = mixing.mix_sources(documents(spark, {"a": 2000, "b": 2000, "c": 2000, "tiny": 10}))
    assert got.filter("in_mix").count() > 0.95 * 6010
    assert got.filter("in_mix AND source = 'tiny'").count() == 10


def test_pieces_do_not_change_the_order(spark):
    docs = documents(spark, {"a": 500, "b": 20})
    one = {(r["doc_id"], r["slot"], r["seq"]) for r in mixing.mix_sources(docs).collect()}
    mixing.MIN_PIECES, kept = 1, mixing.MIN_PIECES
    assert {(r["doc_id"], r["slot"], r["seq"]) for r in mixing.mix_sources(docs).collect()} == one
    mixing.MIN_PIECES = kept


def test_repeated_null_and_empty_rows(spark):
    rows = [(None, None, None), (None, None, None), (1, "x", "s"), (1, "x", "s"), (1, "y", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 5 and sorted((r["source"] or "", r["seq"]) for r in got) == [("", 0), ("", 1), ("s", 0), ("s", 1), ("s", 2)]
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
