import math
import random

import numpy as np
import pytest

from chronoweave.llm import topk


def plain(rows, queries, k):
    whole = {}
    out = []
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in usable:
        whole.setdefault(i, v)
    for q in queries:
        if q in whole:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in usable if i != q and len(v) == len(whole[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("query_block", [4096, 7])
def test_same_as_all_products(spark, query_block):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # a very common vector, so ties
    rows += [(2000, None), (2050, []), (2100, [None] * 16), (2150, [float("nan")] * 16), (2200, [float("inf")] + [0.0] * 15), (None, rows[0][1])]
    rows += [(3000, [0.5] * 3), (3001, [-0.25, 1.0, 9.75]), (4000, [0.0] * 16), (4050, [1000.0] * 16), (4100, [-1e6] * 16)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    wanted = [i for i, _ in rows if i is not None and i % 50 == 0] + [3001]
    queries = frame.filter("vec_id % 50 = 0 OR vec_id = 3001")
    got = sorted(map(tuple, topk.top_k(frame, queries, k=5, query_block=query_block).collect()))
    assert got == plain(rows, wanted, 5)


def test_fewer_candidates_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.5]), (50, [0.25, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(frame, frame).collect())) == [(0, 1, 50, 256 * 64 - 128 * 256), (50, 1, 0, 256 * 64 - 128 * 256)]
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.top_k(frame, frame.limit(0)).count() == 0


def test_candidates_hold_the_best_and_few_others():
    draw = np.random.default_rng(2)
    rows = np.floor(draw.normal(0, 32, (20000, 64))).astype(np.int64)
    block = topk.SlicedBlock(np.arange(20000), rows)
    for q, at in topk.candidates(block, rows[:40], 6):
        products = rows @ rows[q]
        assert set(np.argsort(-products, kind="stable")[:6]) <= set(at) or np.sort(products[at])[-6] == np.sort(products)[-6]
        assert len(at) < 1000
