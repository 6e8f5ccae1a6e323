import random

import numpy as np
import pyarrow as pa

from chronoweave.llm import minhash


def test_members_that_are_near_none_are_not_compared_with_all(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    docs = []
    for k in range(120):  # similarity of any two about 0.65: buckets are shared, links are not
        text = list(base)
        for place in range(4):
            text[draw.randrange(6, 30) + 36 * place] = f"own{k}x{place}"
        docs.append((k, " ".join(text)))
    compared, counts = minhash._Work.compared, []

    def counting(work, likely):
        counts.append(likely.count())
        return compared(work, likely)

    monkeypatch.setattr(minhash._Work, "compared", counting)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4).collect()
    assert len(got) == 120 and all(r["kept"] for r in got)
    assert len(counts) >= 3 and counts[2] < 700  # star, pivots, then outsiders with members: of 7140 pairs


def test_parities_differ_in_no_more_places_than_sets():
    draw = np.random.default_rng(2)
    pool = draw.integers(-(1 << 63), 1 << 63, 3000)
    sets = [pool[:0], pool[:1], *(draw.choice(pool, draw.integers(1, 2000), replace=False) for _ in range(40)), pool]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], ["id", "set"])
    rows = [r for part in minhash._parities([batch.slice(0, 30), batch.slice(30)]) for r in part.to_pylist()]
    assert [r["id"] for r in rows] == list(range(len(sets)))
    bits = [np.unpackbits(np.array(r["parity"], np.int64).view(np.uint8)) for r in rows]
    assert bits[0].sum() == 0 and bits[1].sum() == 1
    for a in range(len(sets)):
        for b in range(a):
            assert (bits[a] != bits[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))
