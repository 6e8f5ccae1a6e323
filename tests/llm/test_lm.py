import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from chronoweave.llm import lm


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["\n"]


def test_base_and_counts_match_a_plain_count(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(90001, None), (90002, ""), (90003, "\t \n"), (90004, "The THE the"), (None, "the end"), (90005, "x" * 40000), (90004, "The THE the")]
    docs = given.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held, strict=True) if not h for t in tokens(x))
    total = sum(counts.values())
    want = Counter()
    for (i, x), h in zip(rows, held, strict=True):
        t = tokens(x)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t)
        want[i, h, len(t), sum(counts[w] > 0 for w in t), total, round(base, 6)] += 1
    scored = lm.score_documents(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored) == want
    out = [r for r in scored if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better on unseen texts
    assert all(r["score"] < 0 for r in scored)
    repeated = [r["score"] for r in scored if r["doc_id"] == 90004]
    assert len(repeated) == 2 and repeated[0] == repeated[1]
    assert lm.score_documents(docs.limit(0)).count() == 0


def slow_digits(model, found):
    """Digit by digit, one text."""
    weights = np.array([[w] * lm.BITS for w in lm.FIRST_WEIGHTS])
    cells = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, lm.MAP_CELLS))), (lm.BITS, 1))
    one, two = lm._earlier(found, np.array([len(found)]))
    total = 0.0
    for t in range(len(found)):
        node, digit = lm._digits(found[t : t + 1])
        spots = (node, lm._slots(one[t : t + 1], node), lm._slots(two[t : t + 1], node))
        for d in range(lm.BITS):
            x = np.array([float(model.tables[o][spots[o][0, d]]) for o in range(lm.ORDERS)])
            z = float(np.clip(weights[:, d] @ x, -8, 8))
            p = 1 / (1 + math.exp(-z))
            c = round((z + 8) * (lm.MAP_CELLS - 1) / 16)
            final = p + lm.MAP_SHARE * (cells[d, c] - p)
            bit = int(digit[0, d])
            total += math.log10(final if bit else 1 - final)
            cells[d, c] += lm.MAP_RATE * (bit - cells[d, c])
            weights[:, d] += lm.RATE * (bit - p) * x
    return total


def test_texts_together_score_as_alone_and_digit_by_digit():
    draw = np.random.default_rng(4)
    tables = [np.clip(draw.normal(0, 1, n), -8, 8).astype(np.float16) for n in (lm.CLASSES, 1 << lm.SLOT_BITS, 1 << lm.SLOT_BITS)]
    model = lm.Model(tables, np.ones(lm.CLASSES, np.int64), np.ones(lm.CLASSES, np.int64))
    texts = pa.array(["a b c a b c a b", "", "x", "one two three four five six one two"])
    found, lengths = lm._tokens(texts)
    together = model.digit_logs(found, lengths)
    starts = np.cumsum(lengths) - lengths
    for i, n in enumerate(lengths):
        part = found[starts[i] : starts[i] + n]
        assert np.isclose(model.digit_logs(part, np.array([n]))[0], together[i], rtol=1e-6)
        assert np.isclose(slow_digits(model, part), together[i], rtol=1e-3)


def test_a_step_is_a_probability():
    """Over all classes of the next token the digits' probabilities add up to one."""
    draw = np.random.default_rng(6)
    tables = [np.clip(draw.normal(0, 1, n), -8, 8).astype(np.float16) for n in (lm.CLASSES, 1 << lm.SLOT_BITS, 1 << lm.SLOT_BITS)]
    model = lm.Model(tables, np.ones(lm.CLASSES, np.int64), np.ones(lm.CLASSES, np.int64))
    first = lm._tokens(pa.array(["a b a"]))[0][:3]
    before = model.digit_logs(first, np.array([3]))[0]
    codes = np.arange(lm.CLASSES, dtype=np.uint64) << np.uint64(64 - lm.BITS)
    texts = np.concatenate([np.append(first, c) for c in codes])
    after = model.digit_logs(texts, np.full(lm.CLASSES, 4))
    assert np.isclose((10 ** (after - before)).sum(), 1, atol=1e-3)
