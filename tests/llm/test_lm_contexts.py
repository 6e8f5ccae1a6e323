import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from chronoweave.llm import lm
from test_lm import slow_digits


class Counts:
    """Zeros and ones of every context and place of one order, in a dictionary, read like a table of logits."""

    def __init__(self, texts, order):
        self.counts = Counter()
        for text in texts:
            found, lengths = lm._tokens(pa.array([text]))
            contexts = [np.zeros(len(found), np.uint64), *lm._earlier(found, lengths)][order]
            for c, places, digits in zip(contexts.tolist(), *(x.tolist() for x in lm._digits(found)), strict=True):
                self.counts.update((c, n, d) for n, d in zip(places, digits, strict=True))

    def __getitem__(self, cell):
        zero, one = (self.counts[*(cell if isinstance(cell, tuple) else (0, int(cell))), d] for d in (0, 1))
        return min(8, max(-8, math.log((one + 0.4) / (zero + 0.4))))


def own_cells(context, node):
    out = np.empty(node.shape, object)
    out[0] = [(int(context[0]), n) for n in node[0].tolist()]
    return out


def test_no_two_contexts_share_their_counts(spark, monkeypatch):
    """Scores are those of plain counts, over several batches and many parts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3).cache()
    rows = [tuple(r) for r in docs.collect()]
    train = [x for i, x in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    monkeypatch.setattr(lm, "PART_BYTES", 1 << 14)
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "_slots", own_cells)
    words = Counter(lm._tokens(pa.array(train))[0].tolist())
    tokens, kinds = Counter(), Counter(w >> 64 - lm.BITS for w in words)
    for w, n in words.items():
        tokens[w >> 64 - lm.BITS] += n
    plain = lm.Model([Counts(train, order) for order in range(lm.ORDERS)], np.zeros(lm.CLASSES, np.int64), np.zeros(lm.CLASSES, np.int64))
    for i, x in rows[:40]:
        found = lm._tokens(pa.array([x]))[0]
        inside = sum(math.log10((words[t] + 1) / (tokens[t >> 64 - lm.BITS] + kinds[t >> 64 - lm.BITS] + 1)) for t in found.tolist())
        assert np.isclose(got[i], inside + slow_digits(plain, found), rtol=1e-3)
