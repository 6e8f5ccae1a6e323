import itertools
import random
import re

import numpy as np

from chronoweave.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string, A int"


def fails(text, doc_id, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f for f, x in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search(r"[#$%&*|]", text)), doc_id is not None and first is not None and first < doc_id,
        )) if x
    }


def plain(docs, labels):
    """Every order walked document by document."""
    firsts = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for doc_id, text, lang, *_ in docs:
        parts.setdefault(lang or "", []).append((doc_id, fails(text or "", doc_id, firsts.get(text or ""))))
    rows = []
    for part, items in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in itertools.permutations("ABCDE"):
            left = list(items)
            for k, f in enumerate(order):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[f] += len(out)
                mine.append((part, "".join(order), k + 1, len(left), len(out), sum(f in x[1] for x in items) - len(out),
                             sum(x[1] == {f} for x in items), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out), f))
        rows += [(*r[:-1], removed_by[r[-1]]) for r in mine]
    return sorted(rows)


def sample():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "Ab", "a#b", " ".join(words), " ".join(words) + " $", "AB " * 300, "é" * 30, "word " * 60000, " " * 3]
    texts += [" ".join(rnd.choices(words[:rnd.choice([3, 300])], k=rnd.choice([5, 250]))) for _ in range(30)]
    docs = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""]), "x", 1) for i in range(120)]
    docs += docs[:10] + [(None, rnd.choice(texts), "en", "x", 1) for _ in range(8)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


def test_all_orders_match_a_plain_walk(spark, monkeypatch):
    docs, labels = sample()
    args = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain(docs, labels)
    assert sorted(map(tuple, audit.audit_filters(*args).collect())) == want
    marks = audit.marked(*args)
    narrow = audit.audit_orders(audit.removal_sizes(audit.posting_lists(marks, width=7)))
    assert sorted(map(tuple, narrow.collect())) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 1)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs, labels).count() == 600
    assert audit.audit_filters(docs.limit(0), labels).count() == 0


def test_merges_of_sorted_lists():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        lists = [np.unique(rnd.integers(0, 200, rnd.integers(0, 80))) for _ in range(4)]
        want = np.unique(np.concatenate(lists))
        assert np.array_equal(audit.union(lists), want)
        assert np.array_equal(audit.absent(lists[0], lists[1]), np.setdiff1d(lists[0], lists[1]))
