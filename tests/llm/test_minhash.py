import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chronoweave.llm import minhash, words


def shingles(text, size):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def components(docs, size, percent=80):
    """All pairs, no signatures."""
    sets, root = {}, {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, size))
            root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            for s in sets[a]:
                if any(s and t and 100 * len(s & t) >= percent * len(s | t) for t in sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE "), (5, "one two"), (6, "Two one"), (None, "one"), (None, None)]
    base = prose(120)
    for k in range(90):  # a group of near copies, some of them too far from the first
        text = list(base)
        for _ in range(draw.randrange(0, 9)):
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        docs.append((100 + k, " ".join(text)))
    docs += [(300 + k, " ".join(base)) for k in range(30)]
    shared = prose(60)
    docs += [(400 + k, " ".join(shared + prose(draw.randrange(5, 60)))) for k in range(60)]
    chain = prose(100)
    for k in range(25):  # neighbours are near, ends are not
        docs.append((500 + k, " ".join(chain)))
        chain[4 * k % 100] = draw.choice(vocabulary)
        chain[(4 * k + 1) % 100] = draw.choice(vocabulary)
    docs += [(700, " ".join(prose(30000))), (800, "one"), (800, " ".join(base))]
    draw.shuffle(docs)
    return docs


@pytest.mark.parametrize(("size", "outsiders"), [(4, 64), (5, 0)])
def test_components_match_all_pairs(spark, size, outsiders):
    docs = corpus()
    got = minhash.near_duplicates(
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_shingles int"), size=size, outsiders=outsiders
    ).collect()
    want = components(docs, size)
    assert len(got) == len(docs)
    sizes = sorted(len(shingles(t, size)) for _, t in docs)
    assert sorted(r["n_shingles"] for r in got) == sizes
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == want[r["doc_id"]])


def test_one_document_of_each_group_stays(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    got = minhash.drop_near_duplicates(frame)
    assert got.columns == frame.columns
    want = components(docs, minhash.SHINGLE_WORDS)
    kept = sorted(i for i, root in want.items() if i == root)
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == kept
    assert got.filter("doc_id IS NULL").count() == 2
    assert minhash.drop_near_duplicates(frame.limit(0)).count() == 0


def test_coordinates_estimate_similarity():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    for shared in (200, 1000, 1800):
        a, b = pool[:2000], pool[2000 - shared : 4000 - shared]
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (minhash.coordinates(a, 800) == minhash.coordinates(b, 800)).mean()
        assert abs(same - exact) < 0.08


def test_words_are_found_in_slices():
    texts = pa.array(["A b", None, "", "  c\tD\n", "é", "a" * 100 + " " + "b" * 3000000, "last"])
    hashes, counts = words.hash_words(texts)
    assert counts.tolist() == [2, 0, 0, 2, 1, 2, 1]
    assert hashes[0] == words.hash_word("a") and hashes[3] == words.hash_word("d") and hashes[-1] == words.hash_word("LAST")
    rejoined = np.concatenate([words.hash_words(texts.slice(a, b - a))[0] for a, b in words.slices(texts)])
    assert (rejoined == hashes).all()
