import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from chronoweave.llm import pieces
from chronoweave.llm.queries import MODEL_FILE

TEXTS = [None, "", "a", "hello world", "  two  blanks\tand\nlines ", "é€𐍈 ▁literal▁ mark", "ab", "x" * 3000, "word " * 4000, "日本語のテキスト"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary(MODEL_FILE)


def segmentations(vocab, text):
    """Every segmentation of a text without byte pieces, with its weight."""
    known = {vocab.pieces[i]: i for i in vocab.ids.tolist()}

    def walk(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, min(len(rest), vocab.longest) + 1):
            if rest[:n] in known:
                for tail, w in walk(rest[n:]):
                    yield (known[rest[:n]], *tail), w + vocab.log_weight[known[rest[:n]]]

    return dict(walk("▁" + text.replace(" ", "▁")))


def test_draws_follow_the_law_without_replacement(vocab):
    every = segmentations(vocab, "abc")
    p = np.exp(list(every.values()))
    p /= p.sum()
    n = 20000
    got = pieces.sample_segmentations(vocab, ["abc"] * n, pieces.mix(np.arange(n, dtype=np.uint64)), 2)
    first = Counter(tuple(ids.tolist()) for _, rank, ids, _, _ in got if rank == 1)
    second = Counter(tuple(ids.tolist()) for _, rank, ids, _, _ in got if rank == 2)
    for k, s in enumerate(every):
        assert abs(first[s] / n - p[k]) < 0.015
        expected = sum(p[a] * p[k] / (1 - p[a]) for a in range(len(p)) if a != k)
        assert abs(second[s] / n - expected) < 0.015
    for _, _, ids, log_prob, log_inclusion in got[:200]:
        assert math.isclose(log_prob, math.log(p[list(every).index(tuple(ids.tolist()))]), rel_tol=1e-9)
        assert log_inclusion <= 0
    # inverse inclusion probabilities make the sample an unbiased estimate of the whole
    assert abs(sum(math.exp(lp - li) for *_, lp, li in got) / n - 1) < 0.01


def test_all_segmentations_come_out_once(vocab):
    every = segmentations(vocab, "ab c")
    got = pieces.sample_segmentations(vocab, ["ab c"], pieces.mix(np.array([9], np.uint64)), 500)
    assert sorted(tuple(ids.tolist()) for _, _, ids, _, _ in got) == sorted(every)
    assert all(li == 0 for *_, li in got)
    assert math.isclose(sum(math.exp(lp) for *_, lp, _ in got), 1, rel_tol=1e-9)


def test_rows_come_back_and_do_not_depend_on_batches(spark, vocab):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "null key", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_documents(docs, MODEL_FILE, samples=3)
    found = sorted((r["doc_id"] is None, r["doc_id"], r["sample"], tuple(r["ids"]), r["round_trip"], round(r["log_prob"], 6)) for r in got.collect())
    apart = pieces.encode_documents(docs.repartition(7), MODEL_FILE, samples=3).collect()
    assert found == sorted((r["doc_id"] is None, r["doc_id"], r["sample"], tuple(r["ids"]), r["round_trip"], round(r["log_prob"], 6)) for r in apart)
    assert all(x[4] for x in found)
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    for null, key, _, ids, *_ in found:
        if not null:
            assert processor.decode(list(ids)) == (TEXTS[key] or "")
    assert len([x for x in found if x[1] == 3]) == 6 and len({x[3] for x in found if x[1] == 3}) == 3
    assert len([x for x in found if x[1] == 1]) == 1  # the empty text has one segmentation
    decoded = pieces.decode_documents(got, MODEL_FILE).collect()
    assert all(r["text"] == (TEXTS[r["doc_id"]] or "") for r in decoded if r["doc_id"] is not None)
    assert pieces.encode_documents(docs.limit(0), MODEL_FILE).count() == 0


def test_decoding_by_arrays_equals_decoding_by_pieces():
    vocab = pieces.Vocabulary(MODEL_FILE)
    texts = ["", " ", "  two", "plain words here", "é𐍈 � ▁ x", "a\x00b\n\tc"]
    found = pieces.sample_segmentations(vocab, texts, np.arange(len(texts), dtype=np.uint64), 2)
    ids = [x for _, _, x, _, _ in found]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    want = [vocab.decode(x.tolist()) == texts[d] for (d, *_), x in zip(found, ids, strict=True)]
    kept, pieces.SPELLED_IDS = pieces.SPELLED_IDS, 3
    assert pieces._decodes_to(vocab, np.concatenate(ids), offsets, [texts[d] for d, *_ in found]) == want and all(want)
    assert not any(pieces._decodes_to(vocab, np.concatenate(ids), offsets, [texts[d] + "x" for d, *_ in found]))
    pieces.SPELLED_IDS = kept


def test_few_random_words_are_mixed_for_a_character(monkeypatch):
    rng, mixed, plain = np.random.default_rng(5), [], pieces.mix
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(20)]
    vocab = pieces.Vocabulary(MODEL_FILE)
    monkeypatch.setattr(pieces, "mix", lambda x: mixed.append(x.size) or plain(x))
    found = pieces.sample_segmentations(vocab, texts, np.arange(20, dtype=np.uint64), 2)
    # what depends on the text or the unit alone is mixed once, and nodes with one edge are not drawn from
    steps = sum(len(ids) for _, _, ids, _, _ in found)
    assert sum(mixed) < 3.5 * steps, sum(mixed) / steps
