from collections import Counter

import corpus_pipeline
from chronoweave.llm import minhash, mixing, pii, quality
from test_minhash import components
from test_pii import base, discovered

DIR = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    """Each stage on its own input, against a plain computation of what it should keep and change."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["quality rules"](spark, docs, DIR).cache()
    judged = {r["doc_id"]: r for r in quality.judge_documents(docs).collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {i: r["clean_text"] for i, r in judged.items() if r["kept"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert all(judged[i]["kept"] for i, q in labels.items() if q == 1 and i in judged and judged[i]["n_words"] >= 20 and not judged[i]["base_failed"])

    single = stages["near-duplicates"](spark, clean, DIR).cache()
    want = components([(r["doc_id"], r["text"]) for r in clean.collect()], minhash.SHINGLE_WORDS)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, root in want.items() if i == root)

    masked = stages["personal data"](spark, single, DIR).cache()
    rows = single.orderBy("doc_id").collect()
    more = discovered([r["text"] for r in rows])
    got = {r["doc_id"]: r["text"] for r in masked.collect()}
    for k, r in enumerate(rows):
        text, at, out = r["text"], 0, []
        for start, end, kind in sorted((a, b, kind) for kind, a, b in base(text) + more[k]):
            if start < at:
                at = max(at, end)
                continue
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        assert got[r["doc_id"]] == "".join(out) + text[at:]
    assert set(pii.KINDS) == {"email", "ip", "card", "phone"}

    mixed = stages["source mixing"](spark, masked, DIR)
    assert mixed.columns == docs.columns
    inside = mixing.mix_sources(masked).filter("in_mix").select(docs.columns)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, inside.collect()))

    encoded = stages["sentencepiece"](spark, masked, DIR).collect()
    assert all(r["round_trip"] for r in encoded) and {r["doc_id"] for r in encoded} == set(got)


def test_mixing_brings_a_hot_source_to_its_share(spark):
    sizes = {"hot": 3000, **{f"s{k}": 160 for k in range(10)}}
    rows = [(i, f"t{i}", "en", s, 2) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = Counter(r["source"] for r in dict(corpus_pipeline.STAGES)["source mixing"](spark, docs, DIR).collect())
    weight = {s: n**0.5 for s, n in sizes.items()}
    target = weight["hot"] / sum(weight.values())
    # two thirds of the rows before; a block is 16 of them
    assert abs(after["hot"] / sum(after.values()) - target) < 0.03
    assert all(after[f"s{k}"] >= 160 - 16 for k in range(10))


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == ["doc_id", "sample", "ids", "n_pieces", "log_prob", "log_inclusion", "round_trip"]
    assert got.count() > 0
