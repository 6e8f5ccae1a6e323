import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import vectors as VEC
from chronoweave.operators.ranking import passthrough_rerank, rrf_fuse, with_reranker
from chronoweave.operators.text_index import bm25_search, build_index
from chronoweave.operators.distance import distances_to
from chronoweave.plans.search import one_query, search_facts, search_nodes

DOCS = {
    "1": "Red widget, red!", "2": "blue widget", "3": "", "4": "Ünïcode 漢字 красный widget 7", "5": "red", "6": "RED blue red widget",
}
CORPUS = "id string, text string"


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def bm25(docs, query):
    toks = {d: words(t) for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for term in set(words(query)):
        df = sum(term in t for t in toks.values())
        for d, t in toks.items():
            tf = t.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[d] = out.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return sorted(((round(s, 9), d) for d, s in out.items()), key=lambda x: (-x[0], x[1]))


def index(table, docs=DOCS):
    return build_index(table(list(docs.items()), CORPUS), "id", F.col("text"))


def test_index(table):
    ix = index(table)
    got = {(r.doc_uuid, r.term): (r.tf, r.dl) for r in ix.postings.collect()}
    assert got[("1", "red")] == (2, 3) and got[("4", "漢字")] == (1, 4 + 1) and ("3", "") not in got
    assert {r.term: r.df for r in ix.terms.collect()}["widget"] == 4
    assert tuple(ix.stats.first()) == (6, 15 / 6)


@pytest.mark.parametrize("query", ["red", "red red widget", "красный BLUE", "nothing here", ""])
def test_bm25(table, query):
    got = bm25_search(index(table), table([(0, query)], "query_id int, text string"), 3).orderBy("rank").collect()
    assert [(r.score, r.uuid) for r in got] == bm25(DOCS, query)[:3]


def test_bm25_candidates_keep_statistics(table):
    allowed = table([("2",), ("6",)], "uuid string")
    got = bm25_search(index(table), table([(0, "red widget")], "query_id int, text string"), 9, allowed).collect()
    assert {(r.score, r.uuid) for r in got} == {x for x in bm25(DOCS, "red widget") if x[1] in "26"}


def vectors(table, n=300, dim=5):
    rnd = np.random.default_rng(2)
    rows = [(f"v{i:03d}", [float(x) for x in rnd.normal(size=dim)]) for i in range(n)]
    rows += [("twin1", [1.0] * dim), ("twin2", [2.0] * dim), ("zero", [0.0] * dim), ("null", None), ("short", [1.0])]
    return rows


@pytest.mark.parametrize("blockwise", [False, True])
def test_cosine(table, monkeypatch, blockwise):
    if blockwise:
        monkeypatch.setattr(VEC, "QUERY_BLOCK", 3)
        monkeypatch.setattr(VEC, "_BLOCK_ROWS", 40)
    rows = vectors(table)
    queries = [(i, v) for i, (_, v) in enumerate(rows[:7])] + [(7, [1.0] * 5), (8, None), (9, [0.0] * 5)]
    got = {}
    found = VEC.cosine_search(
        table(rows, "uuid string, embedding array<float>"), table(queries, "query_id int, embedding array<float>"), 4
    )
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.uuid, r.score))
    f32 = lambda v: np.array(v, dtype=np.float32).astype(float)
    for q, v in queries[:8]:
        sims = [
            (round(float(f32(v) @ f32(x) / np.linalg.norm(f32(v)) / np.linalg.norm(f32(x))), 9), u)
            for u, x in rows if x is not None and len(x) == 5 and any(x)
        ]
        want = sorted(sims, key=lambda s: (-s[0], s[1]))[:4]
        assert [u for u, _ in got[q]] == [u for _, u in want]
        assert [s for _, s in got[q]] == pytest.approx([s for s, _ in want], abs=1e-8)
    assert 8 not in got and 9 not in got


def test_ann_scores_are_exact_and_pairs_single(table):
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(6, 8))
    rows = [(f"v{i:03d}", [float(x) for x in centers[i % 6] + 0.1 * rnd.normal(size=8)]) for i in range(240)]
    rows += [("zero", [0.0] * 8), ("null", None), ("short", [1.0])]
    df = table(rows, "uuid string, embedding array<float>")
    q = table([(i, v) for i, (_, v) in enumerate(rows[:12])], "query_id int, embedding array<float>")
    exact = {(r.query_id, r.uuid): r.score for r in VEC.cosine_search(df, q, 240).collect()}
    found = VEC.cosine_search_ann(df, q, 10, tables=6, probes=4, bits=4).collect()
    assert len({(r.query_id, r.uuid) for r in found}) == len(found)
    assert all(r.score == pytest.approx(exact[r.query_id, r.uuid], abs=1e-8) for r in found)
    best = {(r.query_id, r.uuid) for r in VEC.cosine_search(df, q, 10).collect()}
    assert len(best & {(r.query_id, r.uuid) for r in found}) > 0.9 * len(best)


@pytest.mark.parametrize("block", [4000, 20])
def test_ann_finds_near_vectors_among_few_candidates(table, monkeypatch, block):
    """64 components, 4,000 vectors around 200 centres: nine in ten neighbours from less than a tenth of the pairs."""
    monkeypatch.setattr(VEC, "QUERY_BLOCK", block)
    rnd = np.random.default_rng(9)
    centers = rnd.normal(size=(200, 64))
    points = (centers[rnd.integers(0, 200, 4000)] + 0.35 * rnd.normal(size=(4000, 64))).astype(np.float32)
    df = table([(f"v{i:04d}", [float(x) for x in p]) for i, p in enumerate(points)], "uuid string, embedding array<float>")
    q = table([(i, [float(x) for x in points[i * 80]]) for i in range(50)], "query_id int, embedding array<float>")
    planes = VEC._Planes(8, 10, 8, 42)
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert len(VEC._pairs(planes.buckets(units), planes.probed(units[::80]))) < 0.1 * 50 * 4000
    found = {(r.query_id, r.uuid): r.score for r in VEC.cosine_search_ann(df, q, 10, bits=10).collect()}
    sims = units[::80].astype(np.float64) @ units.T.astype(np.float64)
    best = {(i, f"v{j:04d}") for i in range(50) for j in np.argsort(-sims[i])[:10]}
    assert len(best & set(found)) >= 0.9 * len(best)
    assert all(abs(s - sims[i, int(u[1:])]) < 1e-6 for (i, u), s in found.items())


def test_cosine_min_score(table):
    df = table([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 1.0])], "uuid string, embedding array<float>")
    q = table([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r.uuid for r in VEC.cosine_search(df, q, 5, 0.5).collect()] == ["a"]
    assert VEC.cosine_search(df, q.limit(0), 5).collect() == []


def test_rrf(table):
    lists = [[("a", 1), ("b", 2), ("c", 3)], [("b", 1), ("d", 2)]]
    frames = [table([(0, u, r) for u, r in x], "query_id int, uuid string, rank int") for x in lists]
    got = [(r.uuid, r.rrf) for r in rrf_fuse(frames).orderBy(F.desc("rrf"), "uuid").collect()]
    want = [("b", 1 / 62 + 1 / 61), ("a", 1 / 61), ("d", 1 / 62), ("c", 1 / 63)]
    assert got == [(u, round(s, 9)) for u, s in want]


@pytest.mark.parametrize("hot", [10**6, 30])
def test_passthrough_goes_below_zero(table, hot):
    df = table([(0, i) for i in range(103)], "query_id int, rank int")
    got = {r.rank: r.score for r in passthrough_rerank(df, ["rank"], hot).collect()}
    assert (got[0], got[1], got[2], got[101], got[102]) == (1.0, 0.99, 0.98, -0.01, -0.02)


def test_reranker_plug(table):
    df = table([(q, f"q{q}", r, d) for q in (0, 1) for r, d in enumerate(["bb", "a", "ccc"])], "query_id int, text string, rank int, document string")
    longest = lambda query, docs: sorted(((i, float(len(d))) for i, d in enumerate(docs)), key=lambda x: -x[1])
    got = with_reranker(df, longest).filter("query_id = 1").orderBy(F.desc("score")).collect()
    assert [(r.document, r.score) for r in got] == [("ccc", 3.0), ("bb", 2.0), ("a", 1.0)]


def test_embedding(table):
    df = table([("a", "red widget red"), ("b", "widget red, red"), ("c", ""), ("d", None)], "id string, text string")
    got = {r.id: r.embedding for r in VEC.embed_column(df, F.col("text"), 16).collect()}
    assert got["a"] == got["b"] and all(len(v) == 16 for v in got.values())
    assert np.linalg.norm(got["a"]) == pytest.approx(1, abs=1e-6) and not any(got["c"])
    with pytest.raises(Exception, match="expected vectors of size 3"):
        VEC.with_embedder(df, F.col("text"), lambda s: s.map(lambda _: [1.0, 2.0]), 3).collect()


ENT = "uuid string, name string, summary string, labels array<string>, group_id string, created_at timestamp, attributes map<string,string>, name_embedding array<float>"


def people(table):
    rows = [
        ("1", "Ann", "likes tea", ["P"], "g", None, None, [1.0, 0.0]),
        ("2", "Bob", "likes tea", ["P"], "g", None, None, [0.9, 0.1]),
        ("3", "Cid", "likes rum", ["Q"], "h", None, None, [0.0, 1.0]),
        ("4", "Dee", None, None, "h", None, None, None),
    ]
    edges = [("e1", "g", "3", "4", "knows", "Cid knows Dee"), ("e2", "g", "4", "2", "met", "Dee met Bob tea")]
    facts = table(edges, "uuid string, group_id string, source_node_uuid string, target_node_uuid string, name string, fact string")
    facts = facts.withColumn("fact_embedding", F.lit(None).cast("array<float>"))
    return table(rows, ENT), facts


def test_search_nodes(table, spark):
    ent, facts = people(table)
    whole = {"group_ids": []}
    ask = lambda **kw: [r.uuid for r in search_nodes(ent, one_query(spark, "tea", [1.0, 0.0]), **(whole | kw)).orderBy("rank").collect()]
    assert ask() == ["1", "2", "3"]
    assert ask(max_nodes=1) == ["1"]
    assert ask(group_ids=["h"]) == ["3"] and ask(entity="P") == ["1", "2"] and ask(group_ids=["nobody"]) == []
    # null means the default group, as everywhere
    assert ask(group_ids=None, default_group="h") == ["3"] and ask(group_ids=None) == []
    r = search_nodes(ent, one_query(spark, "dee", [0.0, 0.0]), group_ids=[]).collect()
    assert [(x.uuid, x.summary, x.labels, x.attributes) for x in r] == [("4", "", [], {})]
    with pytest.raises(ValueError):
        search_nodes(ent, one_query(spark, "x", [1.0]), max_nodes=0)


def test_search_from_text_alone(table, spark):
    ent, facts = people(table)
    found = search_nodes(ent.drop("name_embedding"), one_query(spark, "cid likes rum"), group_ids=[]).orderBy("rank").collect()
    assert found[0].uuid == "3"
    found = search_facts(facts.drop("fact_embedding"), one_query(spark, "who met bob"), group_ids=[]).orderBy("rank").collect()
    assert found[0].uuid == "e2"


def test_ann_answers_every_size(table):
    rows = [(f"a{i}", [float(i + 1), 1.0]) for i in range(5)] + [(f"b{i}", [1.0, float(i), 2.0]) for i in range(5)]
    df = table(rows, "uuid string, embedding array<float>")
    q = table([(0, [2.0, 1.0]), (1, [1.0, 1.0, 2.0]), (2, None), (3, [])], "query_id int, embedding array<float>")
    got = {r.query_id for r in VEC.cosine_search_ann(df, q, 3).collect()}
    assert got == {0, 1}


def test_distances_from_both_ends(table):
    rnd = np.random.default_rng(8)
    edges = {(int(a), int(b)) for a, b in rnd.integers(0, 60, size=(70, 2))}
    facts = table([(f"f{a}-{b}", str(a), str(b)) for a, b in edges], "uuid string, source_node_uuid string, target_node_uuid string")
    pairs = [(str(a), str(b)) for a, b in rnd.integers(0, 65, size=(80, 2))]
    near = {str(i): set() for i in range(65)}
    for a, b in edges:
        near[str(a)].add(str(b))
        near[str(b)].add(str(a))

    def hops(a, b):
        seen, at, d = {a}, {a}, 0
        while at:
            if b in at:
                return d
            at = {y for x in at for y in near[x]} - seen
            seen |= at
            d += 1
        return None

    got = {(r.center, r.node): r.distance for r in distances_to(facts, table(pairs, "center string, node string")).collect()}
    assert got == {(a, b): hops(a, b) for a, b in pairs}
    short = {(r.center, r.node): r.distance for r in distances_to(facts, table(pairs, "center string, node string"), 2).collect()}
    assert short == {k: d if d is not None and d <= 2 else None for k, d in got.items()}


def test_search_around_a_node(table, spark):
    ent, facts = people(table)
    near = search_nodes(ent, one_query(spark, "tea", [1.0, 0.0], "4"), group_ids=[], facts=facts).orderBy("rank").collect()
    assert [(r.uuid, r.distance) for r in near] == [("2", 1), ("3", 1), ("1", None)]
    found = search_facts(facts, one_query(spark, "tea knows", [1.0], "2"), group_ids=[]).orderBy("rank").collect()
    assert [(r.uuid, r.distance) for r in found] == [("e2", 0), ("e1", 1)]
    with pytest.raises(ValueError, match="max_facts must be a positive integer"):
        search_facts(facts, one_query(spark, "x", [1.0]), max_facts=0)


def test_postings_are_not_shuffled_by_word(table):
    """The query words are broadcast: a frequent word stays where its postings are."""
    plan = bm25_search(index(table), table([(0, "red")], "query_id int, text string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [term" in plan and "hashpartitioning(query_id" in plan


def test_postings_are_scored_document_by_document(spark, monkeypatch):
    from chronoweave.operators import text_index as I

    words = ["oak", "elm", "ash", "fir", "yew", "box"]
    rows = [(i % 37 if i % 11 else None, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(q, " ".join(words[q % 6 :])) for q in range(12)], "query_id long, text string")
    index = I.build_index(docs, "id", F.col("text"))
    allowed = docs.filter("id % 2 = 0").select(F.col("id").alias("uuid"))
    found = [I.bm25_search(index, queries, 4, a) for a in (None, allowed)]
    # no (query, document) pair is summed by a shuffle: only the k best of each span are sent
    assert "Aggregate" not in found[0]._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(I, "WEIGHTS_AT_HAND", 0)
    plain = [I.bm25_search(index, queries, 4, a) for a in (None, allowed)]
    for new, old in zip(found, plain, strict=True):
        assert sorted(map(repr, new.collect())) == sorted(map(repr, old.select(*new.columns).collect()))


def test_documents_cut_over_batches_are_scored_whole(monkeypatch):
    import pyarrow as pa

    from chronoweave.operators import text_index as I

    rng = np.random.default_rng(3)
    weights = [{"query_id": q, "term": f"t{t}", "idf": 0.5 + t, "avgdl": 9.0} for q in range(5) for t in range(8) if (q + t) % 2]
    ids = [None] * 40 + sorted(rng.integers(0, 30, 400).tolist())
    columns = [pa.array(ids, pa.int64()), *[pa.array(rng.integers(0, n, 440)) for n in (8, 5, 20)]]
    whole = pa.RecordBatch.from_arrays(columns, ["doc_uuid", "_term", "tf", "dl"])
    score = I._score_postings(weights, 1000, pa.int64())

    def found(size):
        batches = [whole.slice(lo, size) for lo in range(0, len(whole), size)]
        return sorted((repr(r["uuid"]), r["query_id"], round(r["score"], 9)) for b in score(iter(batches)) for r in b.to_pylist())

    at_once = found(len(whole))
    assert len({r[:2] for r in at_once}) == len(at_once)
    monkeypatch.setattr(I, "WORDS_AT_ONCE", 30)
    assert found(7) == at_once and found(100) == at_once
