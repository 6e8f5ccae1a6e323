import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import facts as FA
from chronoweave.operators import maintenance as M
from chronoweave.operators.distance import node_distance
from chronoweave.operators.merge import deep_merge
from chronoweave.operators.resolution import build_mentions, connected, merge_similar, resolve_entities, similar_names
from tests.conftest import same

T0 = datetime(2024, 1, 1)


def t(n):
    return T0 + timedelta(days=n)


def leaves(value, path=()):
    if isinstance(value, dict) and (value or path == ()):
        for k, v in value.items():
            yield from leaves(v, (*path, k))
    else:
        yield list(path), "{}" if value == {} else repr(value)


def merged(layers):
    """The recursive definition."""

    def two(a, b):
        out = dict(a)
        for k, v in b.items():
            out[k] = two(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
        return out

    whole = {}
    for layer in layers:
        whole = two(whole, layer)
    return whole


FIXED = [
    [{"a": {"x": 1, "y": 2}, "t": 0}, {"a": {"x": 9, "z": 3}}],
    [{"l": [1, 2, 3]}, {"l": [4]}],
    [{"a": {"x": 1}}, {"a": "s"}],
    [{"a": {"x": 1}}, {"a": "s"}, {"a": {"y": 2}}],
    [{"a": {"x": 1}}, {"a": None}],
    [{"a": {"x": 1}}, {"a": {}}],
    [{"a": "s"}, {"a": {}}],
    [{}, {"k": 1}],
    [{"k": 1}, {}],
    [{"a": {}}, {"a": {"b": {}}}, {"a": {"b": {"c": 1}}}],
]


def random_layer(rnd, depth=0):
    out = {}
    for k in rnd.sample("abc", rnd.randint(0, 2)):
        kind = rnd.random()
        out[k] = random_layer(rnd, depth + 1) if depth < 3 and kind < 0.6 else rnd.choice([1, "s", None, [1]])
    return out


def test_deep_merge_is_the_recursive_merge(table):
    rnd = random.Random(3)
    stacks = FIXED + [[random_layer(rnd) for _ in range(rnd.randint(1, 5))] for _ in range(400)]
    rows = [(i, n, p, v) for i, s in enumerate(stacks) for n, layer in enumerate(s) for p, v in leaves(layer)]
    got = {}
    for r in deep_merge(table(rows, "key int, layer int, path array<string>, value_json string")).collect():
        got.setdefault(r.key, []).append((r.path, r.value_json))
    for i, stack in enumerate(stacks):
        assert sorted(got.get(i, [])) == sorted(leaves(merged(stack))), stack


FACT = "uuid string, group_id string, source_node_uuid string, target_node_uuid string, name string, fact string, valid_at timestamp, created_at timestamp"


def fact(uuid, target, valid, created=None, source="A", name="lives_in"):
    return (uuid, "g", source, target, name, f"{source} {name} {target}", t(valid), t(created if created is not None else valid))


@pytest.mark.parametrize("flip", [False, True])
def test_newer_fact_closes_older(table, flip):
    rows = [fact("1", "X", 1), fact("2", "Y", 3)]
    got = {r.uuid: r for r in FA.apply_facts(table(rows[::-1] if flip else rows, FACT), None, ["lives_in"]).collect()}
    assert got["1"].invalid_at == t(3) and got["2"].invalid_at is None
    at = lambda n: [r.target_node_uuid for r in FA.facts_as_of(table(rows, FACT).transform(lambda d: FA.apply_facts(d, None, ["lives_in"])), F.lit(t(n))).collect()]
    assert at(2) == ["X"] and at(3) == ["Y"] and at(0) == []


def test_increment_equals_whole(table):
    early, late = table([fact("2", "Y", 3)], FACT), table([fact("1", "X", 1), fact("3", "Z", 2)], FACT)
    step = FA.apply_facts(late, FA.apply_facts(early, None, ["lives_in"]), ["lives_in"])
    whole = FA.apply_facts(early.unionByName(late), None, ["lives_in"])
    same(whole, step)


def test_repeated_facts(table):
    one = fact("1", "X", 1)
    rows = [one, one, fact("2", "Y", 2), fact("3", "X", 5, name="knows"), fact("4", "X", 6, name="knows")]
    got = FA.apply_facts(table(rows, FACT), None, ["lives_in"])
    assert sorted(r.uuid for r in got.collect()) == ["1", "2", "3"]
    assert got.filter("uuid = '1'").first().invalid_at == t(2)


def test_sightings_as_rows(table):
    rows = [(*fact("1", "X", 1), ["e1", "e2"]), (*fact("1", "X", 1), ["e2", "e3"]), (*fact("2", "Y", 2), ["e4"]), (*fact("9", "Z", 1, name=None), ["e9"])]
    rows += [(*fact("3", "X", 5, name="knows"), ["e1"]), (*fact("4", "X", 6, name="knows"), [f"e{i}" for i in range(6)]), (*fact("5", "Y", 6, name="knows"), None)]
    seen = table(rows, f"{FACT}, episodes array<string>")
    alone = FA.apply_facts(seen, None, ["lives_in"], unite_episodes=False)
    whole = FA.apply_facts(seen, None, ["lives_in"])
    same(alone.drop("episodes"), whole.drop("episodes"))
    got = FA.fact_sightings(seen, alone, ["lives_in"])
    want = [(r.uuid, r.valid_at, e) for r in whole.collect() for e in r.episodes or []]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 11
    assert FA.fact_sightings(seen.limit(0), alone, ["lives_in"]).count() == 0


def test_equal_times_give_an_empty_interval(table):
    got = {r.uuid: r for r in FA.apply_facts(table([fact("2", "Y", 1), fact("1", "X", 1)], FACT), None, ["lives_in"]).collect()}
    assert got["1"].invalid_at == t(1) == got["1"].valid_at and got["2"].invalid_at is None


def test_known_time(table):
    stored = FA.apply_facts(table([fact("1", "X", 1, 11), fact("2", "Y", 3, 13)], FACT), None, ["lives_in"])
    ask = lambda v, k: [r.target_node_uuid for r in FA.facts_as_of(stored, F.lit(t(v)), F.lit(t(k)), ["lives_in"]).collect()]
    assert ask(4, 12) == ["X"] and ask(2, 14) == ["X"] and ask(4, 14) == ["Y"]


def test_random_facts_as_known(table):
    rnd = random.Random(5)
    rows = [fact(f"{i:03d}", f"T{i}", rnd.randrange(12), rnd.randrange(12), f"S{rnd.randrange(12)}") for i in range(150)]
    stored = FA.apply_facts(table(rows, FACT), None, ["lives_in"], hot_rows=5).cache()
    for v, k in [(3, 4), (6, 6), (10, 2)]:
        want = set()
        for s in {r[2] for r in rows}:
            known = [(r[6], r[0]) for r in rows if r[2] == s and r[7] <= t(k) and r[6] <= t(v)]
            if known:
                want.add(max(known)[1])
        got = FA.facts_as_of(stored, F.lit(t(v)), F.lit(t(k)), ["lives_in"], hot_rows=5)
        assert {r.uuid for r in got.collect()} == want


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_as_of_for_a_table(table, hot):
    rnd = random.Random(6)
    facts = [(f"f{i:03d}", rnd.choice("hhhhab"), rnd.randrange(100)) for i in range(200)]
    asks = [(i, rnd.choice("hhhhabc"), rnd.randrange(110)) for i in range(150)]
    f = table([(u, k, t(d), t(d + 4)) for u, k, d in facts], "uuid string, k string, valid_at timestamp, invalid_at timestamp")
    p = table([(i, k, t(d)) for i, k, d in asks], "i int, k string, at timestamp")
    got = {r.i: r.found and r.found.uuid for r in FA.facts_as_of_keys(f, p, ["k"], hot_rows=hot).collect()}
    for i, k, d in asks:
        seen = [(fd, u) for u, fk, fd in facts if fk == k and fd <= d]
        best = max(seen) if seen else None
        assert got[i] == (best[1] if best and best[0] + 4 > d else None)


def test_summary_is_cut_and_counts_all(table):
    rows = [(f"{i:03d}", "hub", f"n{i}", f"fact {i:03d}", t(i), None) for i in range(60)] + [("x", "hub", "hub", "self", t(99), None), ("y", "hub", "n1", "old", t(0), t(1))]
    facts = table(rows, "uuid string, source_node_uuid string, target_node_uuid string, fact string, created_at timestamp, invalid_at timestamp")
    ent = table([("hub",), ("n1",), ("lonely",)], "uuid string")
    got = {r.uuid: r for r in FA.node_summary(ent, facts, 20).collect()}
    assert got["hub"].summary == "fact 000 fact 001 fa" and got["hub"].degree == 61
    assert got["n1"].summary == "fact 001" and (got["lonely"].summary, got["lonely"].degree) == ("", 0)
    for hot in (10**6, 10):
        full = {r.uuid: r.summary for r in FA.node_summary(ent, facts, hot_rows=hot).collect()}
        assert full["hub"] == " ".join([f"fact {i:03d}" for i in range(60)] + ["self"]) and full["lonely"] == ""
        rows = FA.node_facts(facts, hot).filter("node = 'hub'").orderBy("position").collect()
        assert [r.fact for r in rows] == [f"fact {i:03d}" for i in range(60)] + ["self"] and rows[-1].position == 61


def test_distance(table):
    edges = table([("1", "2"), ("2", "3"), ("3", "4"), ("1", "3"), ("8", "8")], "source_node_uuid string, target_node_uuid string")
    got = {r.node: r.distance for r in node_distance(edges, table([("1",)], "center string")).collect()}
    assert got == {"1": 0, "2": 1, "3": 1, "4": 2}


def test_random_distances(table):
    rnd = random.Random(8)
    pairs = [(str(rnd.randrange(60)), str(rnd.randrange(60))) for _ in range(70)] + [("hub", str(i)) for i in range(0, 60, 3)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    centers = ["0", "hub", "17"]
    want = {}
    for c in centers:
        level, seen = {c}, {c: 0}
        for d in range(1, 5):
            level = {m for n in level for m in near.get(n, ())} - set(seen)
            seen.update(dict.fromkeys(level, d))
        want.update({(c, n): d for n, d in seen.items()})
    got = node_distance(table(pairs, "source_node_uuid string, target_node_uuid string"), table([(c,) for c in centers], "center string"), 4)
    assert {(r.center, r.node): r.distance for r in got.collect()} == want


CAND = "episode_uuid string, group_id string, label string, name string, created_at timestamp, attributes map<string,string>"


def test_resolution(table):
    rows = [
        ("e1", "g", "L", " Ann  Lee", t(2), {"a": "1"}),
        ("e2", "g", "L", "ann lee", t(1), {"a": "0", "b": "2"}),
        ("e2", "g", "M", "ann lee", t(1), None),
        ("e3", "h", "L", "ann lee", t(3), {}),
    ]
    cand = table(rows, CAND)
    got = resolve_entities(cand)
    assert got.count() == 3
    ann = got.filter("group_id = 'g' and labels[0] = 'L'").first()
    assert (ann.name, ann.created_at, ann.attributes) == ("ann lee", t(1), {"a": "1", "b": "2"})
    more = resolve_entities(table([("e9", "g", "L", "ANN LEE", t(0), {"b": "1"})], CAND), got)
    again = more.filter("group_id = 'g' and labels[0] = 'L'").first()
    assert more.count() == 3 and again.uuid == ann.uuid and again.created_at == t(0) and again.attributes["b"] == "2"
    assert build_mentions(cand.unionByName(cand), got).count() == 4
    assert build_mentions(cand, got.filter("labels[0] = 'M'")).count() == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_names_are_all_single_edits(table):
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(0, 5))) for _ in range(120)})
    rows = [(f"{i:03d}", n, [rnd.choice("LM")], "g") for i, n in enumerate(names)]
    df = table(rows, "uuid string, name string, labels array<string>, group_id string")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] == b[2] and edits(a[1], b[1]) <= 1}
    assert {tuple(r) for r in similar_names(df).collect()} == want


def test_connected(table):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    pairs = chain + [("x", "y"), ("y", "z"), ("b", "a")]
    got = {r.uuid: r.root for r in connected(table(pairs, "a string, b string")).collect()}
    assert got == {**{f"c{i:02d}": "c00" for i in range(41)}, "x": "x", "y": "x", "z": "x", "a": "a", "b": "a"}
    assert connected(table([], "a string, b string")).count() == 0


def test_merge_similar(table):
    rows = [("e1", "g", "L", "Jon", t(2), {"a": "1"}), ("e2", "g", "L", "John", t(1), {"b": "2"}), ("e3", "g", "L", "Mary", t(1), {})]
    resolved = resolve_entities(table(rows, CAND))
    merged, moved = merge_similar(resolved)
    john = merged.filter("name = 'John'").first()
    assert merged.count() == 2 and moved.count() == 1 and john.attributes == {"a": "1", "b": "2"}
    assert moved.first().root == john.uuid


def test_similar_names_meet_under_any_label(table):
    rows = [("1", "g", ["A", "B"], "Jon"), ("2", "g", ["C", "B"], "John"), ("3", "g", ["C"], "Jo"), ("4", "h", ["B"], "Jon"), ("5", "g", None, "Jon")]
    pairs = similar_names(table(rows, "uuid string, group_id string, labels array<string>, name string"))
    assert sorted(map(tuple, pairs.collect())) == [("1", "2")]


def test_upsert(table):
    target = table([("a", 1, 0), ("b", 1, 0)], "uuid string, v int, n int")
    updates = table([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "uuid string, v int, n int")
    got = M.upsert(target, updates, order=["n"])
    assert sorted((r.uuid, r.v) for r in got.collect()) == [("a", 1), ("b", 3), ("c", 4)]
    same(got, M.upsert(got, updates, order=["n"]))


def graph(table):
    return {
        "episodes": table([("e1", "g", t(1)), ("e2", "h", t(2))], "uuid string, group_id string, reference_time timestamp"),
        "entities": table([("n1", "g"), ("n2", "g")], "uuid string, group_id string"),
        "facts": table([("f1", "g", "n1", "n2", None), ("f2", "g", "n1", "zz", t(3))], "uuid string, group_id string, source_node_uuid string, target_node_uuid string, invalid_at timestamp"),
        "mentions": table([("e1", "n1", "g"), ("e2", "n1", "h")], "episode_uuid string, entity_uuid string, group_id string"),
    }


def test_deletions(table):
    g = graph(table)
    kept, unknown = M.delete_facts(g["facts"], table([("f1",), ("q",)], "uuid string"))
    assert [r.uuid for r in kept.collect()] == ["f2"] and [r.uuid for r in unknown.collect()] == ["q"]
    episodes, mentions, unknown = M.delete_episodes(g["episodes"], g["mentions"], table([("e1",), ("q",)], "uuid string"))
    assert [r.uuid for r in episodes.collect()] == ["e2"] and [r.episode_uuid for r in mentions.collect()] == ["e2"]
    assert [r.uuid for r in unknown.collect()] == ["q"]
    episodes, mentions = M.delete_group_episodes(g["episodes"], g["mentions"], ["h"])
    assert episodes.count() == mentions.count() == 1


def test_clear(table):
    g = graph(table)
    empty = M.clear_graph(g)
    assert all(empty[n].count() == 0 and empty[n].schema == g[n].schema for n in g)
    assert {n: d.count() for n, d in M.clear_graph(g, ["h"]).items()} == {"episodes": 1, "entities": 2, "facts": 2, "mentions": 1}


def test_status(table):
    got = {r.group_id: r for r in M.graph_status(graph(table)).collect()}
    g, h = got["g"], got["h"]
    assert (g.episodes, g.entities, g.facts, g.active_facts, g.mentions, g.status) == (1, 2, 2, 1, 1, "error")
    assert g.error == "1 fact endpoints without entity" and g.newest_episode == t(1)
    assert (h.episodes, h.entities, h.status, h.error) == (1, 0, "ok", None)
