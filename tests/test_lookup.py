from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import episodes as E
from chronoweave.operators import lookup as L
from chronoweave.schema import RAW_EPISODES

T0 = datetime(2024, 1, 1)
RAW = RAW_EPISODES


def raw(table, *rows):
    base = {f: None for f in RAW.names}
    return table([tuple({**base, **r}.values()) for r in rows], RAW)


def test_normalize_sources_and_groups(table):
    df = raw(
        table,
        *[{"name": s, "content": "c", "source": s} for s in ("text", "JSON", "Message", "csv")],
        {"name": "none", "group_id": None},
        {"name": "empty", "group_id": ""},
    )
    got = {r.name: r for r in E.normalize_episodes(df).collect()}
    assert [got[s].source for s in ("text", "JSON", "Message", "csv")] == ["text", "json", "message", "text"]
    assert (got["none"].group_id, got["empty"].group_id) == ("default", "")
    assert got["none"].source_description == "" and got["none"].reference_time is not None
    no_default = E.normalize_episodes(df, default_group=None).filter("name = 'none'").first()
    assert no_default.group_id == ""


def test_made_ids_repeat(table):
    df = raw(table, {"name": "n", "content": "émoji 🎉 漢字 العربية", "reference_time": T0}, {"uuid": "mine", "name": "n"})
    now = F.lit(T0)
    a, b = ([r.uuid for r in E.normalize_episodes(df, now=now).orderBy("content").collect()] for _ in range(2))
    assert a == b and "mine" in a
    assert E.normalize_episodes(df).filter("uuid <> 'mine'").first().content == "émoji 🎉 漢字 العربية"


def test_queue_position(table):
    rows = [("e%d" % i, "n", g, T0 + timedelta(seconds=i)) for i, g in enumerate(["g1", "g2", "g1", "g1"])]
    df = table(rows, "uuid string, name string, group_id string, reference_time timestamp")
    got = {r.uuid: (r.position, r.message) for r in E.queue_position(df).collect()}
    assert [got["e%d" % i][0] for i in range(4)] == [1, 1, 2, 3]
    assert got["e3"][1] == "Episode 'n' queued for processing (position: 3)"


def test_groups_and_labels(table):
    df = table([("a", "default", ["X"]), ("b", "", ["x"]), ("c", "g", [])], "uuid string, group_id string, labels array<string>")
    ids = lambda d: sorted(r.uuid for r in d.collect())
    assert ids(L.filter_groups(df)) == ["a"]
    assert ids(L.filter_groups(df, [])) == ["a", "b", "c"]
    assert ids(L.filter_groups(df, [""])) == ["b"]
    assert ids(L.filter_groups(df, table([("g",), ("g",)], "group_id string"))) == ["c"]
    assert ids(L.filter_label(df, "X")) == ["a"] and len(ids(L.filter_label(df))) == 3


def _episodes(table):
    rows = [("b", "g", T0), ("a", "g", T0), ("c", "g", T0 + timedelta(1)), ("d", "h", T0)]
    return table(rows, "uuid string, group_id string, reference_time timestamp")


def test_recent_episodes(table):
    ep = _episodes(table)
    ids = lambda d: [r.uuid for r in d.collect()]
    assert ids(L.get_episodes(ep, "g", 2)) == ["c", "a"]
    assert ids(L.get_episodes(ep, "g", 50)) == ["c", "a", "b"]
    assert ids(L.get_episodes(ep, "g", 5, F.lit(T0))) == ["a", "b"]
    empty = L.get_episodes(ep, "nobody")
    assert empty.collect() == [] and empty.columns == ep.columns
    assert {(r.uuid, r.position) for r in L.get_episodes_by_group(ep, 1).collect()} == {("c", 1), ("d", 1)}


def test_limits_are_checked(table):
    ep = _episodes(table)
    for call in (lambda: L.get_episodes(ep, "g", 0), lambda: L.top_k(ep, -1, [], ["uuid"])):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError, match="Group ID"):
        L.get_episodes(ep, None, default_group=None)


def test_group_limit_runs_before_the_shuffle(table):
    plan = L.get_episodes_by_group(_episodes(table), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_facts_by_id(table):
    facts = table([("f1", "x"), ("f2", "y")], "uuid string, fact string")
    assert L.get_fact(facts, "f1").first().fact == "x"
    missing = L.get_fact(facts, "zz").collect()
    assert len(missing) == 1 and missing[0].error.startswith("Error getting entity edge: ")
    found, unknown = L.get_facts(facts, table([("f2",), ("f2",), ("q",)], "uuid string"))
    assert [r.uuid for r in found.collect()] == ["f2"] and [r.uuid for r in unknown.collect()] == ["q"]


def test_membership(table):
    asked = table([("c",), ("z",), ("C",)], "key string")
    catalog = table([(i, k) for i, k in enumerate("abcdef")], "position int, key string")
    got = {r.key: (r.available, r.message) for r in L.check_membership(asked, catalog).collect()}
    assert got["c"] == (True, "Model available")
    assert got["z"] == (False, "Model 'z' not found. Available models: a, b, c, d, e")
    assert got["C"][0] is False
    none = L.check_membership(asked, catalog.limit(0)).filter("key = 'c'").first()
    assert none.message == "Model 'c' not found. Available models: (none)"
    skipped = L.check_membership(asked, None).first()
    assert skipped.available and skipped.message.startswith("Model validation skipped due to error:")
    other = L.check_membership(asked, catalog, noun="Part").filter("key = 'c'").first()
    assert other.message == "Part available"


def test_prompt(table):
    rows = [(1, 0, "system", "s"), (1, 1, None, "u"), (1, 2, "assistant", "a"), (1, 3, "tool", "t"), (1, 4, "USER", "x"),
            (1, 5, "user", "n"), (2, 0, "tool", "t"), (3, 0, "user", None)]
    df = table(rows, "conv_id int, turn int, role string, text string")
    for hot in (1_000_000, 2):
        got = {r.conv_id: r.prompt for r in E.messages_to_prompt(df, hot_rows=hot).collect()}
        assert got == {1: "System: s\nUser: u\nAssistant: a\nUser: n", 2: "", 3: "User: "}
