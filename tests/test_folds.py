import random
from datetime import datetime, timedelta

import pytest

from chronoweave.operators.folds import lifecycle, lifecycle_events, ttl_cache

T0 = datetime(2024, 1, 1)


def s(n):
    return T0 + timedelta(seconds=n)


def cache(rows, ttl):
    """The rule, row by row."""
    out, entry = {}, {}
    for k, when, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        hit = k in entry and when - entry[k] < ttl
        entry[k] = entry[k] if hit else when
        out[i] = (hit, s(entry[k]))
    return out


def run(table, rows, ttl, hot):
    df = table([(k, s(n), i) for k, n, i in rows], "k string, ts timestamp, id int")
    return {r.id: (r.hit, r.served_from) for r in ttl_cache(df, "k", "ts", "id", ttl, hot).collect()}


def test_hit_does_not_renew(table):
    got = run(table, [("k", n, i) for i, n in enumerate([0, 299, 300, 400, 601])], 300, 10**6)
    assert [got[i][0] for i in range(5)] == [False, True, False, True, False]


@pytest.mark.parametrize("hot", [10**6, 40])
@pytest.mark.parametrize("ttl, span", [(7, 400), (50, 60), (3, 5000)])
def test_cache_is_the_rule(table, hot, ttl, span):
    rnd = random.Random(ttl)
    rows = [(rnd.choice(["hot"] * 5 + ["a", "b", None]), rnd.randrange(span), i) for i in range(500)]
    assert run(table, rows, ttl, hot) == cache(rows, ttl)


LIFE = "k string, ts timestamp, id long, event string, message string"


def states(events):
    """The state machine, event by event."""
    now, start, done, error, ignored = "not_started", None, None, None, []
    for _, when, i, event, message in sorted(events, key=lambda e: (e[1], e[2])):
        if event == "fail":
            now, done, error = "failed", when, message
        elif event == "start" and now == "not_started":
            now, start = "in_progress", when
        elif event == "complete" and now == "in_progress":
            now, done = "completed", when
        else:
            ignored.append(i)
    return (now, start, done, error), ignored


def test_lifecycle_is_the_state_machine(table):
    rnd = random.Random(4)
    rows = []
    for k in range(300):
        for _ in range(rnd.randint(1, 6)):
            rows.append((f"k{k}", s(rnd.randrange(8)), len(rows), rnd.choice(["start", "complete", "complete", "fail", "start"]), f"m{len(rows)}"))
    df = table(rows, LIFE)
    got = {r.k: (r.state, r.start_time, r.completion_time, r.error) for r in lifecycle(df, ["k"]).collect()}
    ignored = {r.id for r in lifecycle_events(df, ["k"]).filter("ignored").collect()}
    for k in {r[0] for r in rows}:
        want, skipped = states([r for r in rows if r[0] == k])
        assert got[k] == want
        assert {r[2] for r in rows if r[0] == k} & ignored == set(skipped)


def test_durations(table):
    rows = [("a", s(1), 1, "start", None), ("a", s(3), 2, "complete", None), ("a", s(7), 3, "fail", "m"), ("b", s(2), 4, "start", None)]
    got = {r.k: r for r in lifecycle(table(rows, LIFE), ["k"], "2024-01-01 00:00:12").collect()}
    assert got["a"].duration_seconds == 6 and got["a"].elapsed_seconds is None and got["a"].error == "m"
    assert got["b"].duration_seconds is None and got["b"].elapsed_seconds == 10


@pytest.mark.parametrize("hot", [10**6, 3])
def test_events_without_a_time_are_misses(table, hot):
    rows = [("a", None, 1), ("a", None, 2), *[("a", T0 + timedelta(seconds=10 * i), 10 + i) for i in range(6)], (None, T0, 30), (None, T0, 31)]
    got = {r.id: (r.hit, r.served_from) for r in ttl_cache(table(rows, "k string, ts timestamp, id int"), "k", "ts", "id", 25, hot).collect()}
    assert got[1] == got[2] == (False, None)
    assert [got[10 + i][0] for i in range(6)] == [False, True, True, False, True, True]
    assert (got[30][0], got[31][0]) == (False, True)


def test_null_key_has_a_state_of_its_own(table):
    rows = [(None, T0, 1, "start", None), (None, T0 + timedelta(seconds=5), 2, "complete", None), ("a", T0, 3, "complete", None)]
    df = table(rows, "k string, ts timestamp, id long, event string, message string")
    assert {r.k: r.state for r in lifecycle(df, ["k"]).collect()} == {None: "completed", "a": "not_started"}
    assert {r.id: r.ignored for r in lifecycle_events(df, ["k"]).collect()} == {1: False, 2: False, 3: True}
