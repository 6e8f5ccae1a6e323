"""Hot keys cut into pieces give the results of the plain window."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import ordered as O
from tests.conftest import same

HOT = 60


@pytest.fixture(scope="module")
def rows(table):
    rnd = random.Random(7)
    data = [
        (
            rnd.choice(["hot"] * 6 + ["warm", "a", "b", None]),
            rnd.randrange(30),  # many equal times: the id decides
            f"id{i:05d}",
            rnd.choice([None, i]),
        )
        for i in range(2500)
    ]
    return table(data, "k string, t int, id string, v int").cache()


def test_pieces_are_many_small_and_ordered(rows):
    p = O.split_hot_keys(rows, ["k"], ["t", "id"], HOT)
    sizes = {(r.k, r._piece): r for r in p.df.groupBy("k", "_piece").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi")
    ).collect()}
    hot = sorted((piece, r) for (k, piece), r in sizes.items() if k == "hot")
    assert len(hot) > 10 and max(r.n for _, r in hot) < 6 * HOT
    assert all(a[1].hi < b[1].lo for a, b in zip(hot, hot[1:]))
    assert p.df.count() == rows.count()


@pytest.mark.parametrize(
    "fn, args",
    [(O.with_position, ("out",)), (O.with_next, (["t", "id"], "out")), (O.with_last_seen, ("v", "out"))],
)
def test_windows(rows, fn, args):
    same(fn(rows, ["k"], ["t", "id"], *args), fn(rows, ["k"], ["t", "id"], *args, hot_rows=HOT))


def test_one_time_only(table):
    """A key whose rows all have the same time is still cut, by id."""
    df = table([("k", 1, f"{i:04d}") for i in range(900)], "k string, t int, id string")
    assert O.split_hot_keys(df, ["k"], ["t", "id"], 50).df.select("_piece").distinct().count() > 5
    got = O.with_position(df, ["k"], ["t", "id"], "n", 50).filter(F.col("n") != F.col("id").cast("int") + 1)
    assert got.count() == 0


def test_joined_text(rows):
    rows = rows.withColumn("n", F.lit(1).cast("long"))
    args = (rows, ["k"], "id", F.col("v").cast("string"), "\n", "out", [F.sum("n").alias("n")])
    same(O.joined_in_order(*args), O.joined_in_order(*args, hot_rows=HOT))


def test_broadcast_only_when_small(rows):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in str(
        df._jdf.queryExecution().analyzed()
    )
    assert hint(O.broadcast_if_small(rows, 5000))
    assert not hint(O.broadcast_if_small(rows, 100))
