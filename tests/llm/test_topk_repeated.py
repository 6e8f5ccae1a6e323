import numpy as np
from chronoweave.llm import topk
from test_topk import plain


def test_repeated_query_ids_leave_room_for_the_others(spark):
    """Copies with the query's own id do not take the places of neighbours; small whole numbers leave no slack to admit them."""
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) / 256 for x in draw.integers(0, 80, 8)]) for i in range(1, 200)]
    rows += [(0, [100 / 256] * 8)] * 30 + [(500, [90 / 256] * 8)] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(map(tuple, topk.top_k(frame, frame.filter("vec_id IN (0, 50, 500)"), k=5).collect()))
    assert got == plain(rows, [0, 50, 500], 5)


def test_a_block_of_own_rows_only(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0])] * 9 + [(2, [0.5, 0.25, 1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(frame, frame).count() == 0
