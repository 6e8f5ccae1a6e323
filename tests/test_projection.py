from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.time import iso_utc
from chronoweave.operators import projection as P


def test_iso(table):
    df = table([(datetime(2024, 1, 1),), (datetime(2024, 1, 1, 0, 0, 0, 5),), (None,)], "t timestamp")
    assert [r[0] for r in df.select(iso_utc(F.col("t"))).collect()] == [
        "2024-01-01T00:00:00+00:00",
        "2024-01-01T00:00:00.000005+00:00",
        None,
    ]


def test_node_defaults(table):
    df = table(
        [("1", "n", None, None, "g", datetime(2024, 1, 1), None)],
        "uuid string, name string, summary string, labels array<string>, group_id string, created_at timestamp,"
        " attributes map<string,string>",
    )
    r = P.project_node_result(df).first()
    assert (r.summary, r.labels, r.attributes) == ("", [], {})


def test_fact_without_embedding(table):
    df = table(
        [("1", [0.5], {"fact_embedding": "x", "a": "1"}, datetime(2024, 1, 1))],
        "uuid string, fact_embedding array<float>, attributes map<string,string>, valid_at timestamp",
    )
    r = P.format_fact(df).first()
    assert r.asDict() == {"uuid": "1", "attributes": {"a": "1"}, "valid_at": "2024-01-01T00:00:00+00:00"}


def test_embedding_is_not_read(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(3).select(F.col("id").cast("string").alias("uuid"), F.array(F.lit(0.5)).alias("fact_embedding")).write.parquet(path)
    plan = P.format_fact(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "fact_embedding" not in plan


def test_json_keeps_nulls(table):
    df = table([("u", None, datetime(2024, 1, 1))], "uuid string, name string, reference_time timestamp")
    assert P.episodes_to_json(df).first().json == (
        '{"uuid":"u","name":null,"reference_time":"2024-01-01T00:00:00+00:00"}'
    )


def test_urls(table):
    urls = ["http://h:1/v1", "http://h:1/v1/", "http://h:1", "http://h:1//", "http://h/v1/x/v1", "ftp://h", "", None]
    df = table([(i, u) for i, u in enumerate(urls)], "id int, url string")
    got = {r.native_url: (r.first_id, r.n, r.has_http_scheme) for r in P.normalize_urls(df, "url", "id", default="http://d").collect()}
    assert got == {
        "http://h:1": (0, 4, True),
        "http://h/x": (4, 1, True),
        "ftp://h": (5, 1, False),
        "http://d": (6, 2, True),
    }


@pytest.mark.parametrize(
    "kind, default, blank, values",
    [
        ("bool", True, False, {"TRUE": True, "1": True, "Yes": True, "on": True, "false": False, "0": False, "off": False, "maybe": False, "": False, None: True}),
        ("int", 7, False, {"42": 42, "-3": -3, "x": 7, "3.5": 7, "4_2": 7, None: 7}),
        ("float", 0.5, True, {"3.14": 3.14, "x": 0.5, "  ": 0.5, None: 0.5}),
        ("str", "d", True, {"a": "a", "  ": "d", None: "d"}),
    ],
)
def test_clean(table, kind, default, blank, values):
    df = table([(v, v) for v in values], "raw string, c string")
    typed, counts = P.clean_columns(df, {"c": (kind, default, blank)})
    assert {r.raw: r.c for r in typed.collect()} == values
    fell = {"bool": 1, "int": 4, "float": 3, "str": 2}[kind]
    assert counts.first().fallbacks == fell
