import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import check

SMALL = "/root/testdata/sf0.001"
FAST = ["a2_normalize_episodes", "b5_normalize_urls", "d2_conversation_episodes", "e6_search_nodes", "f15_apply_facts"]


def test_every_query_has_its_sql():
    # the training-data queries, where they are there, have tests of their own
    own = lambda names: {n for n in names if not re.match(r"op\d+_|pipeline$", n)}
    assert own(entry.queries()) == own(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ok, note = check.compare(spark, con, SMALL, name)
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
