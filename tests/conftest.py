import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronoweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(cpus="*", shuffle_partitions=4, memory="8g")


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def same(a, b):
    """Equal as bags of rows, whatever the order of the columns."""
    b = b.select(*a.columns)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
