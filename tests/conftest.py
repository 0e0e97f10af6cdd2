import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assayer.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local("4", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(params=["1", "7"])
def partitions(spark, request):
    """The same result is wanted for any number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
