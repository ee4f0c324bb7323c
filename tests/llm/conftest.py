import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def documents(spark):
    """documents from (doc_id, text) pairs, with a further column whose name clashes with many."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, score string, key string")

    return make


AWKWARD = [(1, None), (2, ""), (3, "   \n\n "), (4, "word"), (4, "word"), (None, "no id here at all, but words enough"), (5, "ß É İ ſ K 漢字 \U0001d11e"), (6, "\x00\x01 odd   bytes"), (7, "long " * 60_000)]


@pytest.fixture
def awkward():
    return list(AWKWARD)
