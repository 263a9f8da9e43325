import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from newsloom.session import local_session

    session = local_session(4, "newsloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function on Python values: ``values(fn, "STRING", [..])``."""

    def run(function, kind, inputs):
        rows = [(i, value) for i, value in enumerate(inputs)]
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(rows, f"i INT, x {kind}")
        result = frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [row["y"] for row in result]

    return run
