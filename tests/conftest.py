import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sweepledger.session import local_session

    session = local_session("sweepledger-tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def testdata():
    return os.environ.get("TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture
def values(spark):
    """Evaluate an expression over rows of text columns, in row order."""

    def evaluate(expression, rows, *columns):
        schema = ", ".join(f"{c} STRING" for c in columns)
        data = [(i, *row) for i, row in enumerate(rows)]
        frame = spark.createDataFrame(data, f"i INT, {schema}").withColumn("result", expression)
        return [row["result"] for row in frame.orderBy("i").collect()]

    return evaluate
