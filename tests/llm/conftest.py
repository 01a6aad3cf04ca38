import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from conftest_llm import ODD_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Odd texts with null and repeated ids and columns named like those operators add, read from files."""
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD_TEXTS)] + [(70, "A b"), (70, "A b"), (80, None)]
    clash = ", ".join(f"{i} AS {c}" for i, c in enumerate("place rank shard slot leaf ids decoded spans items fingerprint numbers score key host".split()))
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *clash.split(", ")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def documents(spark, testdata):
    return spark.read.parquet(f"{testdata}/documents.parquet")


@pytest.fixture
def recut(spark, tmp_path):
    """A function that reads rows from many small files, packed into few partitions, and one that collects a frame
    while each file is a partition of its own, as when executors come or go between two scans."""
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def read(rows, ddl):
        for i, row in enumerate(rows):
            spark.createDataFrame([row], ddl).coalesce(1).write.parquet(f"{tmp_path}/docs/n={i}")
        return spark.read.parquet(f"{tmp_path}/docs").drop("n")

    def collect(frame):
        before = {k: spark.conf.get(k) for k in sizes}
        try:
            for k in sizes:
                spark.conf.set(k, "1")
            return [tuple(r) for r in frame.collect()]
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    return read, collect
