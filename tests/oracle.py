"""Run audits and their SQL side by side and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_value(v) for v in value)
    return value


def rows(columns, records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(record[i]) for i in order) for record in records)


SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


def compare(spark, connection, root: str, audit, sql: str) -> str | None:
    """None when columns, types and all rows agree, else what differs."""
    frame = audit(spark, root)
    got = rows(frame.columns, frame.collect())
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = rows(columns, result.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    for name, kind in frame.dtypes:
        if SAME_TYPE.get(kind, kind) != types[name] and types[name] not in ("NULL", '"NULL"'):
            return f"type of {name}: {kind} != {types[name]}"
    if got != want:
        return (
            f"{sum(got.values())} rows != {sum(want.values())}; only here {list((got - want).items())[:3]}; "
            f"only there {list((want - got).items())[:3]}"
        )
    return None


def main(root: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from sweepledger.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(root)
    bad = 0
    for name, audit in entry.queries().items():
        if names and name not in names:
            continue
        sql = entry.oracle_sql().get(name)
        start = time.time()
        try:
            if sql is None:
                problem, n = None, audit(spark, root).count()
                print(f"rows  {name}: {n}")
                continue
            problem = compare(spark, connection, root, audit, sql)
            n = connection.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]
        except Exception as error:  # report and go on to the next audit
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        print(f"{'ok   ' if problem is None else 'BAD  '} {name}: {n} rows, {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
