from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1]) + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file:" + tempfile.mkdtemp(prefix="siftwell-tests-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df_rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in df_rows), key=repr)


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Spark's rows of a query equal those of its SQL."""

    def check(name):
        import __spark_entry__ as entry

        got = entry.queries()[name](spark, SF).toArrow()
        want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
        columns = sorted(got.column_names)
        assert columns == sorted(want.column_names)
        assert rows(got.to_pylist(), columns) == rows(want.to_pylist(), columns)

    return check
