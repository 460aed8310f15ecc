import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(same, value)) + "]"
    if isinstance(value, int):
        return str(value)
    try:
        return "None" if value != value else f"{float(value):.6g}" if not isinstance(value, (str, bytes)) else str(value)
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(same(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, duck, sf_dir):
    """Whether a registered query and its SQL give the same columns and rows."""

    def check(name):
        import __spark_entry__ as entry

        df = entry.queries()[name](spark, sf_dir)
        found = df.collect()
        other = duck.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(other.columns)
        assert rows_of(df.columns, found) == rows_of(other.columns, other.fetchall())

    return check
