import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1 -XX:+UseParallelGC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same_rows(df, relation):
    """Row sets of a Spark and a DuckDB result, by column name."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    ours = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
    assert ours == theirs
    return len(ours)
