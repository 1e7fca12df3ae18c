from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df, *columns):
    """Sorted tuples of a DataFrame."""
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


def same_rows(df, duck, sql):
    """A query's rows against its SQL's, columns by name."""
    names = sorted(df.columns)
    round_ = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(round_(r[n]) for n in names) for r in df.collect()), key=repr)
    cursor = duck.execute(sql)
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    want = sorted((tuple(round_(r[found.index(n)]) for n in names) for r in cursor.fetchall()), key=repr)
    assert got == want
