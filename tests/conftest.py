import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


def values(rows):
    """Rows of a frame or a list of tuples in an order of their own, floats rounded."""

    def one(x):
        if isinstance(x, float):
            return "nan" if x != x else repr(round(x, 6) + 0.0)
        if hasattr(x, "tolist"):
            x = x.tolist()
        return str([one(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.fixture(scope="session")
def agrees(spark, small):
    """Whether a registered query gives what its SQL gives."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(query, sql):
        got = query(spark, small)
        names = sorted(got.columns)
        rows = [tuple(r[c] for c in names) for r in got.collect()]
        want = con.execute(sql)
        have = [d[0] for d in want.description]
        assert sorted(have) == names
        order = [have.index(c) for c in names]
        assert values(rows) == values([tuple(r[k] for k in order) for r in want.fetchall()])

    return check
