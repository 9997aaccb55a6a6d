"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from tidemark.operators import sampling
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def shown(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_plan_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    names = ", ".join(f'"{c}"' for c in df.columns)
    assert shown(df.collect()) == shown(duck.execute(f"SELECT {names} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_exact_sample_of_too_few(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(50)], "message_id long, is_purchased int")
    with pytest.raises(ValueError, match="3 positives and 47 negatives"):
        sampling.exact_sample(df, 4, 10)
    assert sampling.exact_sample(df, 3, 10).groupBy("is_purchased").count().orderBy("is_purchased").collect() == [(0, 10), (1, 3)]


def test_entry_has_every_query():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
