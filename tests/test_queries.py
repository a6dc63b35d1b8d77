"""Every registered query with SQL against DuckDB, and the flagship entry."""

import datetime
import decimal
import math

import duckdb
import pytest

from mnemoscope import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    result = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in result.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scores_reach_the_scan(spark):
    """Filters and columns go down to the Parquet scan."""
    plan = plans.QUERIES["flt_scope"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
    from mnemoscope.plans.views import table

    pushed = table(spark, SF, "events").where("event_type = 'click'").select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in pushed and "props" not in pushed
