"""Every registered query of the star tables against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
import tessera.queries as q

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def shown(v):
    return "" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, data, duck, name):
    ours, theirs = entry.queries()[name](spark, data).toPandas(), duck.execute(q.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_case_insensitive_join_meets_on_whole_tables(spark, data):
    customers = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_mktsegment").toPandas()
    got = entry.queries()["join_ci_text"](spark, data).toPandas().merge(customers, on="c_custkey")
    assert set(got.c_custkey) == set(customers.c_custkey) and (got.segment.str.lower() == got.c_mktsegment.str.lower()).all()
    assert (got.segment != got.c_mktsegment).sum() == len(customers)


def test_entry(spark):
    assert entry.entry(spark).count() >= 3


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = q.queries()["filter_order_gt"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25.0)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan
