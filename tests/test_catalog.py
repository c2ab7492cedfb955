"""Every registered query against its DuckDB oracle on the smallest test
tables, the SQL and DataFrame forms of each report against each other,
partition invariance, and the driver entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tally.plans import catalog
from tally.plans import reports as R
from tally.plans.bindings import BASE_TABLES, Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in {*BASE_TABLES, "orders", "events"}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((repr(tuple(_norm(r[i]) for i in order)) for r in rows))


WITH_ORACLE = [n for n in catalog.QUERIES if catalog.QUERIES[n][1] is not None]


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name][0](Tables(spark, SF))
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(catalog.oracle_sql(name))
    ocols = list(rel.columns)
    assert sorted(df.columns) == sorted(ocols)
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == {c: str(t) for c, t in zip(ocols, rel.types)}
    assert _bag(rows, df.columns) == _bag(rel.fetchall(), ocols)


@pytest.mark.parametrize("name", list(R.REPORTS))
def test_sql_and_dataframe_forms_agree(spark, tables, name):
    a = R.REPORTS[name](tables.applications())
    b = R.report_sql(spark, name, tables.applications())
    assert a.columns == b.columns
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()]


@pytest.mark.parametrize("name", ["s3_top_vendors", "payback_by_category", "stage_days_by", "label_mapping"])
def test_partition_invariance(spark, name):
    base = Tables(spark, SF)
    want = catalog.QUERIES[name][0](base).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for p in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            got = catalog.QUERIES[name][0](Tables(spark, SF)).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry_points(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert [f.name for f in df.schema.fields] == ["State", "Total_Applications", "Commissioned", "Conversion_Rate_Pct"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert "ols_standardised" in q and "ols_standardised" in o
