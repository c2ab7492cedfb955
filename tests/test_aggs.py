"""Aggregation and feature operators on hand-made frames: boundaries,
NULL arms, zero denominators, ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tally.operators import aggs as A
from tally.operators import features as fe
from tally.operators import ranking as rk


def test_cfa_expected_tiers_cap_and_null(spark):
    df = spark.createDataFrame([(50000.0, 1), (50000.0, 2), (50000.0, 3), (55000.0, 5), (None, 2), (50000.0, None)],
                               "Benchmark_Cost_per_kW double, System_Size_kW int")
    got = [r.c for r in df.select(fe.cfa_expected().alias("c")).collect()]
    assert got == [30000.0, 60000.0, 78000.0, 78000.0, None, None]


def test_cfa_error_flag_boundary(spark):
    df = spark.createDataFrame([(50000.0, 2, 59500.0), (50000.0, 2, 59499.0)],
                               "Benchmark_Cost_per_kW double, System_Size_kW int, CFA_Sanctioned_Rs double")
    assert [r.CFA_Error_Flag for r in fe.cfa_error_check(df).collect()] == [False, True]


def test_payback_months_and_buckets(spark):
    rows = [(100.0, 0.0, 1.0), (100.0, 0.0, 0.0), (100.0, 0.0, None), (3600.0, 0.0, 100.0), (7200.0, 0.0, 100.0),
            (1e6, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "Market_Cost_Rs double, CFA_Sanctioned_Rs double, Monthly_Bill_Savings_Rs double")
    out = df.withColumn("Payback_Months", fe.payback_months()).withColumn("cat", fe.payback_category()).collect()
    assert [r.Payback_Months for r in out] == [100.0, None, None, 36.0, 72.0, 360.0]
    assert [r.cat for r in out] == ["Long", "N/A", "N/A", "Short", "Medium", "Long"]


def test_anomaly_flags_nulls_false(spark):
    df = spark.createDataFrame([(78000.0, None, 100.0), (78000.01, 150.0, 100.0), (1.0, 151.0, 100.0)],
                               "CFA_Sanctioned_Rs double, Actual_Monthly_Units double, Expected_Monthly_Units double")
    rows = fe.anomaly_flags(df).collect()
    assert [(r.Anomaly_CFA_Breach, r.Anomaly_Units_Excess, r.Has_Anomaly) for r in rows] == [
        (False, False, False), (True, False, True), (False, True, True)]


def test_iqr_winsorize_preserves_rows(spark):
    vals = [float(v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 1000, -500]]
    df = spark.createDataFrame([(v,) for v in vals], "m double")
    b = fe.iqr_bounds(df, "m")
    w = fe.iqr_winsorize(df, "m", "c", b)
    assert w.count() == len(vals)
    bb = b.first()
    assert w.agg(F.max("c")).first()[0] == bb.upper_bound
    assert w.agg(F.min("c")).first()[0] == bb.lower_bound
    o = fe.iqr_outliers(df, "m", b).first()
    assert o.n_outliers == 2 and o.pct_outliers == 20.0


def test_missing_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    got = {r.column_name: (r.non_null, r.null_count, r.pct_missing) for r in fe.missing_profile(df).collect()}
    assert got == {"a": (2, 1, 33.33), "b": (1, 2, 66.67)}


def test_funnel_counts_and_dropoff(spark):
    df = spark.createDataFrame([(1, 1, None), (1, None, None), (None, None, None), (1, 1, 1)],
                               "a int, b int, c int")
    rows = A.funnel(df, [("all", None), ("a", "a"), ("b", "b"), ("c", "c")]).orderBy("stage_order").collect()
    assert [r["count"] for r in rows] == [4, 3, 2, 1]
    assert [r.dropoff_pct for r in rows] == [0.0, 25.0, 33.3, 50.0]


def test_funnel_zero_previous(spark):
    df = spark.createDataFrame([(None,)], "a int")
    rows = A.funnel(df, [("all", None), ("a", "a"), ("a2", "a")]).orderBy("stage_order").collect()
    assert [r.dropoff_pct for r in rows] == [0.0, 100.0, None]


def test_sla_boundary_and_nulls(spark):
    df = spark.createDataFrame([("D1", 30), ("D1", 31), ("D1", None), ("D2", 29)], "DISCOM string, lag int")
    got = {r.DISCOM: (r.Pct_Within_SLA, r.Avg_Lag_Days, r.Applications) for r in A.sla_compliance(df, lag="lag").collect()}
    assert got == {"D1": (50.0, 30.5, 2), "D2": (100.0, 29.0, 1)}


def test_resolution_table_null_tat_not_within(spark):
    df = spark.createDataFrame([("G1", True, 10), ("G1", False, None), ("G1", None, 40)],
                               "Grievance_Type string, Grievance_Resolved boolean, Grievance_TAT_Days int")
    r = A.resolution_table(df).first()
    assert (r.Total, r.Resolved, r.Avg_TAT_Days, r.Resolution_Rate_Pct, r.Pct_Within_SLA) == (2, 1, 25.0, 50.0, 33.3)


def test_stage_days_total_uses_rounded_means_and_nulls(spark):
    df = spark.createDataFrame([("S", 1, 2, None, None), ("S", 2, 2, None, None)],
                               "State string, a int, b int, c int, d int")
    r = A.stage_days_by(df, cols=["a", "b", "c", "d"]).first()
    assert (r.a, r.b, r.c, r.Total) == (1.5, 2.0, None, 3.5)


def test_concentration_shares_and_prefix(spark):
    rows = [("A",)] * 5 + [("B",)] * 3 + [("C",)] * 2
    df = spark.createDataFrame(rows, "State string")
    c = A.concentration_table(df).collect()
    assert [(r.State, r.Share_Pct, r.Cumulative_Pct) for r in c] == [("A", 50.0, 50.0), ("B", 30.0, 80.0),
                                                                     ("C", 20.0, 100.0)]
    p = rk.prefix_until(A.concentration_table(df), [("Installations", False), ("State", True)], "Share_Pct")
    assert [r.State for r in p.collect()] == ["A"]


def test_value_counts_denominators(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    a = {r.c: r.Percentage for r in A.value_counts(df, "c").collect()}
    n = {r.c: r.Percentage for r in A.value_counts(df, "c", denominator="non_null").collect()}
    assert a == {"x": 50.0, "y": 25.0} and n == {"x": 66.67, "y": 33.33}


def test_top_n_then_breakdown_ties(spark):
    rows = [("B", "c1"), ("B", "c2"), ("A", "c1"), ("A", "c1"), ("C", "c3")]
    df = spark.createDataFrame(rows, "l string, city string")
    out = [(r.Oil_Type, r.City, r.Count) for r in A.top_n_then_breakdown(df, "l", "city", n=2).collect()]
    assert out == [("A", "c1", 2), ("B", "c1", 1), ("B", "c2", 1)]


def test_dense_rank_keeps_ties(spark):
    df = spark.createDataFrame([("S", 1, 5.0), ("S", 2, 5.0), ("S", 3, 4.0), ("S", 4, 3.0), ("S", 5, 2.0)],
                               "State string, v int, r double")
    out = rk.dense_rank_top_n(df, ["State"], [("r", False)], 3, "Rank").collect()
    assert sorted((x.v, x.Rank) for x in out) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_lag_growth_and_running_total(spark):
    df = spark.createDataFrame([("2024-01", 10), ("2024-02", 0), ("2024-03", 5)], "m string, n long")
    out = rk.lag_growth(rk.running_total(df, "m", "n", "cum"), "m", "n", "prev", "g").orderBy("m").collect()
    assert [(r.cum, r.prev, r.g) for r in out] == [(10, None, None), (10, 10, -100.0), (15, 0, None)]


def test_fixed_order_drops_unknown(spark):
    df = spark.createDataFrame([("OBC", 1.0), ("BPL", 2.0), ("Other", 3.0)], "k string, v double")
    assert [r.k for r in rk.fixed_order(df, "k", ["BPL", "SC/ST", "OBC"]).collect()] == ["BPL", "OBC"]


def test_assign_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "State string")
    assert [(r.State, r.State_Code) for r in fe.assign_codes(df, "State").orderBy("State").collect()] == [
        ("a", "ST01"), ("b", "ST02")]


def test_monthly_trend(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 9),), (dt.date(2024, 2, 1),)],
                               "Application_Date date")
    assert [(r.App_Month, r.Applications) for r in A.monthly_trend(df).collect()] == [("2024-01", 2), ("2024-02", 1)]


def test_payback_pivot_counts_non_null(spark):
    df = spark.createDataFrame([("BPL", 100.0, 0.0, None), ("BPL", 100.0, 0.0, 10.0)],
                               "Beneficiary_Category string, Market_Cost_Rs double, CFA_Sanctioned_Rs double, "
                               "Monthly_Bill_Savings_Rs double")
    got = {r.Payback_Category: (r.Count, r.Avg_Payback) for r in A.payback_pivot(df).collect()}
    assert got == {"N/A": (0, None), "Short": (1, 10.0)}


@pytest.mark.parametrize("rate,expected", [(7.0, False), (7.01, True), (None, False)])
def test_violation_is_strict(spark, rate, expected):
    df = spark.createDataFrame([(1, "S", "BPL", 3, 1.0, rate, True)],
                               "Application_ID long, State string, Beneficiary_Category string, System_Size_kW int, "
                               "Loan_Amount_Rs double, Actual_Interest_Rate_pct double, Has_Loan boolean")
    codes = fe.assign_codes(df, "State")
    assert (A.violations(df, codes).count() == 1) is expected


def test_global_row_number_and_running_sum(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vals = rng.integers(0, 200, size=3000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(16)
    out = rk.global_row_number(df, ["x"], "rn", running_sum="x", sum_name="cum").orderBy("rn").collect()
    assert [r.rn for r in out] == list(range(1, len(vals) + 1))
    xs = [r.x for r in out]
    assert xs == sorted(vals.tolist())
    assert [r.cum for r in out] == pytest.approx(np.cumsum(sorted(vals)).tolist())
