"""Named queries: one Spark job per operator of the inventory, each paired
(where SQL can express it) with an independent DuckDB oracle text over the
same bound views.

``QUERIES[name] = (fn(tables) -> DataFrame, oracle_body_or_None)``.
Oracle bodies reference the views ``applications``, ``collection`` and
``testing``; :func:`oracle_sql` prepends their binding CTEs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import null_false, pandas_round, pct
from ..operators import aggs as A
from ..operators import bags as bg
from ..operators import features as fe
from ..operators import ordered as od
from ..operators import quality as q
from ..operators import ranking as rk
from ..operators import sketches as sk
from ..operators import stats as st
from ..operators import table_functions as tf
from ..session import ensure_checkpoint_dir, remove_at_exit
from ..sources import io
from . import oracle as O
from . import reports as R
from . import workloads as W
from .bindings import Tables, duckdb_cte

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def oracle_sql(name: str) -> str | None:
    body = QUERIES[name][1]
    if body is None:
        return None
    head = duckdb_cte()
    body = body.strip()
    if body[:4].upper() == "WITH":
        return head.rstrip() + ",\n" + body[4:].lstrip()
    return head + body


# =========================================================== S1-S8 reports
_ORACLE_REPORTS = {
    "s1_state_conversion": """
WITH every AS (SELECT State, count(*) AS n FROM applications GROUP BY State),
done AS (SELECT State, count(Commission_Date) AS k FROM applications WHERE Commission_Date IS NOT NULL GROUP BY State)
SELECT e.State, e.n AS Total_Applications, coalesce(d.k, 0) AS Commissioned,
       round(100e0 * coalesce(d.k, 0) / e.n, 2) AS Conversion_Rate_Pct
FROM every e LEFT JOIN done d ON d.State IS NOT DISTINCT FROM e.State WHERE e.n > 49""",
    "s2_sla_breach_groups": """
WITH days AS (SELECT DISCOM, State, CFA_Credit_Days_After_Commission AS d, count(*) AS k FROM applications GROUP BY ALL),
total AS (SELECT DISCOM, State, sum(d * k) AS d, CAST(sum(k) AS BIGINT) AS k FROM days WHERE d IS NOT NULL GROUP BY ALL)
SELECT DISCOM, State, round(CAST(d AS DOUBLE) / k, 2) AS Avg_CFA_Days, k AS Applications_In_Breach FROM total WHERE d > 60 * k""",
    "s3_top_vendors": """
WITH mean AS (SELECT State, Vendor_ID, avg(Vendor_Rating) AS m, count(*) AS n FROM applications
              WHERE Commission_Date IS NOT NULL AND Vendor_Rating IS NOT NULL GROUP BY ALL)
SELECT a.State, a.Vendor_ID, round(a.m, 3) AS Avg_Rating, a.n AS Num_Installations,
       CAST(1 + count(DISTINCT better.m) AS BIGINT) AS Rating_Rank
FROM mean a LEFT JOIN mean better ON better.State IS NOT DISTINCT FROM a.State AND better.m > a.m
GROUP BY ALL HAVING count(DISTINCT better.m) < 3""",
    "s4_monthly_growth": """
WITH m AS (SELECT strftime(Application_Date, '%Y-%m') AS ym, count(*) AS n FROM applications GROUP BY ALL),
p AS (SELECT ym, n, (SELECT CAST(sum(o.n) AS BIGINT) FROM m o WHERE o.ym <= m.ym) AS upto,
             (SELECT arg_max(o.n, o.ym) FROM m o WHERE o.ym < m.ym) AS before FROM m)
SELECT ym AS Year_Month, n AS Monthly_Volume, upto AS Cumulative_Total, before AS Prev_Month_Volume,
       CASE WHEN before > 0 THEN round((n - before) * 100e0 / before, 2) END AS MoM_Growth_Rate_Pct FROM p""",
    "s5_grievance_summary": """
WITH split AS (SELECT Grievance_Type, Grievance_Resolved IS TRUE AS ok, count(*) AS n, sum(Grievance_TAT_Days) AS days,
                      count(Grievance_TAT_Days) AS timed
               FROM applications WHERE Has_Grievance IS TRUE GROUP BY ALL),
side AS (SELECT Grievance_Type, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS ok,
                round(CAST(sum(days) AS DOUBLE) / nullif(sum(timed), 0), 1) AS tat
         FROM split WHERE Grievance_Type IS NOT NULL GROUP BY ALL)
SELECT Grievance_Type, n AS Total_Count, ok AS Resolved_Count, round(100e0 * ok / n, 2) AS Resolution_Rate_Pct,
       tat AS Avg_TAT_Days,
       ['On Track', 'Requires Attention'][1 + greatest((round(100e0 * ok / n, 2) < 60)::INT, coalesce((tat > 30)::INT, 0))]
         AS SLA_Flag
FROM side""",
    "s6_incentive_gap": """
SELECT DISCOM, round(sum(DISCOM_Incentive_Received_Rs) FILTER (DISCOM_Incentive_Utilised_Rs IS NOT NULL), 2)
         AS Total_Incentive_Received,
       round(sum(DISCOM_Incentive_Utilised_Rs) FILTER (DISCOM_Incentive_Received_Rs IS NOT NULL), 2)
         AS Total_Incentive_Utilised,
       round(sum(DISCOM_Incentive_Received_Rs - DISCOM_Incentive_Utilised_Rs), 2) AS Unutilised_Gap,
       CASE WHEN DISCOM IS NOT NULL THEN round(avg(TFC_Processing_Days), 2) END AS Avg_TFC_Days
FROM applications GROUP BY DISCOM
HAVING count(DISCOM_Incentive_Received_Rs - DISCOM_Incentive_Utilised_Rs) > 0
ORDER BY sum(DISCOM_Incentive_Received_Rs - DISCOM_Incentive_Utilised_Rs) DESC, DISCOM NULLS FIRST LIMIT 10""",
    "s7_rate_brackets": """
SELECT ['Compliant (<=7%)', 'Marginal (7-9%)', 'Non-Compliant (>9%)'][
         1 + (Actual_Interest_Rate_pct > 7)::INT + (Actual_Interest_Rate_pct > 9)::INT] AS Rate_Bracket,
       count(*) AS Count, round(avg(Loan_Amount_Rs), 0) AS Avg_Loan_Amount,
       round(avg(System_Size_kW), 2) AS Avg_System_Size_kW,
       arg_min(State, ({'fewer': -per_state, 'name': State})) AS State_With_Highest_Count
FROM (SELECT *, count(*) OVER (PARTITION BY State, Actual_Interest_Rate_pct > 7, Actual_Interest_Rate_pct > 9) AS per_state
      FROM applications WHERE Has_Loan AND Actual_Interest_Rate_pct IS NOT NULL) GROUP BY Rate_Bracket""",
    "s8_underserved": """
SELECT State, count(*) AS Underserved_Count, round(sum(gap) / count(gap), 2) AS Avg_Out_Of_Pocket
FROM (SELECT State, Market_Cost_Rs - CFA_Sanctioned_Rs AS gap FROM applications a
      WHERE System_Size_kW = 3 AND list_contains(['BPL', 'SC/ST'], Beneficiary_Category)
        AND Loan_Approved IS NOT TRUE AND CFA_Sanctioned_Rs / Market_Cost_Rs < 0.5e0 AND Market_Cost_Rs > 0)
GROUP BY State""",
}
_ORACLE_REPORTS["s4_monthly_growth_peak"] = _ORACLE_REPORTS["s4_monthly_growth"] + """
ORDER BY coalesce(abs((n - before) / nullif(greatest(before, 0), 0)), 0) DESC, ym LIMIT 1"""


def _report_df(name):
    return lambda t: R.REPORTS[name](t.applications())


def _report_sql(name):
    return lambda t: R.report_sql(t.spark, name, t.applications())


for _n in R.REPORTS:
    QUERIES[_n] = (_report_df(_n), _ORACLE_REPORTS[_n])
    QUERIES[_n + "_sql"] = (_report_sql(_n), _ORACLE_REPORTS[_n])


# ======================================================= applications: A
_APP_COLS = ["Application_ID", "State", "DISCOM", "Beneficiary_Category", "System_Size_kW", "Vendor_ID",
             "Vendor_Rating", "Application_Date", "TFC_Date", "Installation_Date", "Commission_Date",
             "CFA_Credit_Date", "TFC_Processing_Days", "Installation_Days_After_TFC",
             "Commission_Days_After_Install", "CFA_Credit_Days_After_Commission", "Benchmark_Cost_per_kW",
             "Market_Cost_Rs", "CFA_Sanctioned_Rs", "Expected_Monthly_Units", "Actual_Monthly_Units",
             "Monthly_Bill_Savings_Rs", "Satisfaction_Score", "Has_Loan", "Loan_Approved", "Loan_Amount_Rs",
             "Actual_Interest_Rate_pct", "DISCOM_Incentive_Received_Rs", "DISCOM_Incentive_Utilised_Rs",
             "ALMM_Compliant", "Has_Grievance", "Grievance_Type", "Grievance_Resolved", "Grievance_TAT_Days"]

# The type as Spark names it, from what DuckDB says it is.
_SPARK_TYPE = ("CASE typeof(any_value({0})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' "
               "ELSE lower(typeof(any_value({0}))) END")
_MISSING_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {_SPARK_TYPE.format(c)} AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
    f"round_even(100e0 * (count(*) - count({c})) / count(*), 2) AS pct_missing FROM applications"
    for c in _APP_COLS)


@register("missing_profile", _MISSING_SQL)
def _missing_profile(t):
    return fe.missing_profile(t.applications())


_TPD = "CAST(date_diff('day', Application_Date, CFA_Credit_Date) AS INTEGER)"


def _describe_sql(expr: str, src: str, digits: int) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    r = lambda e: f"round_even({e}, {digits})"
    return (f"SELECT count({x}) AS count, {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS std, "
            f"{r(f'min({x})')} AS min, {r(f'quantile_cont({x}, 0.25)')} AS p25, "
            f"{r(f'quantile_cont({x}, 0.5)')} AS p50, {r(f'quantile_cont({x}, 0.75)')} AS p75, "
            f"{r(f'max({x})')} AS max FROM {src}")


@register("pipeline_days", _describe_sql(_TPD, f"applications WHERE Commission_Date IS NOT NULL AND {_TPD} IS NOT NULL", 1))
def _pipeline_days(t):
    a = t.applications().withColumn("Total_Pipeline_Days", fe.pipeline_days())
    a = a.where(F.col("Commission_Date").isNotNull() & F.col("Total_Pipeline_Days").isNotNull())
    return st.describe_numeric(a, "Total_Pipeline_Days", digits=1)


def _hist_sql(expr: str, src: str, bins: int) -> str:
    """Counts by edges: a value belongs to the bin whose edges hold it."""
    return f"""
WITH v AS (SELECT CAST({expr} AS DOUBLE) AS x FROM {src}),
b AS (SELECT min(x) - pad AS lo, max(x) + pad AS hi FROM v, (SELECT (min(x) = max(x))::INT * 0.5e0 AS pad FROM v
      WHERE NOT isnan(x)) WHERE NOT isnan(x) GROUP BY pad),
g AS (SELECT CAST(i AS INTEGER) AS bin, i * ((hi - lo) / {bins}e0) + lo AS bin_lo,
             CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * ((hi - lo) / {bins}e0) + lo END AS bin_hi
      FROM b, range(0, {bins}) r(i))
SELECT bin, bin_lo, bin_hi, count(x) AS count
FROM g LEFT JOIN v ON x >= bin_lo AND (x < bin_hi OR (bin = {bins - 1} AND x = bin_hi))
GROUP BY ALL"""


@register("pipeline_days_histogram",
          _hist_sql(_TPD, f"applications WHERE Commission_Date IS NOT NULL", 40))
def _pipeline_hist(t):
    a = t.applications().where(F.col("Commission_Date").isNotNull())
    return st.histogram_bins(a.withColumn("Total_Pipeline_Days", fe.pipeline_days()), "Total_Pipeline_Days", 40)


_IQR_CTE = """bnd AS (SELECT q1 AS Q1, q3 AS Q3, q3 - q1 AS IQR, q1 - 1.5e0 * (q3 - q1) AS lower_bound,
                   q3 + 1.5e0 * (q3 - q1) AS upper_bound
            FROM (SELECT quantile_cont(Market_Cost_Rs, 0.25) AS q1, quantile_cont(Market_Cost_Rs, 0.75) AS q3
                  FROM applications WHERE Market_Cost_Rs IS NOT NULL AND NOT isnan(Market_Cost_Rs)))"""


@register("iqr_bounds", f"WITH {_IQR_CTE} SELECT * FROM bnd")
def _iqr_bounds(t):
    return fe.iqr_bounds(t.applications(), "Market_Cost_Rs")


@register("iqr_outliers", f"""WITH {_IQR_CTE}
SELECT CAST(sum(CASE WHEN Market_Cost_Rs < lower_bound OR Market_Cost_Rs > upper_bound THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
       count(*) AS n_rows,
       100e0 * sum(CASE WHEN Market_Cost_Rs < lower_bound OR Market_Cost_Rs > upper_bound THEN 1 ELSE 0 END) / count(*) AS pct_outliers
FROM applications, bnd""")
def _iqr_outliers(t):
    a = t.applications()
    return fe.iqr_outliers(a, "Market_Cost_Rs", fe.iqr_bounds(a, "Market_Cost_Rs"))


@register("iqr_winsorize", f"""WITH {_IQR_CTE}
SELECT Application_ID, Market_Cost_Rs,
       CASE WHEN Market_Cost_Rs < lower_bound THEN lower_bound WHEN Market_Cost_Rs > upper_bound THEN upper_bound
            ELSE Market_Cost_Rs END AS Market_Cost_Rs_Clean
FROM applications, bnd""")
def _iqr_winsorize(t):
    a = t.applications()
    w = fe.iqr_winsorize(a, "Market_Cost_Rs", "Market_Cost_Rs_Clean", fe.iqr_bounds(a, "Market_Cost_Rs"))
    return w.select("Application_ID", "Market_Cost_Rs", "Market_Cost_Rs_Clean")


@register("market_cost_box", f"""WITH {_IQR_CTE},
long AS (SELECT 'Market_Cost_Rs' AS series, Market_Cost_Rs AS x FROM applications
         UNION ALL
         SELECT 'Market_Cost_Rs_Clean', CASE WHEN Market_Cost_Rs < lower_bound THEN lower_bound
                WHEN Market_Cost_Rs > upper_bound THEN upper_bound ELSE Market_Cost_Rs END FROM applications, bnd),
qs AS (SELECT series, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
              quantile_cont(x, 0.75) AS q3 FROM long WHERE x IS NOT NULL GROUP BY series),
f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo_f, q3 + 1.5e0 * (q3 - q1) AS hi_f FROM qs)
SELECT f.series, f.n, f.q1, f.median, f.q3,
       min(CASE WHEN x >= lo_f AND x <= hi_f THEN x END) AS lower_whisker,
       max(CASE WHEN x >= lo_f AND x <= hi_f THEN x END) AS upper_whisker,
       CAST(sum(CASE WHEN x >= lo_f AND x <= hi_f THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM long JOIN f ON long.series = f.series WHERE x IS NOT NULL
GROUP BY f.series, f.n, f.q1, f.median, f.q3""")
def _market_cost_box(t):
    a = t.applications()
    w = fe.iqr_winsorize(a, "Market_Cost_Rs", "Market_Cost_Rs_Clean", fe.iqr_bounds(a, "Market_Cost_Rs"))
    long = w.select("Market_Cost_Rs", "Market_Cost_Rs_Clean").unpivot(
        ids=[], values=["Market_Cost_Rs", "Market_Cost_Rs_Clean"], variableColumnName="series", valueColumnName="x")
    return st.box_stats(long, "x", ["series"])


@register("integrity_check", """
SELECT 'cfa_cap_breach' AS check_name, CAST(sum(CASE WHEN CFA_Sanctioned_Rs > 78000 THEN 1 ELSE 0 END) AS BIGINT) AS breaching,
       count(*) AS denominator,
       100e0 * sum(CASE WHEN CFA_Sanctioned_Rs > 78000 THEN 1 ELSE 0 END) / count(*) AS pct FROM applications
UNION ALL
SELECT 'units_excess', CAST(sum(CASE WHEN Actual_Monthly_Units / Expected_Monthly_Units > 1.5 THEN 1 ELSE 0 END) AS BIGINT),
       count(Actual_Monthly_Units),
       100e0 * sum(CASE WHEN Actual_Monthly_Units / Expected_Monthly_Units > 1.5 THEN 1 ELSE 0 END) / count(Actual_Monthly_Units)
FROM applications""")
def _integrity_check(t):
    a = t.applications()
    ratio = F.try_divide(F.col("Actual_Monthly_Units"), F.col("Expected_Monthly_Units"))
    return fe.integrity_check(a, {
        "cfa_cap_breach": (F.col("CFA_Sanctioned_Rs") > fe.SCHEME_CFA_MAX, None),
        "units_excess": (ratio > fe.UNITS_RATIO_LIMIT, F.col("Actual_Monthly_Units")),
    })


@register("integrity_breach_rows", """
SELECT Application_ID, State, System_Size_kW, CFA_Sanctioned_Rs FROM applications WHERE CFA_Sanctioned_Rs > 78000""")
def _integrity_rows(t):
    return t.applications().where(F.col("CFA_Sanctioned_Rs") > fe.SCHEME_CFA_MAX).select(
        "Application_ID", "State", "System_Size_kW", "CFA_Sanctioned_Rs")


@register("units_excess_rows", """
SELECT Application_ID, State, Expected_Monthly_Units, Actual_Monthly_Units,
       Actual_Monthly_Units / Expected_Monthly_Units AS Units_Ratio
FROM applications WHERE Actual_Monthly_Units IS NOT NULL AND Actual_Monthly_Units / Expected_Monthly_Units > 1.5""")
def _units_rows(t):
    a = fe.anomaly_flags(t.applications()).where(F.col("Actual_Monthly_Units").isNotNull() & F.col("Anomaly_Units_Excess"))
    return a.select("Application_ID", "State", "Expected_Monthly_Units", "Actual_Monthly_Units", "Units_Ratio")


@register("anomaly_flags", """
SELECT count(*) AS n_rows,
  CAST(sum(CASE WHEN CFA_Sanctioned_Rs > 78000 THEN 1 ELSE 0 END) AS BIGINT) AS n_cfa_breach,
  CAST(sum(CASE WHEN Actual_Monthly_Units / Expected_Monthly_Units > 1.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_units_excess,
  CAST(sum(CASE WHEN CFA_Sanctioned_Rs > 78000 OR coalesce(Actual_Monthly_Units / Expected_Monthly_Units > 1.5, false)
           THEN 1 ELSE 0 END) AS BIGINT) AS n_any
FROM applications""")
def _anomaly_flags(t):
    a = fe.anomaly_flags(t.applications())
    return a.agg(F.count("*").alias("n_rows"),
                 F.sum(F.col("Anomaly_CFA_Breach").cast("int")).cast("bigint").alias("n_cfa_breach"),
                 F.sum(F.col("Anomaly_Units_Excess").cast("int")).cast("bigint").alias("n_units_excess"),
                 F.sum(F.col("Has_Anomaly").cast("int")).cast("bigint").alias("n_any"))


_STAT_COLS = ["TFC_Processing_Days", "CFA_Credit_Days_After_Commission", "Monthly_Bill_Savings_Rs", "Satisfaction_Score"]
_SUMMARY_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round_even(avg(CAST({c} AS DOUBLE)), 2) AS Mean, "
    f"round_even(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS Median, "
    f"round_even(stddev_samp(CAST({c} AS DOUBLE)), 2) AS Std_Dev, round_even(min(CAST({c} AS DOUBLE)), 2) AS Min, "
    f"round_even(max(CAST({c} AS DOUBLE)), 2) AS Max, round_even(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS P25, "
    f"round_even(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS P75 FROM applications WHERE {c} IS NOT NULL"
    for c in _STAT_COLS)


@register("summary_stats", _SUMMARY_SQL)
def _summary_stats(t):
    return st.summary_stats(t.applications(), _STAT_COLS, digits=2)


# ======================================================= applications: B
_GAP = "(Market_Cost_Rs - Benchmark_Cost_per_kW * System_Size_kW) * 100e0 / (Benchmark_Cost_per_kW * System_Size_kW)"


@register("cost_gap_pct", f"""
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN {_GAP} > 20 THEN 1 ELSE 0 END) AS BIGINT) AS n_above_20,
       100e0 * sum(CASE WHEN {_GAP} > 20 THEN 1 ELSE 0 END) / count(*) AS pct_above_20 FROM applications""")
def _cost_gap_pct(t):
    a = fe.cost_gap(t.applications())
    flag = null_false(F.col("Market_Cost_Gap_Pct") > 20)
    return a.agg(F.count("*").alias("n_rows"), F.sum(flag.cast("int")).cast("bigint").alias("n_above_20")).select(
        "n_rows", "n_above_20", pct("n_above_20", "n_rows").alias("pct_above_20"))


@register("cost_gap_describe", _describe_sql(_GAP, "applications", 2))
def _cost_gap_describe(t):
    return st.describe_numeric(fe.cost_gap(t.applications()), "Market_Cost_Gap_Pct", digits=2)


@register("cost_gap_histogram", _hist_sql(_GAP, "applications", 50))
def _cost_gap_hist(t):
    return st.histogram_bins(fe.cost_gap(t.applications()), "Market_Cost_Gap_Pct", 50)


@register("breach_rate_by", """
SELECT State, 100e0 * sum(CASE WHEN Actual_Interest_Rate_pct > 7 THEN 1 ELSE 0 END) / count(*) AS Pct_Above_Mandate,
       100e0 * sum(CASE WHEN Actual_Interest_Rate_pct > 7 THEN 1 ELSE 0 END) / count(*) > 20 AS Flag_Over_20
FROM applications WHERE Has_Loan AND Actual_Interest_Rate_pct IS NOT NULL AND State IS NOT NULL GROUP BY State""")
def _breach_rate_by(t):
    loans = t.applications().where(F.col("Has_Loan") == True)  # noqa: E712
    return A.breach_rate_by(loans, "State", "Actual_Interest_Rate_pct", A.INTEREST_MANDATE_PCT)


@register("breach_rate_overall", """
SELECT count(*) AS n, 100e0 * sum(CASE WHEN Actual_Interest_Rate_pct > 7 THEN 1 ELSE 0 END) / count(*) AS pct
FROM applications WHERE Has_Loan AND Actual_Interest_Rate_pct IS NOT NULL""")
def _breach_overall(t):
    a = t.applications()
    return A.overall_rate(a, F.col("Actual_Interest_Rate_pct") > A.INTEREST_MANDATE_PCT,
                          where=(F.col("Has_Loan") == True) & F.col("Actual_Interest_Rate_pct").isNotNull())  # noqa: E712


_SLA_SQL = """
SELECT DISCOM,
  round_even(avg(CASE WHEN CFA_Credit_Days_After_Commission <= 30 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS Pct_Within_SLA,
  round_even(avg(CFA_Credit_Days_After_Commission), 1) AS Avg_Lag_Days, count(CFA_Credit_Days_After_Commission) AS Applications
FROM applications WHERE CFA_Credit_Days_After_Commission IS NOT NULL AND DISCOM IS NOT NULL GROUP BY DISCOM"""


@register("sla_compliance", _SLA_SQL)
def _sla(t):
    return A.sla_compliance(t.applications())


@register("sla_worst5", f"WITH s AS ({_SLA_SQL}) SELECT * FROM s ORDER BY Pct_Within_SLA, DISCOM LIMIT 5")
def _sla_worst5(t):
    return rk.top_k(A.sla_compliance(t.applications()), 5, [("Pct_Within_SLA", True), ("DISCOM", True)])


@register("sla_overall", """
SELECT count(*) AS n, 100e0 * sum(CASE WHEN CFA_Credit_Days_After_Commission <= 30 THEN 1 ELSE 0 END) / count(*) AS pct
FROM applications WHERE CFA_Credit_Days_After_Commission IS NOT NULL""")
def _sla_overall(t):
    a = t.applications()
    return A.overall_rate(a, F.col("CFA_Credit_Days_After_Commission") <= A.DBT_SLA_DAYS,
                          where=F.col("CFA_Credit_Days_After_Commission").isNotNull())


@register("mean_savings_by_size", """
SELECT System_Size_kW, avg(Monthly_Bill_Savings_Rs) AS Avg_Savings FROM applications
WHERE Monthly_Bill_Savings_Rs IS NOT NULL GROUP BY System_Size_kW""")
def _mean_by_size(t):
    return A.mean_by(t.applications(), "System_Size_kW", "Monthly_Bill_Savings_Rs", "Avg_Savings")


@register("mean_savings_by_category", """
SELECT Beneficiary_Category, round_even(avg(Monthly_Bill_Savings_Rs), 2) AS Avg_Savings FROM applications
WHERE Monthly_Bill_Savings_Rs IS NOT NULL AND Beneficiary_Category IN ('BPL', 'SC/ST', 'Women-headed', 'OBC', 'General')
GROUP BY Beneficiary_Category""")
def _mean_by_cat(t):
    return A.mean_by(t.applications(), "Beneficiary_Category", "Monthly_Bill_Savings_Rs", "Avg_Savings",
                     order=A.CATEGORY_ORDER, digits=2)


_UTIL_SQL = """
SELECT DISCOM, sum(DISCOM_Incentive_Received_Rs) AS Total_Received, sum(DISCOM_Incentive_Utilised_Rs) AS Total_Utilised,
       avg(TFC_Processing_Days) AS Avg_TFC_Days,
       round_even(sum(DISCOM_Incentive_Utilised_Rs) / sum(DISCOM_Incentive_Received_Rs) * 100e0, 2) AS Utilisation_Rate
FROM applications WHERE DISCOM_Incentive_Received_Rs IS NOT NULL AND DISCOM_Incentive_Utilised_Rs IS NOT NULL
  AND DISCOM IS NOT NULL GROUP BY DISCOM"""


@register("utilisation_rate", _UTIL_SQL)
def _util(t):
    return A.utilisation_rate(t.applications())


@register("utilisation_under_80", f"WITH u AS ({_UTIL_SQL}) SELECT DISCOM, Utilisation_Rate, Avg_TFC_Days FROM u "
                                  "WHERE Utilisation_Rate < 80")
def _util80(t):
    u = A.utilisation_rate(t.applications())
    return u.where(F.col("Utilisation_Rate") < A.UTILISATION_FLOOR_PCT).select("DISCOM", "Utilisation_Rate", "Avg_TFC_Days")


@register("pearson_utilisation_tfc", f"""WITH u AS ({_UTIL_SQL})
SELECT round(covar_pop(Utilisation_Rate, Avg_TFC_Days) / nullif(stddev_pop(Utilisation_Rate) * stddev_pop(Avg_TFC_Days), 0), 3) AS r,
       count(*) AS n
FROM u WHERE Utilisation_Rate IS NOT NULL AND Avg_TFC_Days IS NOT NULL""")
def _pearson_util(t):
    r = st.pearson(A.utilisation_rate(t.applications()), "Utilisation_Rate", "Avg_TFC_Days")
    return r.select(F.round("r", 3).alias("r"), "n")


# ======================================================= applications: C
@register("funnel", """
WITH c AS (SELECT count(*) AS s0, count(TFC_Date) AS s1, count(Installation_Date) AS s2, count(Commission_Date) AS s3,
                  count(CFA_Credit_Date) AS s4 FROM applications),
l AS (SELECT 0 AS stage_order, 'Applications Filed' AS stage, s0 AS count FROM c UNION ALL
      SELECT 1, 'Reached TFC', s1 FROM c UNION ALL SELECT 2, 'Reached Installation', s2 FROM c UNION ALL
      SELECT 3, 'Commissioned', s3 FROM c UNION ALL SELECT 4, 'CFA Credited', s4 FROM c),
p AS (SELECT *, lag(count) OVER (ORDER BY stage_order) AS prev FROM l)
SELECT CAST(stage_order AS INTEGER) AS stage_order, stage, count,
       CASE WHEN prev IS NULL THEN 0e0 ELSE round_even(CAST(prev - count AS DOUBLE) / prev * 100e0, 1) END AS dropoff_pct
FROM p""")
def _funnel(t):
    return A.funnel(t.applications())


_STAGE_SQL = """
SELECT State, round_even(avg(TFC_Processing_Days), 1) AS TFC_Processing_Days,
       round_even(avg(Installation_Days_After_TFC), 1) AS Installation_Days_After_TFC,
       round_even(avg(Commission_Days_After_Install), 1) AS Commission_Days_After_Install,
       round_even(avg(CFA_Credit_Days_After_Commission), 1) AS CFA_Credit_Days_After_Commission
FROM applications WHERE State IS NOT NULL GROUP BY State"""
_STAGE_TOTAL = ("coalesce(TFC_Processing_Days, 0) + coalesce(Installation_Days_After_TFC, 0) + "
                "coalesce(Commission_Days_After_Install, 0) + coalesce(CFA_Credit_Days_After_Commission, 0)")


@register("stage_days_by", f"WITH s AS ({_STAGE_SQL}) SELECT *, {_STAGE_TOTAL} AS Total FROM s")
def _stage_days(t):
    return A.stage_days_by(t.applications())


@register("stage_days_longest", f"WITH s AS ({_STAGE_SQL}) SELECT State, {_STAGE_TOTAL} AS Total FROM s "
                                "ORDER BY Total DESC, State LIMIT 1")
def _stage_longest(t):
    return rk.arg_max(A.stage_days_by(t.applications()), "State", "Total")


_ALMM_SQL = """
SELECT State, round_even(avg(CAST(ALMM_Compliant AS DOUBLE)) * 100e0, 2) AS ALMM_Compliance_Pct,
       round_even(avg(Vendor_Rating), 2) AS Avg_Vendor_Rating, count(*) AS Count
FROM applications WHERE Commission_Date IS NOT NULL AND State IS NOT NULL GROUP BY State"""


@register("compliance_vs_rating", _ALMM_SQL)
def _almm(t):
    return A.compliance_vs_rating(t.applications(), where=F.col("Commission_Date").isNotNull())


@register("almm_below_75", f"WITH s AS ({_ALMM_SQL}) SELECT State, ALMM_Compliance_Pct, Avg_Vendor_Rating FROM s "
                           "WHERE ALMM_Compliance_Pct < 75")
def _almm75(t):
    s = A.compliance_vs_rating(t.applications(), where=F.col("Commission_Date").isNotNull())
    return s.where(F.col("ALMM_Compliance_Pct") < A.ALMM_FLOOR_PCT).select("State", "ALMM_Compliance_Pct", "Avg_Vendor_Rating")


@register("pearson_almm_rating", f"""WITH s AS ({_ALMM_SQL})
SELECT round(covar_pop(ALMM_Compliance_Pct, Avg_Vendor_Rating)
             / nullif(stddev_pop(ALMM_Compliance_Pct) * stddev_pop(Avg_Vendor_Rating), 0), 3) AS r, count(*) AS n
FROM s WHERE ALMM_Compliance_Pct IS NOT NULL AND Avg_Vendor_Rating IS NOT NULL""")
def _pearson_almm(t):
    s = A.compliance_vs_rating(t.applications(), where=F.col("Commission_Date").isNotNull())
    return st.pearson(s, "ALMM_Compliance_Pct", "Avg_Vendor_Rating").select(F.round("r", 3).alias("r"), "n")


@register("grievance_type_counts", """
SELECT Grievance_Type, count(*) AS Count FROM applications WHERE Has_Grievance AND Grievance_Type IS NOT NULL
GROUP BY Grievance_Type""")
def _griev_counts(t):
    g = t.applications().where(F.col("Has_Grievance") == True)  # noqa: E712
    return A.value_counts(g, "Grievance_Type", pct_name=None)


@register("grievance_share", """
SELECT Grievance_Type, round_even(count(*) * 100e0 / sum(count(*)) OVER (), 1) AS Share_Pct FROM applications
WHERE Has_Grievance AND Grievance_Type IS NOT NULL GROUP BY Grievance_Type""")
def _griev_share(t):
    g = t.applications().where(F.col("Has_Grievance") == True)  # noqa: E712
    counts = A.value_counts(g, "Grievance_Type", pct_name=None)
    return rk.within_group_share(counts, [], "Count", "Share_Pct").select(
        "Grievance_Type", pandas_round("Share_Pct", 1).alias("Share_Pct"))


@register("resolution_table", """
SELECT Grievance_Type, count(Grievance_Resolved) AS Total,
       CAST(sum(CAST(Grievance_Resolved AS INTEGER)) AS BIGINT) AS Resolved,
       round_even(avg(Grievance_TAT_Days), 1) AS Avg_TAT_Days,
       round_even(sum(CAST(Grievance_Resolved AS INTEGER)) * 100e0 / count(Grievance_Resolved), 1) AS Resolution_Rate_Pct,
       round_even(avg(CASE WHEN Grievance_TAT_Days <= 30 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS Pct_Within_SLA
FROM applications WHERE Has_Grievance AND Grievance_Type IS NOT NULL GROUP BY Grievance_Type""")
def _resolution(t):
    g = t.applications().where(F.col("Has_Grievance") == True)  # noqa: E712
    return A.resolution_table(g)


def _ols_sql() -> str:
    """Least squares by Gauss-Jordan elimination of the covariance matrix of
    the z-scores, one CTE per pivot; the intercept of centred features is
    the target's mean."""
    names = ["System_Size_kW", "Monthly_Bill_Savings_Rs", "Vendor_Rating", "Grievance_Resolved", "Total_Pipeline_Days"]
    n = len(names)
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    ctes = [f"""d AS (SELECT CAST(System_Size_kW AS DOUBLE) AS x0, CAST(Monthly_Bill_Savings_Rs AS DOUBLE) AS x1,
    CAST(Vendor_Rating AS DOUBLE) AS x2, coalesce(CAST(CAST(Grievance_Resolved AS INTEGER) AS DOUBLE), 0e0) AS x3,
    CAST({_TPD} AS DOUBLE) AS x4, CAST(Satisfaction_Score AS DOUBLE) AS y FROM applications),
c AS (SELECT * FROM d WHERE x0 + x1 + x2 + x4 + y IS NOT NULL),
z AS (SELECT y, """ + ", ".join(
        f"(x{i} - avg(x{i}) OVER ()) / coalesce(nullif(stddev_pop(x{i}) OVER (), 0), 1) AS x{i}" for i in range(n))
        + " FROM c),\ne0 AS (SELECT avg(y) AS mean, var_pop(y) AS var, count(*) AS n, "
        + ", ".join(f"covar_pop(x{i}, {'y' if j == n else f'x{j}'}) AS a{i}{j}" for i, j in cells)
        + ", " + ", ".join(f"covar_pop(x{i}, y) AS b{i}" for i in range(n)) + " FROM z)"]
    for k in range(n):
        step = [f"a{k}{j} / a{k}{k} AS a{k}{j}" if i == k else f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}"
                for i, j in cells]
        ctes.append(f"e{k + 1} AS (SELECT mean, var, n, " + ", ".join(step) + ", "
                    + ", ".join(f"b{i}" for i in range(n)) + f" FROM e{k})")
    fit = " + ".join(f"a{i}{n} * b{i}" for i in range(n))
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS Feature, a{i}{n} AS w, mean, ({fit}) / var AS r2, n FROM e{n}" for i, x in enumerate(names))
    return ("WITH " + ",\n".join(ctes) + f", r AS ({rows}) SELECT Feature, round_even(w, 6) AS Coefficient, "
            "round_even(mean, 6) AS Intercept, round_even(r2, 6) AS R2, n AS Rows, "
            "abs(w) = max(abs(w)) OVER () AS Most_Influential FROM r")


@register("ols_standardised", _ols_sql())
def _ols(t):
    a = t.applications().withColumn("Total_Pipeline_Days", fe.pipeline_days())
    fit = st.ols_standardised(a, ["System_Size_kW", "Monthly_Bill_Savings_Rs", "Vendor_Rating", "Grievance_Resolved",
                                  "Total_Pipeline_Days"], "Satisfaction_Score", fill_zero=["Grievance_Resolved"])
    return fit.withColumns({c: pandas_round(c, 6) for c in ("Coefficient", "Intercept", "R2")})


# ======================================================= applications: D
@register("category_share", """
SELECT Beneficiary_Category, count(*) AS Count, round_even(count(*) / sum(count(*)) OVER () * 100e0, 2) AS Share_Pct
FROM applications WHERE Beneficiary_Category IS NOT NULL GROUP BY Beneficiary_Category""")
def _cat_share(t):
    return A.value_counts(t.applications(), "Beneficiary_Category", pct_name="Share_Pct", denominator="non_null")


@register("share_vs_benchmark", """
WITH s AS (SELECT Beneficiary_Category,
                  round_even(count(*) / sum(count(*)) OVER () * 100e0, 2) AS Share_Pct
           FROM applications WHERE Beneficiary_Category IS NOT NULL GROUP BY Beneficiary_Category),
m AS (SELECT round_even(sum(Share_Pct), 2) AS Subset_Share_Pct FROM s
      WHERE Beneficiary_Category IN ('BPL', 'SC/ST', 'Women-headed'))
SELECT Subset_Share_Pct, 55e0 AS Benchmark_Pct, round_even(Subset_Share_Pct - 55e0, 2) AS Gap_Pct,
       CASE WHEN Subset_Share_Pct - 55e0 > 0 THEN 'over-represents' ELSE 'under-represents' END AS Representation FROM m""")
def _share_bench(t):
    return A.share_vs_benchmark(t.applications())


_CONC_SQL = """
WITH c AS (SELECT State, count(*) AS Installations FROM applications
           WHERE Commission_Date IS NOT NULL AND State IS NOT NULL GROUP BY State),
s AS (SELECT *, round_even(Installations / sum(Installations) OVER () * 100e0, 2) AS Share_Pct FROM c),
cum AS (SELECT *, round_even(sum(Share_Pct) OVER (ORDER BY Installations DESC, State
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS Cumulative_Pct,
               coalesce(sum(Share_Pct) OVER (ORDER BY Installations DESC, State
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_pct FROM s)"""


@register("concentration_table", _CONC_SQL + " SELECT State, Installations, Share_Pct, Cumulative_Pct FROM cum")
def _conc(t):
    return A.concentration_table(t.applications(), where=F.col("Commission_Date").isNotNull())


@register("prefix_until", _CONC_SQL + " SELECT State, Installations, Share_Pct, Cumulative_Pct FROM cum WHERE before_pct < 50")
def _prefix(t):
    c = A.concentration_table(t.applications(), where=F.col("Commission_Date").isNotNull())
    return rk.prefix_until(c, [("Installations", False), ("State", True)], "Share_Pct", 50.0)


_INSTALLS = """c AS (SELECT State, CAST(count(*) AS DOUBLE) AS x FROM applications
                     WHERE Commission_Date IS NOT NULL AND State IS NOT NULL GROUP BY State)"""


@register("gini", f"""WITH {_INSTALLS},
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM c),
a AS (SELECT count(*) AS n, sum(x) AS total, sum(i * x) AS ix FROM r)
SELECT n, (n + 1 - 2e0 * (((n + 1) * total - ix) / total)) / n AS gini FROM a""")
def _gini(t):
    c = A.concentration_table(t.applications(), where=F.col("Commission_Date").isNotNull())
    return st.gini(c, "Installations")


@register("lorenz_points", f"""WITH {_INSTALLS},
r AS (SELECT row_number() OVER (ORDER BY x) AS i,
             sum(x) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             count(*) OVER () AS n, sum(x) OVER () AS total FROM c)
SELECT CAST(0 AS BIGINT) AS i, 0e0 AS pop_share, 0e0 AS cum_share
UNION ALL SELECT CAST(i AS BIGINT), i / n, cum / total FROM r""")
def _lorenz(t):
    c = A.concentration_table(t.applications(), where=F.col("Commission_Date").isNotNull())
    return st.lorenz_points(c, "Installations")


_RATIO = "Actual_Monthly_Units / Expected_Monthly_Units"


@register("pivot_mean", "SELECT State, " + ", ".join(
    f"round_even(avg(CASE WHEN System_Size_kW = {k} THEN {_RATIO} END), 3) AS kw_{k}" for k in range(1, 6)) +
    f" FROM applications WHERE Actual_Monthly_Units IS NOT NULL AND State IS NOT NULL GROUP BY State")
def _pivot(t):
    a = t.applications().where(F.col("Actual_Monthly_Units").isNotNull())
    a = a.withColumn("Performance_Ratio", fe.performance_ratio())
    return A.pivot_mean(a, "State", "System_Size_kW", "Performance_Ratio")


@register("underperform_counts", f"""
SELECT State, System_Size_kW, count(*) AS Rows_Below FROM applications
WHERE Actual_Monthly_Units IS NOT NULL AND {_RATIO} < 0.85 AND State IS NOT NULL AND System_Size_kW IS NOT NULL
GROUP BY State, System_Size_kW""")
def _underperf(t):
    a = t.applications().where(F.col("Actual_Monthly_Units").isNotNull())
    a = a.withColumn("Performance_Ratio", fe.performance_ratio())
    return A.underperform_counts(a, ["State", "System_Size_kW"], "Performance_Ratio")


_PB = ("CASE WHEN (Market_Cost_Rs - CFA_Sanctioned_Rs) / Monthly_Bill_Savings_Rs > 360 THEN 360e0 "
       "ELSE (Market_Cost_Rs - CFA_Sanctioned_Rs) / Monthly_Bill_Savings_Rs END")
_PB_ALL = f"CASE WHEN Monthly_Bill_Savings_Rs > 0 THEN {_PB} END"


@register("payback_by_category", f"""
WITH p AS (SELECT Beneficiary_Category AS k, {_PB} AS x FROM applications
           WHERE Monthly_Bill_Savings_Rs IS NOT NULL AND Monthly_Bill_Savings_Rs > 0 AND Beneficiary_Category IS NOT NULL)
SELECT k AS Beneficiary_Category, round_even(quantile_cont(x, 0.5), 1) AS median, round_even(avg(x), 1) AS mean,
       round_even(min(x), 1) AS min, round_even(max(x), 1) AS max FROM p WHERE x IS NOT NULL GROUP BY k""")
def _payback_cat(t):
    return A.payback_by_category(t.applications())


@register("payback_bpl_vs_general", f"""
WITH p AS (SELECT Beneficiary_Category AS k, {_PB} AS x FROM applications
           WHERE Monthly_Bill_Savings_Rs IS NOT NULL AND Monthly_Bill_Savings_Rs > 0)
SELECT round_even(quantile_cont(x, 0.5) FILTER (WHERE k = 'BPL'), 1) AS bpl_median,
       round_even(quantile_cont(x, 0.5) FILTER (WHERE k = 'General'), 1) AS general_median FROM p""")
def _payback_bpl(t):
    pb = A.payback_frame(t.applications()).where(F.col("Beneficiary_Category").isin("BPL", "General"))
    med = st.exact_quantiles(pb, "Payback_Months", [0.5], ["Beneficiary_Category"], names=["median"])
    return med.agg(
        pandas_round(F.max(F.when(F.col("Beneficiary_Category") == "BPL", F.col("median"))), 1).alias("bpl_median"),
        pandas_round(F.max(F.when(F.col("Beneficiary_Category") == "General", F.col("median"))), 1).alias("general_median"))


@register("payback_box_stats", f"""
WITH p AS (SELECT Beneficiary_Category AS k, {_PB} AS x FROM applications
           WHERE Monthly_Bill_Savings_Rs IS NOT NULL AND Monthly_Bill_Savings_Rs > 0 AND Beneficiary_Category IS NOT NULL),
q AS (SELECT k, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
      FROM p WHERE x IS NOT NULL GROUP BY k),
f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo_f, q3 + 1.5e0 * (q3 - q1) AS hi_f FROM q)
SELECT f.k AS Beneficiary_Category, f.n, f.q1, f.median, f.q3,
       min(CASE WHEN x >= lo_f AND x <= hi_f THEN x END) AS lower_whisker,
       max(CASE WHEN x >= lo_f AND x <= hi_f THEN x END) AS upper_whisker,
       CAST(sum(CASE WHEN x >= lo_f AND x <= hi_f THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM p JOIN f ON p.k = f.k WHERE x IS NOT NULL GROUP BY f.k, f.n, f.q1, f.median, f.q3""")
def _payback_box(t):
    pb = A.payback_frame(t.applications()).where(F.col("Beneficiary_Category").isNotNull())
    return st.box_stats(pb, "Payback_Months", ["Beneficiary_Category"])


# ======================================================= applications: E
@register("state_summary", """
SELECT State, count(Application_ID) AS Total_Applications,
       round_even(count(Commission_Date) * 1e0 / count(Application_ID) * 100e0, 2) AS Pct_Commissioned,
       round_even(avg(Monthly_Bill_Savings_Rs), 2) AS Avg_Bill_Savings, round_even(avg(Satisfaction_Score), 3) AS Avg_Satisfaction,
       round_even(sum(CAST(ALMM_Compliant AS INTEGER)) * 1e0 / count(Application_ID) * 100e0, 2) AS ALMM_Compliance_Pct,
       coalesce(round_even(count(Commission_Date) * 1e0 / count(Application_ID) * 100e0, 2) < 60, false) AS Low_Commissioning
FROM applications WHERE State IS NOT NULL GROUP BY State""")
def _state_summary(t):
    return A.state_summary(t.applications())


_CFA = ("CASE WHEN Benchmark_Cost_per_kW IS NOT NULL AND System_Size_kW IS NOT NULL THEN least("
        "CASE WHEN System_Size_kW <= 2 THEN 0.6e0 * Benchmark_Cost_per_kW * System_Size_kW "
        "ELSE 0.6e0 * Benchmark_Cost_per_kW * 2 + 0.4e0 * Benchmark_Cost_per_kW * (System_Size_kW - 2) END, 78000e0) END")


@register("cfa_check", f"""
WITH c AS (SELECT *, {_CFA} AS Calculated_CFA FROM applications)
SELECT Application_ID, State, System_Size_kW, Benchmark_Cost_per_kW, Market_Cost_Rs, CFA_Sanctioned_Rs, Calculated_CFA,
       Calculated_CFA - CFA_Sanctioned_Rs AS CFA_Error, coalesce(abs(Calculated_CFA - CFA_Sanctioned_Rs) > 500, false) AS CFA_Error_Flag
FROM c""")
def _cfa_check(t):
    c = fe.cfa_error_check(t.applications())
    return c.select("Application_ID", "State", "System_Size_kW", "Benchmark_Cost_per_kW", "Market_Cost_Rs",
                    "CFA_Sanctioned_Rs", "Calculated_CFA", "CFA_Error", "CFA_Error_Flag")


@register("cfa_error_summary", f"""
WITH c AS (SELECT coalesce(abs({_CFA} - CFA_Sanctioned_Rs) > 500, false) AS f FROM applications)
SELECT count(*) AS Total_Records, CAST(sum(CAST(f AS INTEGER)) AS BIGINT) AS CFA_Errors,
       100e0 * sum(CAST(f AS INTEGER)) / count(*) AS Error_Rate_Pct FROM c""")
def _cfa_summary(t):
    return fe.cfa_error_summary(fe.cfa_error_check(t.applications()))


@register("topn_state_stage_means", """
WITH top AS (SELECT State FROM applications WHERE State IS NOT NULL GROUP BY State ORDER BY count(*) DESC, State LIMIT 10)
SELECT State, round_even(avg(TFC_Processing_Days), 1) AS TFC_Processing_Days,
       round_even(avg(Installation_Days_After_TFC), 1) AS Installation_Days_After_TFC,
       round_even(avg(Commission_Days_After_Install), 1) AS Commission_Days_After_Install,
       round_even(avg(CFA_Credit_Days_After_Commission), 1) AS CFA_Credit_Days_After_Commission
FROM applications WHERE State IN (SELECT State FROM top) GROUP BY State""")
def _topn_stage(t):
    return A.topn_state_stage_means(t.applications())


@register("monthly_trend", """
SELECT strftime(Application_Date, '%Y-%m') AS App_Month, count(*) AS Applications FROM applications
WHERE Application_Date IS NOT NULL GROUP BY 1""")
def _monthly_trend(t):
    return A.monthly_trend(t.applications())


@register("vendor_summary", """
SELECT Vendor_ID, count(Application_ID) AS Total_Installations, round_even(avg(Vendor_Rating), 3) AS Avg_Vendor_Rating,
       CAST(sum(CAST(ALMM_Compliant AS INTEGER)) AS BIGINT) AS ALMM_Compliant_Count,
       CAST(sum(CAST(Has_Grievance AS INTEGER)) AS BIGINT) AS Grievance_Count,
       round_even(sum(CAST(Has_Grievance AS INTEGER)) * 1e0 / count(Application_ID) * 100e0, 2) AS Grievance_Pct,
       coalesce(round_even(sum(CAST(Has_Grievance AS INTEGER)) * 1e0 / count(Application_ID) * 100e0, 2) > 30, false)
         AS High_Grievance
FROM applications WHERE Vendor_ID IS NOT NULL GROUP BY Vendor_ID""")
def _vendor_summary(t):
    return A.vendor_summary(t.applications())


_CODES = """codes AS (SELECT State, printf('ST%02d', row_number() OVER (ORDER BY State)) AS State_Code
                   FROM (SELECT DISTINCT State FROM applications WHERE State IS NOT NULL))"""


@register("state_codes", f"WITH {_CODES} SELECT * FROM codes")
def _codes(t):
    return fe.assign_codes(t.applications(), "State")


# 100 vendors and more: ordinals outgrow their padding.
@register("vendor_codes", """SELECT Vendor_ID, printf('V%02d', row_number() OVER (ORDER BY Vendor_ID)) AS Vendor_Code
FROM (SELECT DISTINCT Vendor_ID FROM applications WHERE Vendor_ID IS NOT NULL)""")
def _vendor_codes(t):
    return fe.assign_codes(t.applications(), "Vendor_ID", prefix="V", code="Vendor_Code")


_VIOL = f"""WITH {_CODES},
v AS (SELECT a.Application_ID, a.State, a.Beneficiary_Category, a.System_Size_kW, a.Loan_Amount_Rs,
             a.Actual_Interest_Rate_pct, c.State_Code AS State_Code_Lookup, 'Interest Rate > 7% Mandate' AS Violation
      FROM applications a LEFT JOIN codes c ON a.State = c.State
      WHERE a.Has_Loan AND a.Actual_Interest_Rate_pct > 7)"""


@register("violations", _VIOL + " SELECT * FROM v")
def _violations(t):
    a = t.applications()
    return A.violations(a, fe.assign_codes(a, "State"))


@register("violations_by_state", _VIOL + """ SELECT State, count(*) AS Violation_Count, count(*) > 20 AS High_Violations
FROM v WHERE State IS NOT NULL GROUP BY State""")
def _viol_state(t):
    a = t.applications()
    return A.violations_by_state(a)


@register("payback_rows", f"""
WITH p AS (SELECT *, {_PB_ALL} AS pm FROM applications WHERE Monthly_Bill_Savings_Rs IS NOT NULL)
SELECT Application_ID, State, Beneficiary_Category, System_Size_kW, Market_Cost_Rs, CFA_Sanctioned_Rs, Monthly_Bill_Savings_Rs,
       round_even(pm, 1) AS Payback_Months,
       CASE WHEN pm IS NULL THEN 'N/A' WHEN pm <= 36 THEN 'Short' WHEN pm <= 72 THEN 'Medium' ELSE 'Long' END AS Payback_Category
FROM p""")
def _payback_rows(t):
    a = t.applications().where(F.col("Monthly_Bill_Savings_Rs").isNotNull())
    a = a.withColumn("Payback_Months", fe.payback_months()).withColumn("Payback_Category", fe.payback_category())
    return a.select("Application_ID", "State", "Beneficiary_Category", "System_Size_kW", "Market_Cost_Rs",
                    "CFA_Sanctioned_Rs", "Monthly_Bill_Savings_Rs",
                    pandas_round("Payback_Months", 1).alias("Payback_Months"), "Payback_Category")


@register("payback_pivot", f"""
WITH p AS (SELECT Beneficiary_Category, {_PB_ALL} AS pm FROM applications WHERE Beneficiary_Category IS NOT NULL)
SELECT Beneficiary_Category,
       CASE WHEN pm IS NULL THEN 'N/A' WHEN pm <= 36 THEN 'Short' WHEN pm <= 72 THEN 'Medium' ELSE 'Long' END AS Payback_Category,
       count(pm) AS Count, round_even(avg(pm), 1) AS Avg_Payback
FROM p GROUP BY 1, 2""")
def _payback_pivot(t):
    return A.payback_pivot(t.applications())


@register("enriched", f"""WITH {_IQR_CTE}
SELECT Application_ID, {_TPD} AS Total_Pipeline_Days,
       CASE WHEN Market_Cost_Rs < lower_bound THEN lower_bound WHEN Market_Cost_Rs > upper_bound THEN upper_bound
            ELSE Market_Cost_Rs END AS Market_Cost_Rs_Clean,
       Actual_Monthly_Units / Expected_Monthly_Units AS Units_Ratio,
       coalesce(CFA_Sanctioned_Rs > 78000, false) AS Anomaly_CFA_Breach,
       coalesce(Actual_Monthly_Units / Expected_Monthly_Units > 1.5, false) AS Anomaly_Units_Excess,
       coalesce(CFA_Sanctioned_Rs > 78000, false) OR coalesce(Actual_Monthly_Units / Expected_Monthly_Units > 1.5, false)
         AS Has_Anomaly,
       Benchmark_Cost_per_kW * System_Size_kW AS Benchmark_Total_Cost, {_GAP} AS Market_Cost_Gap_Pct
FROM applications, bnd""")
def _enriched(t):
    e = W.enriched(t.applications())
    return e.select("Application_ID", "Total_Pipeline_Days", "Market_Cost_Rs_Clean", "Units_Ratio", "Anomaly_CFA_Breach",
                    "Anomaly_Units_Excess", "Has_Anomaly", "Benchmark_Total_Cost", "Market_Cost_Gap_Pct")


@register("row_counts", """
SELECT 'applications' AS table_name, count(*) AS n_rows FROM applications UNION ALL
SELECT 'collection', count(*) FROM collection UNION ALL SELECT 'testing', count(*) FROM testing""")
def _row_counts(t):
    from ..sources.io import row_counts
    return row_counts({"applications": t.applications(), "collection": t.collection(), "testing": t.testing()})


# ======================================================= sample forms (A)
@register("clean_label", """
SELECT DISTINCT oil_raw, trim(regexp_replace(oil_raw, '\\s+', ' ', 'g')) AS cleaned,
       lower(trim(regexp_replace(oil_raw, '\\s+', ' ', 'g'))) AS lower,
       regexp_replace(lower(trim(regexp_replace(oil_raw, '\\s+', ' ', 'g'))), '\\s+', '', 'g') AS nospace
FROM collection WHERE oil_raw IS NOT NULL""")
def _clean_label(t):
    d = t.collection().select("oil_raw").where(F.col("oil_raw").isNotNull()).distinct()
    cleaned, lower, nospace = q.clean_label("oil_raw")
    return d.select("oil_raw", cleaned.alias("cleaned"), lower.alias("lower"), nospace.alias("nospace"))


_C_STD = "WITH " + O.canon_cte() + ",\n" + O.overrides_cte() + "," + O.collection_std_ctes()


@register("standardize_labels", _C_STD + " SELECT sample_code, oil_raw, Oil_Type_Standardized FROM c_std")
def _std(t):
    return W.collection_std(t.collection()).select("sample_code", "oil_raw", "Oil_Type_Standardized")


_C_STD_EDIT = "WITH " + O.canon_cte() + ",\n" + O.overrides_cte() + "," + O.collection_std_ctes("levenshtein")


@register("standardize_labels_levenshtein", _C_STD_EDIT + " SELECT sample_code, oil_raw, Oil_Type_Standardized FROM c_std")
def _std_lev(t):
    return W.collection_std(t.collection(), method="levenshtein").select("sample_code", "oil_raw", "Oil_Type_Standardized")


@register("label_mapping", _C_STD + """
SELECT DISTINCT oil_raw, Oil_Type_Standardized, coalesce(oil_raw <> Oil_Type_Standardized, true) AS Changed FROM c_std""")
def _label_mapping(t):
    return q.label_mapping(W.collection_std(t.collection()), "oil_raw", "Oil_Type_Standardized")


@register("label_change_counts", _C_STD + """,
m AS (SELECT DISTINCT oil_raw, Oil_Type_Standardized, coalesce(oil_raw <> Oil_Type_Standardized, true) AS Changed FROM c_std)
SELECT count(*) AS n_distinct, CAST(sum(CAST(Changed AS INTEGER)) AS BIGINT) AS n_changed FROM m""")
def _label_change_counts(t):
    return q.label_change_counts(q.label_mapping(W.collection_std(t.collection()), "oil_raw", "Oil_Type_Standardized"))


@register("oil_counts", _C_STD + """
SELECT Oil_Type_Standardized AS Oil_Type, count(*) AS Sample_Count,
       round_even(count(*) / (SELECT count(*) FROM collection) * 100e0, 2) AS Percentage
FROM c_std WHERE Oil_Type_Standardized IS NOT NULL GROUP BY 1""")
def _oil_counts(t):
    vc = A.value_counts(W.collection_std(t.collection()), "Oil_Type_Standardized", name="Sample_Count")
    return vc.select(F.col("Oil_Type_Standardized").alias("Oil_Type"), "Sample_Count", "Percentage")


@register("top_n_then_breakdown", _C_STD + """,
top AS (SELECT Oil_Type_Standardized FROM c_std WHERE Oil_Type_Standardized IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, Oil_Type_Standardized LIMIT 5)
SELECT Oil_Type_Standardized AS Oil_Type, city AS City, count(*) AS Count FROM c_std
WHERE Oil_Type_Standardized IN (SELECT Oil_Type_Standardized FROM top) AND city IS NOT NULL GROUP BY 1, 2""")
def _top_n_breakdown(t):
    return A.top_n_then_breakdown(W.collection_std(t.collection()), "Oil_Type_Standardized", "city", 5)


@register("nondetect_token", f"""
SELECT DISTINCT lead, {O.nondetect_expr('lead')} AS is_nondetect FROM testing WHERE lead IS NOT NULL""")
def _nondetect(t):
    d = t.testing().select("lead").where(F.col("lead").isNotNull()).distinct()
    return d.select("lead", q.nondetect_token("lead").alias("is_nondetect"))


_T_EVAL = "WITH " + O.testing_eval_ctes()


@register("rule_evaluate", _T_EVAL + """
SELECT sample_code, oil_sampler, lead, acid_value, argemone, Pass_Fail, Failure_Reason FROM t_eval""")
def _rules(t):
    return q.rule_evaluate(t.testing()).select("sample_code", "oil_sampler", "lead", "acid_value", "argemone",
                                               "Pass_Fail", "Failure_Reason")


@register("failure_message", _T_EVAL + """
SELECT Failure_Reason, count(*) AS Count FROM t_eval WHERE Pass_Fail = 'FAIL' GROUP BY Failure_Reason""")
def _failure_message(t):
    ev = q.rule_evaluate(t.testing()).where(F.col("Pass_Fail") == "FAIL")
    return ev.groupBy("Failure_Reason").agg(F.count("*").alias("Count"))


# ------------------------------------------- rules as tables (2.12)
_RR = "WITH " + O.rule_rows_cte()


@register("rule_fail_rows", _RR + """
SELECT sample_code, rule, value, message FROM rr WHERE message IS NOT NULL""")
def _rule_fail_rows(t):
    rows = tf.rule_rows(t.testing(), ["sample_code"])
    return rows.where("outcome = 'FAIL'").select("sample_code", "rule", "value", "message")


@register("rule_outcome_counts", _RR + """
SELECT rule, CASE WHEN message IS NULL THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n FROM rr GROUP BY ALL""")
def _rule_outcome_counts(t):
    return tf.rule_rows(t.testing(), ["sample_code"]).groupBy("rule", "outcome").agg(F.count("*").alias("n"))


@register("rule_tally", _RR + """
SELECT rule, count(*) AS fails, count(*) - count(number) AS without_number, max(number) AS worst FROM rr
WHERE message IS NOT NULL GROUP BY rule""")
def _rule_tally(t):
    name = tf.register_rule_tally(t.spark)
    view = "rule_rows_" + uuid.uuid4().hex
    io.register_view(tf.rule_rows(t.testing(), []), view)
    return t.spark.sql(f"""
        SELECT rule, sum(n) AS fails, sum(n_without_number) AS without_number, max(worst) AS worst
        FROM {name}(TABLE(SELECT rule, number FROM {view} WHERE outcome = 'FAIL')) GROUP BY rule""")


@register("status_summary", _T_EVAL + """
SELECT Pass_Fail AS Result, count(*) AS Count, round_even(count(*) * 100e0 / (SELECT count(*) FROM testing), 2) AS Percentage
FROM t_eval GROUP BY Pass_Fail""")
def _status(t):
    return q.status_summary(q.rule_evaluate(t.testing()))


@register("fail_records", _T_EVAL + """
SELECT sample_code, oil_sampler, Pass_Fail, Failure_Reason FROM t_eval WHERE Pass_Fail = 'FAIL'""")
def _fail_records(t):
    return q.fail_records(q.rule_evaluate(t.testing()), ["sample_code", "oil_sampler", "Pass_Fail", "Failure_Reason"])


@register("fail_records_head", _T_EVAL + """
SELECT sample_code, oil_sampler, Pass_Fail, Failure_Reason FROM t_eval WHERE Pass_Fail = 'FAIL'
ORDER BY sample_code, oil_sampler, Failure_Reason LIMIT 10""")
def _fail_head(t):
    fails = q.fail_records(q.rule_evaluate(t.testing()), ["sample_code", "oil_sampler", "Pass_Fail", "Failure_Reason"])
    return rk.head_sample(fails, 10, ["sample_code", "oil_sampler", "Failure_Reason"])


@register("label_family", _T_EVAL + f""",
labels AS (SELECT Sampler_Oil_Std AS label FROM t_eval UNION SELECT Lab_Oil_Std FROM t_eval)
SELECT label, {O.family_expr('label')} AS family FROM labels WHERE label IS NOT NULL""")
def _label_family(t):
    ev = W.testing_eval(t.testing())
    labels = ev.select(F.col("Sampler_Oil_Std").alias("label")).union(ev.select(F.col("Lab_Oil_Std").alias("label")))
    labels = labels.where(F.col("label").isNotNull()).distinct()
    return labels.select("label", q.label_family("label").alias("family"))


@register("mismatch_classify", _T_EVAL + """
SELECT sample_code, oil_sampler, Sampler_Oil_Std, oil_lab, Lab_Oil_Std, Mismatch_Type FROM t_eval""")
def _mismatch(t):
    return W.testing_eval(t.testing()).select("sample_code", "oil_sampler", "Sampler_Oil_Std", "oil_lab",
                                              "Lab_Oil_Std", "Mismatch_Type")


@register("mismatch_summary", _T_EVAL + " SELECT Mismatch_Type, count(*) AS Count FROM t_eval GROUP BY Mismatch_Type")
def _mismatch_summary(t):
    return A.value_counts(W.testing_eval(t.testing()), "Mismatch_Type", pct_name=None)


@register("mismatch_by_label", _T_EVAL + """
SELECT Sampler_Oil_Std, Mismatch_Type, count(*) AS Count FROM t_eval
WHERE Mismatch_Type IN ('Minor Mismatch', 'Major Mismatch') AND Sampler_Oil_Std IS NOT NULL GROUP BY 1, 2""")
def _mismatch_label(t):
    ev = W.testing_eval(t.testing()).where(F.col("Mismatch_Type").isin("Minor Mismatch", "Major Mismatch"))
    return q.group_counts(ev, ["Sampler_Oil_Std", "Mismatch_Type"])


@register("mismatch_by_city", _T_EVAL + """
SELECT city_picked, Mismatch_Type, count(*) AS Count FROM t_eval
WHERE Mismatch_Type IN ('Minor Mismatch', 'Major Mismatch') AND city_picked IS NOT NULL GROUP BY 1, 2""")
def _mismatch_city(t):
    ev = W.testing_eval(t.testing()).where(F.col("Mismatch_Type").isin("Minor Mismatch", "Major Mismatch"))
    return q.group_counts(ev, ["city_picked", "Mismatch_Type"])


@register("key_overlap", """
WITH l AS (SELECT DISTINCT sample_code AS k FROM collection WHERE sample_code IS NOT NULL),
r AS (SELECT DISTINCT sample_code AS k FROM testing WHERE sample_code IS NOT NULL)
SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys,
       (SELECT count(*) FROM l JOIN r ON l.k = r.k) AS overlapping,
       (SELECT count(*) FROM l ANTI JOIN r ON l.k = r.k) AS only_left,
       (SELECT count(*) FROM r ANTI JOIN l ON l.k = r.k) AS only_right""")
def _key_overlap(t):
    return q.key_overlap(t.collection(), "sample_code", t.testing(), "sample_code")


@register("key_intersect", """
SELECT sample_code AS key FROM collection WHERE sample_code IS NOT NULL
INTERSECT SELECT sample_code FROM testing WHERE sample_code IS NOT NULL""")
def _key_intersect(t):
    return q.key_intersect(t.collection(), "sample_code", t.testing(), "sample_code")


@register("key_except", """
SELECT sample_code AS key FROM collection WHERE sample_code IS NOT NULL
EXCEPT SELECT sample_code FROM testing WHERE sample_code IS NOT NULL""")
def _key_except(t):
    return q.key_except(t.collection(), "sample_code", t.testing(), "sample_code")


_MASTER = "WITH " + O.master_ctes()
_MASTER_COLS = ["sample_code", "city", "shop_type", "oil_raw", "mfg_raw", "expiry_raw", "Oil_Type_Standardized",
                "city_picked", "oil_sampler", "oil_lab", "lead", "acid_value", "argemone", "Failure_Reason",
                "Pass_Fail", "Sampler_Oil_Std", "Lab_Oil_Std", "Mismatch_Type"]


@register("link_master", _MASTER + f" SELECT {', '.join(_MASTER_COLS)} FROM master")
def _link_master(t):
    return W.master(t.collection(), t.testing()).select(*_MASTER_COLS)


_SHELF = _MASTER + """,
sl AS (SELECT *, CAST(try_strptime(mfg_raw, '%d/%m/%Y') AS DATE) AS Mfg_Date,
              CAST(try_strptime(expiry_raw, '%d/%m/%Y') AS DATE) AS Expiry_Date FROM master),
sl2 AS (SELECT *, CAST(date_diff('day', Mfg_Date, Expiry_Date) AS INTEGER) AS Shelf_Life_Days,
               CAST(date_diff('day', DATE '2025-01-01', Expiry_Date) AS INTEGER) AS Remaining_Shelf_Life_Days FROM sl),
sl3 AS (SELECT *, coalesce(Remaining_Shelf_Life_Days < 90, false) AS Short_Shelf_Life_Flag FROM sl2)"""


def _shelf(t):
    return q.shelf_life(W.master(t.collection(), t.testing()), "mfg_raw", "expiry_raw")


@register("shelf_life", _SHELF + """
SELECT sample_code, Mfg_Date, Expiry_Date, Shelf_Life_Days, Remaining_Shelf_Life_Days, Short_Shelf_Life_Flag FROM sl3""")
def _shelf_life(t):
    return _shelf(t).select("sample_code", "Mfg_Date", "Expiry_Date", "Shelf_Life_Days", "Remaining_Shelf_Life_Days",
                            "Short_Shelf_Life_Flag")


@register("shelf_life_describe", _SHELF + " " + _describe_sql("Shelf_Life_Days", "sl3 WHERE Shelf_Life_Days IS NOT NULL", 1))
def _shelf_describe(t):
    return st.describe_numeric(_shelf(t), "Shelf_Life_Days", digits=1)


@register("flag_counts", _SHELF + " SELECT Short_Shelf_Life_Flag, count(*) AS Count FROM sl3 GROUP BY 1")
def _flag_counts(t):
    return A.value_counts(_shelf(t), "Short_Shelf_Life_Flag", pct_name=None)


@register("group_stats", _SHELF + """
SELECT Oil_Type_Standardized, round_even(avg(CAST(Shelf_Life_Days AS DOUBLE)), 1) AS mean,
       round_even(min(CAST(Shelf_Life_Days AS DOUBLE)), 1) AS min, round_even(max(CAST(Shelf_Life_Days AS DOUBLE)), 1) AS max,
       count(Shelf_Life_Days) AS count
FROM sl3 WHERE Oil_Type_Standardized IS NOT NULL GROUP BY 1""")
def _group_stats(t):
    return q.group_stats(_shelf(t), "Oil_Type_Standardized", "Shelf_Life_Days")


def _rate_sql(key: str) -> str:
    return _MASTER + f""",
c AS (SELECT {key}, Pass_Fail, count(*) AS n FROM master WHERE {key} IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, round_even(n * 100e0 / sum(n) OVER (PARTITION BY {key}), 1) AS Percentage FROM c)
SELECT {key}, Pass_Fail, Percentage FROM s WHERE Pass_Fail = 'FAIL'"""


@register("city_fail_rate", _rate_sql("city"))
def _city_fail(t):
    return q.outcome_rate_by(W.master(t.collection(), t.testing()), "city")


@register("shop_fail_rate", _rate_sql("shop_type"))
def _shop_fail(t):
    return q.outcome_rate_by(W.master(t.collection(), t.testing()), "shop_type")


@register("cooccurrence_filter", _MASTER + """
SELECT sample_code, Sampler_Oil_Std, Lab_Oil_Std, Pass_Fail, Failure_Reason FROM master
WHERE Mismatch_Type = 'Major Mismatch' AND Pass_Fail = 'FAIL'""")
def _cooc(t):
    m = W.master(t.collection(), t.testing())
    return m.where((F.col("Mismatch_Type") == "Major Mismatch") & (F.col("Pass_Fail") == "FAIL")).select(
        "sample_code", "Sampler_Oil_Std", "Lab_Oil_Std", "Pass_Fail", "Failure_Reason")


def names() -> list[str]:
    return list(QUERIES)


# ================================================== ordered tables (2.5-2.8)
#: Orders moved into the days of the events; one user asks a third of all.
def _asked(t):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 31
    hot = F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(F.col("o_custkey") % 150)
    start = F.lit("2024-01-01").cast("timestamp")
    return t.base("orders").select("o_orderkey", hot.cast("long").alias("user_id"),
                                   F.timestamp_micros(F.unix_micros(start) + day.cast("long") * 86_400_000_000).alias("asked_at"))


@register("asof_last_event", """
WITH asked AS (
  SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey % 150 END AS BIGINT) AS user_id,
         epoch_us(TIMESTAMP '2024-01-01') + (datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 31)
           * 86400000000 AS at_us
  FROM orders),
last_one AS (
  SELECT a.o_orderkey, a.user_id, max({'t': epoch_us(e.ts), 'id': e.event_id}) AS m
  FROM asked a JOIN events e ON e.user_id = a.user_id AND epoch_us(e.ts) <= a.at_us GROUP BY ALL)
SELECT a.o_orderkey, a.user_id, e.event_id, e.event_type
FROM asked a LEFT JOIN last_one l USING (o_orderkey) LEFT JOIN events e ON e.event_id = l.m.id""")
def _asof(t):
    out = od.asof_join(_asked(t), t.base("events").withColumnRenamed("user_id", "who"), {"user_id": "who"}, "asked_at", "ts",
                       ["event_id", "event_type"], ties=["event_id"])
    return out.select("o_orderkey", "user_id", "event_id", "event_type")


@register("interval_overlaps", """
SELECT s.o_orderkey AS stage_order, w.o_orderkey AS window_order,
       CAST(datediff('day', greatest(s.o_orderdate, w.o_orderdate),
                     least(s.o_orderdate + INTERVAL 1 DAY * (10 + s.o_orderkey % 90), w.o_orderdate + INTERVAL 14 DAY)) AS INT)
         AS overlap_days
FROM orders s JOIN orders w ON s.o_custkey = w.o_custkey AND w.o_orderpriority = '1-URGENT'
 AND s.o_orderdate <= w.o_orderdate + INTERVAL 14 DAY
 AND w.o_orderdate <= s.o_orderdate + INTERVAL 1 DAY * (10 + s.o_orderkey % 90)""")
def _overlaps(t):
    day = F.col("o_orderdate").cast("date")
    orders = t.base("orders")
    stage = orders.select(F.col("o_orderkey").alias("stage_order"), F.col("o_custkey").alias("customer"), day.alias("s_begin"),
                          F.date_add(day, (10 + F.col("o_orderkey") % 90).cast("int")).alias("s_end"))
    window = orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("window_order"), F.col("o_custkey").alias("w_customer"), day.alias("w_begin"),
        F.date_add(day, 14).alias("w_end"))
    out = od.interval_join(stage, window, ("s_begin", "s_end"), ("w_begin", "w_end"), {"customer": "w_customer"})
    return out.select("stage_order", "window_order",
                      F.datediff(F.least("s_end", "w_end"), F.greatest("s_begin", "w_begin")).alias("overlap_days"))


@register("first_seen_counts", """
WITH c AS (SELECT user_id, count(*) AS n, min(event_id) AS seen FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, n, row_number() OVER (ORDER BY n DESC, seen) AS place FROM c""")
def _first_seen(t):
    return od.counts_by_first_seen(od.with_source_order(t.base("events")), "user_id", "_source_order")


@register("inferred_dates", r"""
WITH raw AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                          ELSE strftime(o_orderdate, '%d/%m/%Y') END AS raw FROM orders),
lead AS (SELECT arg_min(raw, o_orderkey) AS x FROM raw WHERE raw IS NOT NULL)
SELECT o_orderkey, raw, CAST(CASE WHEN regexp_matches(x, '^\d{4}-') THEN try_strptime(raw, '%Y-%m-%d')
                                  ELSE try_strptime(raw, '%d/%m/%Y') END AS DATE) AS order_date
FROM raw, lead""")
def _inferred(t):
    day = F.col("o_orderdate").cast("date")
    raw = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-MM-dd")
                                                          ).otherwise(F.date_format(day, "dd/MM/yyyy"))
    rows = od.with_source_order(t.base("orders")).select("o_orderkey", raw.alias("raw"), "_source_order")
    return od.infer_day_first(rows, "raw", "_source_order", "order_date").drop("_source_order")


@register("global_ranks", """
SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority, CAST(o_orderdate AS DATE) DESC) AS place,
       dense_rank() OVER (ORDER BY o_orderpriority, CAST(o_orderdate AS DATE) DESC) AS dense,
       ntile(7) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS bucket
FROM orders""")
def _global_ranks(t):
    orders = t.base("orders").withColumn("day", F.col("o_orderdate").cast("date"))
    tiles = od.global_ntile(orders, [("o_totalprice", False), "o_orderkey"], 7, "bucket")
    return od.global_rank(tiles, ["o_orderpriority", ("day", False)], "place", "dense").select(
        "o_orderkey", "place", "dense", "bucket")


@register("filled_forward", """
WITH gap AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'all' ELSE event_type END AS kind, ts,
                    CASE WHEN event_id % 4 <> 1 THEN value END AS value FROM events)
SELECT event_id, kind,
       last_value(value IGNORE NULLS) OVER (PARTITION BY kind ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward,
       first_value(value IGNORE NULLS) OVER (PARTITION BY kind ORDER BY ts, event_id
                                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward
FROM gap""")
def _filled(t):
    kind = F.when(F.col("event_id") % 3 == 0, "all").otherwise(F.col("event_type"))
    value = F.when(F.col("event_id") % 4 != 1, F.col("value"))
    rows = t.base("events").select("event_id", kind.alias("kind"), "ts", value.alias("forward"), value.alias("backward"))
    out = od.fill_forward(rows, ["kind"], ["ts", "event_id"], ["forward"])
    return od.fill_backward(out, ["kind"], ["ts", "event_id"], ["backward"]).drop("ts")


# ================================================== sketches, levels, multisets
_TENTHS = ([0.0, 0.1, 0.5, 0.9, 1.0], ["lowest", "p10", "median", "p90", "highest"])


@register("quantile_sketches", """
SELECT State, count(Market_Cost_Rs) AS n, min(Market_Cost_Rs) AS lowest, max(Market_Cost_Rs) AS highest,
       true AS p10_holds, true AS median_holds, true AS p90_holds
FROM applications GROUP BY State""")
def _quantile_sketches(t):
    """Sketches per state and category, merged per state; their measured rank
    errors against twice the bound (75 comparisons at 99 % each)."""
    size, (probs, names) = 400, _TENTHS
    rows = t.applications().select("State", "Beneficiary_Category", "Market_Cost_Rs")
    fine = sk.quantile_sketch(rows, "Market_Cost_Rs", ["State", "Beneficiary_Category"], size)
    found = sk.sketch_quantiles(sk.merge_quantile_sketches(fine, ["State"]), probs, names)
    errors = sk.quantile_rank_errors(rows, "Market_Cost_Rs", found, probs, names, ["State"])
    held = [(F.col(c) <= 2 * sk.quantile_rank_bound(size)).alias(f"{c}_holds") for c in names[1:4]]
    return found.select("State", "lowest", "highest").join(errors.select("State", "n", *held), "State")


@register("sketch_key_overlap", """
WITH k AS (SELECT sample_code AS key, 1 AS l, 0 AS r FROM collection UNION ALL SELECT sample_code, 0, 1 FROM testing),
s AS (SELECT max(l) AS l, max(r) AS r FROM k WHERE key IS NOT NULL GROUP BY key),
x AS (SELECT sum(l) AS left_keys, sum(r) AS right_keys, sum(l * r) AS overlapping, sum(l * (1 - r)) AS only_left,
             sum((1 - l) * r) AS only_right FROM s)
SELECT keys, CAST(n AS BIGINT) AS exact, true AS holds
FROM (UNPIVOT x ON left_keys, right_keys, overlapping, only_left, only_right INTO NAME keys VALUE n)""")
def _sketch_key_overlap(t):
    exact = q.key_overlap(t.collection(), "sample_code", t.testing(), "sample_code")
    guess = sk.sketch_key_overlap(t.collection(), "sample_code", t.testing(), "sample_code")
    sets = ["left_keys", "right_keys", "overlapping", "only_left", "only_right"]
    both = exact.withColumn("kind", F.lit("exact")).unionByName(guess.withColumn("kind", F.lit("guess")))
    by_set = both.unpivot(["kind"], sets, "keys", "n").groupBy("keys").pivot("kind", ["exact", "guess"]).agg(F.first("n"))
    whole = exact.select(F.col("left_keys") + F.col("only_right")).scalar()
    return by_set.select("keys", "exact", (F.abs(F.col("guess") - F.col("exact"))
                                           <= sk.distinct_bound(F.col("exact"), whole, 12)).alias("holds"))


@register("level_totals", """
SELECT State, Beneficiary_Category, System_Size_kW,
       CAST(grouping_id(State, Beneficiary_Category, System_Size_kW) AS BIGINT) AS level, count(*) AS n_rows,
       round_even(sum(Market_Cost_Rs), 2) AS cost, count(DISTINCT Vendor_ID) AS vendors, count(DISTINCT DISCOM) AS discoms
FROM applications GROUP BY CUBE (State, Beneficiary_Category, System_Size_kW)""")
def _level_totals(t):
    keys = ["State", "Beneficiary_Category", "System_Size_kW"]
    out = bg.level_totals(t.applications(), keys, bg.cube_levels(keys), {"cost": "Market_Cost_Rs"},
                          {"vendors": "Vendor_ID", "discoms": "DISCOM"})
    return out.withColumn("cost", pandas_round("cost", 2))


@register("multiset_operations", """
WITH l AS (SELECT o_orderpriority, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS lot FROM orders WHERE o_orderkey % 3 = 0),
r AS (SELECT o_orderpriority, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 END AS lot FROM orders WHERE o_orderkey % 4 = 1)
SELECT 'intersect' AS operation, * FROM (SELECT * FROM l INTERSECT ALL SELECT * FROM r)
UNION ALL SELECT 'except', * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
UNION ALL SELECT 'union', * FROM l UNION ALL SELECT 'union', * FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def _multisets(t):
    def bag(of, lots):
        lot = F.col("o_custkey") % lots
        return t.base("orders").where(of).select("o_orderpriority", F.when(lot > 0, lot).alias("lot"))

    left, right = bag("o_orderkey % 3 = 0", 5), bag("o_orderkey % 4 = 1", 7)
    out = [f(left, right).select(F.lit(name).alias("operation"), "*") for name, f in (
        ("intersect", bg.intersect_rows), ("except", bg.except_rows), ("union", bg.largest_union_rows))]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ================================================== sources and sinks (2.1)
def _scratch(t, name: str) -> str:
    """A folder of its own in the shared checkpoint folder, which goes with
    the application."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"
    remove_at_exit(t.spark, path)
    return path


@register("read_table", "SELECT n_nationkey, n_name FROM nation")
def _read_table(t):
    return io.read_table(t.spark, f"{t.sf_dir}/nation.parquet").select("n_nationkey", "n_name")


@register("normalise_headers", """SELECT n_nationkey AS Nation_Key, n_name AS Nation_Name, n_regionkey AS Nation_Name_1,
n_name AS col FROM nation""")
def _normalise_headers(t):
    raw = t.base("nation").select(F.col("n_nationkey").alias("Nation\xa0 Key "), F.col("n_name").alias(" Nation-Name"),
                                  F.col("n_regionkey").alias("Nation  (Name)"), F.col("n_name").alias("%"))
    return io.normalise_headers(raw)


@register("null_tokens", """SELECT sample_code, nullif(expiry_raw, 'not printed') AS expiry_raw,
CASE WHEN oil_raw NOT IN ('ghee blend', 'olive oil') THEN oil_raw END AS oil_raw FROM collection""")
def _null_tokens(t):
    raw = t.collection().select("sample_code", "expiry_raw", "oil_raw")
    return io.null_tokens(raw, ["not printed", "ghee blend", "olive oil"])


@register("sql_suite_over_view", _ORACLE_REPORTS["s1_state_conversion"])
def _sql_suite(t):
    io.register_view(t.applications(), "tally_applications")
    return R.run_sql_suite(t.spark, t.spark.table("tally_applications"), ["s1_state_conversion"])["s1_state_conversion"]


@register("fill_null", """SELECT Application_ID, coalesce(Grievance_TAT_Days, 0) AS Grievance_TAT_Days,
coalesce(Grievance_Type, 'none') AS Grievance_Type FROM applications""")
def _fill_null(t):
    return fe.fill_null(t.applications().select("Application_ID", "Grievance_TAT_Days", "Grievance_Type"),
                        {"Grievance_TAT_Days": 0, "Grievance_Type": "none"})


@register("write_report", _ORACLE_REPORTS["s5_grievance_summary"])
def _write_report(t):
    paths = io.write_report({"S5 Grievances": R.s5_grievance_summary(t.applications())}, _scratch(t, "report"))
    return io.read_table(t.spark, paths["S5 Grievances"])


@register("write_if_nonempty", """SELECT true AS written, false AS written_when_empty, count(*) AS n_rows FROM applications
WHERE Has_Grievance""")
def _write_if_nonempty(t):
    rows = t.applications().where("Has_Grievance").select("Application_ID", "Grievance_Type")
    path = _scratch(t, "rows")
    full = io.write_if_nonempty(rows, path)
    none = io.write_if_nonempty(rows.where("Application_ID is null and Grievance_Type = '-'"), path + "-none")
    back = io.read_table(t.spark, path)
    return back.agg(F.lit(full).alias("written"), F.lit(none).alias("written_when_empty"),
                    F.count("*").alias("n_rows")).select("written", "written_when_empty", "n_rows")


@register("write_enriched", """SELECT State, count(*) AS n_rows, round_even(sum(Market_Cost_Rs), 2) AS cost FROM applications
WHERE State IS NOT NULL GROUP BY State""")
def _write_enriched(t):
    path = _scratch(t, "enriched")
    rows = t.applications().where("State is not null").select("Application_ID", "State", "Market_Cost_Rs")
    io.write_enriched(rows, path, partition_by=["State"])
    back = t.spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("State").agg(F.count("*").alias("n_rows"),
                                     pandas_round(F.sum("Market_Cost_Rs"), 2).alias("cost"))
