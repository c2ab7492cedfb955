"""Grouped aggregations for the application-monitoring reports.

Every operator is ``groupBy(...).agg(...)`` with all statistics of a
report in ONE aggregate (one scan, partial aggregation before the
shuffle, so a hot key is combined map-side).  Rates are ratios of
conditional counts, never Python.  Exact medians go through the
skew-safe ``exact_quantiles``.  NULL-key handling is explicit: the
notebook-style operators drop NULL keys (``drop_null_keys=True``), the
SQL reports keep them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (count_if, mean_of_flag, month_key, null_false, pandas_round, pct,
                               threshold_flag, try_div)
from .features import lookup_join, payback_category, payback_months
from .ranking import cumulative_share, fixed_order
from .stats import exact_quantiles

# Thresholds the reports apply.
INTEREST_MANDATE_PCT = 7.0
DBT_SLA_DAYS = 30
GRIEVANCE_SLA_DAYS = 30
UTILISATION_FLOOR_PCT = 80.0
ALMM_FLOOR_PCT = 75.0
PERFORMANCE_FLOOR = 0.85
NATIONAL_MARGINALISED_PCT = 55.0
CATEGORY_ORDER = ["BPL", "SC/ST", "Women-headed", "OBC", "General"]
MARGINALISED = ["BPL", "SC/ST", "Women-headed"]
PIPELINE_STAGE_COLS = ["TFC_Processing_Days", "Installation_Days_After_TFC",
                       "Commission_Days_After_Install", "CFA_Credit_Days_After_Commission"]
FUNNEL_STAGES = [("Applications Filed", None), ("Reached TFC", "TFC_Date"),
                 ("Reached Installation", "Installation_Date"), ("Commissioned", "Commission_Date"),
                 ("CFA Credited", "CFA_Credit_Date")]


def _keys_not_null(df: DataFrame, keys: Sequence[str], drop: bool) -> DataFrame:
    if not drop:
        return df
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def value_counts(df: DataFrame, c: str, name: str = "Count", pct_name: str | None = "Percentage",
                 denominator: str = "all", digits: int | None = 2) -> DataFrame:
    """Counts per non-null value, most frequent first.  The share's
    denominator is all rows (``'all'``, NULL labels included) or the
    non-null rows (``'non_null'``)."""
    grouped = df.groupBy(c).agg(F.count("*").alias(name))
    counts = grouped.where(F.col(c).isNotNull())
    if pct_name is None:
        return counts.orderBy(F.col(name).desc(), F.col(c))
    # The total sums the grouped counts (the NULL group included for
    # ``'all'``): both readers share one aggregation of the input.
    total = (grouped if denominator == "all" else counts).select(F.sum(name)).scalar()
    share = F.col(name) / total * 100.0
    share = pandas_round(share, digits) if digits is not None else share
    return counts.withColumn(pct_name, share).orderBy(F.col(name).desc(), F.col(c))


def top_n_then_breakdown(df: DataFrame, label: str, by: str, n: int = 5,
                         names: tuple[str, str, str] = ("Oil_Type", "City", "Count")) -> DataFrame:
    """Counts by (label, by) restricted to the n most frequent labels (ties
    -> label order).  Both levels come from one aggregation of the input."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label, by).agg(F.count("*").alias("_n"))
    top = counts.groupBy(label).agg(F.sum("_n").alias("_all")).orderBy(
        F.col("_all").desc(), F.col(label)).limit(n).select(label)
    out = counts.where(F.col(by).isNotNull()).join(top, label, "left_semi").withColumnRenamed("_n", names[2])
    return out.select(F.col(label).alias(names[0]), F.col(by).alias(names[1]), names[2]).orderBy(
        F.col(names[0]).asc(), F.col(names[2]).desc(), F.col(names[1]))


def breach_rate_by(df: DataFrame, key: str, c: str, limit: float, name: str = "Pct_Above_Mandate",
                   flag_over: float | None = 20.0) -> DataFrame:
    """% of each group's rows (NULL values removed first) with value > limit."""
    src = df.where(F.col(c).isNotNull() & F.col(key).isNotNull())
    out = src.groupBy(key).agg(pct(count_if(F.col(c) > F.lit(limit)), F.count("*")).alias(name))
    if flag_over is not None:
        out = out.withColumn("Flag_Over_" + str(int(flag_over)), threshold_flag(name, ">", flag_over))
    return out.orderBy(F.col(name).asc(), F.col(key))


def overall_rate(df: DataFrame, cond: Column, where: Column | None = None, name: str = "pct") -> DataFrame:
    src = df.where(where) if where is not None else df
    return src.agg(F.count("*").alias("n"), pct(count_if(cond), F.count("*")).alias(name))


def sla_compliance(df: DataFrame, key: str = "DISCOM", lag: str = "CFA_Credit_Days_After_Commission",
                   sla: int = DBT_SLA_DAYS, digits: int = 1) -> DataFrame:
    """Per group over non-null lags: % within SLA, mean lag, count;
    rounded (half-even), ascending by % within SLA."""
    src = df.where(F.col(lag).isNotNull() & F.col(key).isNotNull())
    out = src.groupBy(key).agg(
        pandas_round(mean_of_flag(F.col(lag) <= F.lit(sla)) * 100.0, digits).alias("Pct_Within_SLA"),
        pandas_round(F.avg(lag), digits).alias("Avg_Lag_Days"),
        F.count(lag).alias("Applications"))
    return out.orderBy(F.col("Pct_Within_SLA").asc(), F.col(key))


def mean_by(df: DataFrame, key: str, c: str, name: str, order: Sequence[str] | None = None,
            digits: int | None = None) -> DataFrame:
    """Mean of ``c`` per key over rows with ``c`` non-null; optional fixed
    key order (keys not in the list are dropped)."""
    src = df.where(F.col(c).isNotNull() & F.col(key).isNotNull())
    m = F.avg(c)
    out = src.groupBy(key).agg((pandas_round(m, digits) if digits is not None else m).alias(name))
    return fixed_order(out, key, order) if order else out.orderBy(key)


def utilisation_rate(df: DataFrame, key: str = "DISCOM", received: str = "DISCOM_Incentive_Received_Rs",
                     utilised: str = "DISCOM_Incentive_Utilised_Rs", days: str = "TFC_Processing_Days",
                     digits: int = 2) -> DataFrame:
    src = df.where(F.col(received).isNotNull() & F.col(utilised).isNotNull() & F.col(key).isNotNull())
    out = src.groupBy(key).agg(F.sum(received).alias("Total_Received"), F.sum(utilised).alias("Total_Utilised"),
                               F.avg(days).alias("Avg_TFC_Days"))
    out = out.withColumn("Utilisation_Rate",
                         pandas_round(try_div(F.col("Total_Utilised"), F.col("Total_Received")) * 100.0, digits))
    return out.orderBy(F.col("Utilisation_Rate").asc(), F.col(key))


def funnel(df: DataFrame, stages: Sequence[tuple[str, str | None]] = FUNNEL_STAGES, digits: int = 1) -> DataFrame:
    """Stage counts (each an independent non-null count, all in ONE
    aggregate) and the % drop-off vs the previous stage (first = 0).  The
    lag runs over the handful of stage rows."""
    aggs = [(F.count(F.lit(1)) if c is None else F.count(F.col(c))).alias(f"s{i}") for i, (_, c) in enumerate(stages)]
    row = df.agg(*aggs)
    stacked = ", ".join(f"{i}, '{name}', s{i}" for i, (name, _) in enumerate(stages))
    long = row.selectExpr(f"stack({len(stages)}, {stacked}) AS (stage_order, stage, count)")
    w = Window.orderBy("stage_order")
    prev = F.lag("count").over(w)
    drop = F.when(prev.isNull(), F.lit(0.0)).otherwise(
        pandas_round(try_div((prev - F.col("count")).cast("double"), prev.cast("double")) * 100.0, digits))
    return long.select(F.col("stage_order").cast("int").alias("stage_order"), "stage",
                       F.col("count").cast("bigint").alias("count"), drop.alias("dropoff_pct"))


def stage_days_by(df: DataFrame, key: str = "State", cols: Sequence[str] = PIPELINE_STAGE_COLS,
                  digits: int = 1) -> DataFrame:
    """Mean of each stage column per key rounded, Total = sum of the rounded
    means with NULL as 0, descending by Total."""
    src = df.where(F.col(key).isNotNull())
    out = src.groupBy(key).agg(*[pandas_round(F.avg(c), digits).alias(c) for c in cols])
    total = None
    for c in cols:
        term = F.coalesce(F.col(c), F.lit(0.0))
        total = term if total is None else total + term
    return out.withColumn("Total", total).orderBy(F.col("Total").desc(), F.col(key))


def compliance_vs_rating(df: DataFrame, key: str = "State", flag: str = "ALMM_Compliant",
                         rating: str = "Vendor_Rating", where: Column | None = None, digits: int = 2) -> DataFrame:
    src = df.where(where) if where is not None else df
    src = src.where(F.col(key).isNotNull())
    out = src.groupBy(key).agg(
        pandas_round(F.avg(F.col(flag).cast("double")) * 100.0, digits).alias("ALMM_Compliance_Pct"),
        pandas_round(F.avg(rating), digits).alias("Avg_Vendor_Rating"),
        F.count("*").alias("Count"))
    return out.orderBy(F.col("ALMM_Compliance_Pct").asc(), F.col(key))


def resolution_table(df: DataFrame, type_col: str = "Grievance_Type", resolved: str = "Grievance_Resolved",
                     tat: str = "Grievance_TAT_Days", sla: int = GRIEVANCE_SLA_DAYS, digits: int = 1) -> DataFrame:
    """Per type: non-null resolved count, resolved sum, mean TAT,
    resolution %, % of ALL rows of the type with TAT <= sla (NULL TAT is
    not within).  One aggregate replaces the two positional group-bys."""
    src = df.where(F.col(type_col).isNotNull())
    out = src.groupBy(type_col).agg(
        F.count(resolved).alias("Total"),
        F.sum(F.col(resolved).cast("int")).cast("bigint").alias("Resolved"),
        pandas_round(F.avg(tat), digits).alias("Avg_TAT_Days"),
        pandas_round(mean_of_flag(F.col(tat) <= F.lit(sla)) * 100.0, digits).alias("Pct_Within_SLA"))
    out = out.withColumn("Resolution_Rate_Pct",
                         pandas_round(try_div(F.col("Resolved") * 100.0, F.col("Total")), digits))
    return out.select(type_col, "Total", "Resolved", "Avg_TAT_Days", "Resolution_Rate_Pct", "Pct_Within_SLA")


def share_vs_benchmark(df: DataFrame, c: str = "Beneficiary_Category", subset: Sequence[str] = MARGINALISED,
                       benchmark: float = NATIONAL_MARGINALISED_PCT) -> DataFrame:
    """Sum of the rounded shares of ``subset`` vs a benchmark %: gap and an
    over/under label (gap 0 counts as under)."""
    shares = value_counts(df, c, pct_name="Share_Pct", denominator="non_null")
    sub = shares.where(F.col(c).isin(list(subset)))
    # Shares carry 2 decimals; re-rounding their sum removes the
    # summation-order noise of floating point addition.
    return sub.agg(pandas_round(F.sum("Share_Pct"), 2).alias("Subset_Share_Pct")).select(
        "Subset_Share_Pct", F.lit(benchmark).alias("Benchmark_Pct"),
        pandas_round(F.col("Subset_Share_Pct") - F.lit(benchmark), 2).alias("Gap_Pct"),
        F.when(F.col("Subset_Share_Pct") - F.lit(benchmark) > 0, F.lit("over-represents"))
         .otherwise(F.lit("under-represents")).alias("Representation"))


def concentration_table(df: DataFrame, key: str = "State", where: Column | None = None,
                        count_name: str = "Installations") -> DataFrame:
    """Count per key (desc), share % (half-even 2), running sum of the
    ROUNDED shares (half-even 2), whose running sum is distributed."""
    src = df.where(where) if where is not None else df
    counts = src.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count_name))
    total = counts.select(F.sum(count_name)).scalar()
    out = counts.withColumn("Share_Pct", pandas_round(F.col(count_name) / total * 100.0, 2))
    order = [(count_name, False), (key, True)]
    out = cumulative_share(out, order, "Share_Pct", "Cumulative_Pct")
    return out.withColumn("Cumulative_Pct", pandas_round("Cumulative_Pct", 2)).orderBy(
        F.col(count_name).desc(), F.col(key))


def pivot_mean(df: DataFrame, row: str, col: str, measure: str, values: Sequence | None = None, digits: int = 3,
               prefix: str = "kw_") -> DataFrame:
    """row x col matrix of mean(measure), one column per value of ``col``
    that occurs, in order.  ``values`` restricts the matrix to given ones
    and saves the pass that finds them."""
    src = df.where(F.col(row).isNotNull() & F.col(measure).isNotNull())
    if values is None:
        # As many values as the result has columns come back.
        found = src.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
        values = [r[0] for r in found.collect()]
    p = src.groupBy(row).pivot(col, list(values)).agg(pandas_round(F.avg(measure), digits))
    return p.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def underperform_counts(df: DataFrame, keys: Sequence[str], ratio: str, limit: float = PERFORMANCE_FLOOR) -> DataFrame:
    """ROWS below the limit per segment (segments with none do not appear)."""
    src = _keys_not_null(df, keys, True).where(F.col(ratio) < F.lit(limit))
    return src.groupBy(*keys).agg(F.count("*").alias("Rows_Below")).orderBy(*keys)


def payback_frame(df: DataFrame) -> DataFrame:
    """Rows with positive savings and their clipped payback months."""
    src = df.where(F.col("Monthly_Bill_Savings_Rs").isNotNull() & (F.col("Monthly_Bill_Savings_Rs") > 0))
    return src.withColumn("Payback_Months", payback_months())


def payback_by_category(df: DataFrame, key: str = "Beneficiary_Category", digits: int = 1) -> DataFrame:
    pb = payback_frame(df).where(F.col(key).isNotNull())
    med = exact_quantiles(pb, "Payback_Months", [0.5], [key], names=["median"]).select(key, "median")
    moments = pb.groupBy(key).agg(F.avg("Payback_Months").alias("mean"), F.min("Payback_Months").alias("min"),
                                  F.max("Payback_Months").alias("max"))
    out = moments.join(med, key, "left")
    return out.select(key, *[pandas_round(F.col(c), digits).alias(c) for c in ["median", "mean", "min", "max"]]
                      ).orderBy(key)


def state_summary(df: DataFrame, key: str = "State", floor: float = 60.0) -> DataFrame:
    """E1: applications, % commissioned, mean savings (2), mean
    satisfaction (3), compliance % over ALL applications; flag below floor."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("Application_ID").alias("Total_Applications"),
        F.count("Commission_Date").alias("_comm"),
        pandas_round(F.avg("Monthly_Bill_Savings_Rs"), 2).alias("Avg_Bill_Savings"),
        pandas_round(F.avg("Satisfaction_Score"), 3).alias("Avg_Satisfaction"),
        F.sum(F.col("ALMM_Compliant").cast("int")).alias("_almm"))
    out = out.select(key, "Total_Applications",
                     pandas_round(try_div(F.col("_comm") * 1.0, F.col("Total_Applications")) * 100.0, 2).alias("Pct_Commissioned"),
                     "Avg_Bill_Savings", "Avg_Satisfaction",
                     pandas_round(try_div(F.col("_almm") * 1.0, F.col("Total_Applications")) * 100.0, 2).alias("ALMM_Compliance_Pct"))
    return out.withColumn("Low_Commissioning", threshold_flag("Pct_Commissioned", "<", floor)).orderBy(key)


def vendor_summary(df: DataFrame, key: str = "Vendor_ID", flag_over: float = 30.0) -> DataFrame:
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("Application_ID").alias("Total_Installations"),
        pandas_round(F.avg("Vendor_Rating"), 3).alias("Avg_Vendor_Rating"),
        F.sum(F.col("ALMM_Compliant").cast("int")).cast("bigint").alias("ALMM_Compliant_Count"),
        F.sum(F.col("Has_Grievance").cast("int")).cast("bigint").alias("Grievance_Count"))
    out = out.withColumn("Grievance_Pct", pandas_round(
        try_div(F.col("Grievance_Count") * 1.0, F.col("Total_Installations")) * 100.0, 2))
    out = out.withColumn("High_Grievance", threshold_flag("Grievance_Pct", ">", flag_over))
    return out.orderBy(F.col("Total_Installations").desc(), F.col(key))


def violations(df: DataFrame, codes: DataFrame, limit: float = INTEREST_MANDATE_PCT) -> DataFrame:
    """E5 rows: loans with rate strictly above the mandate, the state code
    looked up, and the violation label."""
    v = df.where(null_false(F.col("Has_Loan") & (F.col("Actual_Interest_Rate_pct") > F.lit(limit))))
    v = v.select("Application_ID", "State", "Beneficiary_Category", "System_Size_kW", "Loan_Amount_Rs",
                 "Actual_Interest_Rate_pct")
    v = lookup_join(v, codes.select("State", F.col("State_Code").alias("State_Code_Lookup")), "State")
    return v.withColumn("Violation", F.lit(f"Interest Rate > {limit:g}% Mandate"))


def violations_by_state(df: DataFrame, flag_over: float = 20.0, limit: float = INTEREST_MANDATE_PCT) -> DataFrame:
    """Loans above the mandate per state, counted straight from the filter
    (no state code is needed)."""
    viol = df.where(null_false(F.col("Has_Loan") & (F.col("Actual_Interest_Rate_pct") > F.lit(limit))))
    out = viol.where(F.col("State").isNotNull()).groupBy("State").agg(F.count("*").alias("Violation_Count"))
    return out.withColumn("High_Violations", F.col("Violation_Count") > F.lit(flag_over)).orderBy("State")


def payback_pivot(df: DataFrame, key: str = "Beneficiary_Category") -> DataFrame:
    """E6: count of non-null payback (N/A bucket -> 0) and mean by
    (category, payback bucket) over ALL rows."""
    pb = df.withColumn("Payback_Months", payback_months()).withColumn("Payback_Category", payback_category())
    out = pb.where(F.col(key).isNotNull()).groupBy(key, "Payback_Category").agg(
        F.count("Payback_Months").alias("Count"), pandas_round(F.avg("Payback_Months"), 1).alias("Avg_Payback"))
    return out.orderBy(key, "Payback_Category")


def topn_state_stage_means(df: DataFrame, key: str = "State", cols: Sequence[str] = PIPELINE_STAGE_COLS,
                           n: int = 10) -> DataFrame:
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).orderBy(
        F.col("_n").desc(), F.col(key)).limit(n).select(key)
    sub = df.join(top, key, "left_semi")
    return sub.groupBy(key).agg(*[pandas_round(F.avg(c), 1).alias(c) for c in cols]).orderBy(key)


def monthly_trend(df: DataFrame, date_col: str = "Application_Date") -> DataFrame:
    src = df.where(F.col(date_col).isNotNull())
    return src.groupBy(month_key(date_col).alias("App_Month")).agg(F.count("*").alias("Applications")).orderBy(
        "App_Month")
