"""Row-level features and cleaning for the application table.

All derivations are projections (no shuffle).  Data-dependent bounds
(IQR fences) are one-row frames consumed as scalar subqueries, which
Spark evaluates once and ships to every task as a literal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import case_bucket, clip, col, null_false, pct, safe_ratio, try_div
from .stats import exact_quantiles

# Scheme constants used by the reference's checks.
SCHEME_CFA_MAX = 78000.0
UNITS_RATIO_LIMIT = 1.5
CFA_TIERS = ((2, 0.60), 0.40)          # 60 % of benchmark up to 2 kW, 40 % beyond
CFA_ERROR_TOLERANCE = 500.0
PAYBACK_CAP_MONTHS = 360.0
PAYBACK_BUCKETS = [(36, "Short"), (72, "Medium")]   # else Long, NULL -> N/A


def pipeline_days(start: str = "Application_Date", end: str = "CFA_Credit_Date") -> Column:
    return F.datediff(F.col(end), F.col(start))


def iqr_bounds(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """One row: Q1, Q3, IQR and the k*IQR fences (exact, linear quantiles)."""
    q = exact_quantiles(df, c, [0.25, 0.75], names=["Q1", "Q3"])
    return q.select("Q1", "Q3", (F.col("Q3") - F.col("Q1")).alias("IQR"),
                    (F.col("Q1") - k * (F.col("Q3") - F.col("Q1"))).alias("lower_bound"),
                    (F.col("Q3") + k * (F.col("Q3") - F.col("Q1"))).alias("upper_bound"))


def _with_fences(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Attach both fences as one struct column ``_fences`` from ONE scalar
    subquery (evaluated once, shipped to every task as a literal)."""
    b = bounds.select(F.struct("lower_bound", "upper_bound").alias("b")).scalar()
    return df.withColumn("_fences", b)


def iqr_outlier_flag(c: str) -> Column:
    """Needs ``_fences`` (see ``_with_fences``)."""
    lo, hi = F.col("_fences.lower_bound"), F.col("_fences.upper_bound")
    return null_false((F.col(c) < lo) | (F.col(c) > hi))


def iqr_outliers(df: DataFrame, c: str, bounds: DataFrame) -> DataFrame:
    staged = _with_fences(df, bounds)
    return staged.agg(F.sum(iqr_outlier_flag(c).cast("int")).cast("bigint").alias("n_outliers"),
                      F.count("*").alias("n_rows")).select(
        "n_outliers", "n_rows", pct("n_outliers", "n_rows").alias("pct_outliers"))


def iqr_winsorize(df: DataFrame, c: str, out: str, bounds: DataFrame) -> DataFrame:
    """Clip into a new column at the fences; row count unchanged.  The
    fence struct is projected once, so the subquery is planned once."""
    staged = _with_fences(df, bounds)
    lo, hi = F.col("_fences.lower_bound"), F.col("_fences.upper_bound")
    return staged.withColumn(out, clip(c, lo, hi)).drop("_fences")


def anomaly_flags(df: DataFrame, cap: float = SCHEME_CFA_MAX, ratio_limit: float = UNITS_RATIO_LIMIT) -> DataFrame:
    """Units_Ratio plus the CFA-cap and units-excess flags (NULL -> False)
    and their OR."""
    out = df.withColumn("Units_Ratio", try_div("Actual_Monthly_Units", "Expected_Monthly_Units"))
    out = (out.withColumn("Anomaly_CFA_Breach", null_false(F.col("CFA_Sanctioned_Rs") > F.lit(cap)))
              .withColumn("Anomaly_Units_Excess", null_false(F.col("Units_Ratio") > F.lit(ratio_limit))))
    return out.withColumn("Has_Anomaly", F.col("Anomaly_CFA_Breach") | F.col("Anomaly_Units_Excess"))


def cost_gap(df: DataFrame) -> DataFrame:
    out = df.withColumn("Benchmark_Total_Cost", F.col("Benchmark_Cost_per_kW") * F.col("System_Size_kW"))
    return out.withColumn("Market_Cost_Gap_Pct",
                          try_div((F.col("Market_Cost_Rs") - F.col("Benchmark_Total_Cost")) * 100.0,
                                  F.col("Benchmark_Total_Cost")))


def enrich(df: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """The eight derived columns the analysis adds to the application table,
    as one projection over the input plus the IQR fence scalars."""
    bounds = bounds if bounds is not None else iqr_bounds(df, "Market_Cost_Rs")
    out = df.withColumn("Total_Pipeline_Days", pipeline_days())
    out = iqr_winsorize(out, "Market_Cost_Rs", "Market_Cost_Rs_Clean", bounds)
    return cost_gap(anomaly_flags(out))


def integrity_check(df: DataFrame, checks: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """Named predicate -> breaching rows, denominator, %.  The denominator
    is all rows, or the rows where the given column expression is non-null.
    All checks in one aggregate (one scan)."""
    aggs = []
    for i, (name, (cond, denom)) in enumerate(checks.items()):
        aggs.append(F.sum(null_false(cond).cast("int")).cast("bigint").alias(f"b{i}"))
        aggs.append((F.count(denom) if denom is not None else F.count(F.lit(1))).alias(f"d{i}"))
    row = df.agg(*aggs)
    stacked = ", ".join(f"'{name}', b{i}, d{i}" for i, name in enumerate(checks))
    long = row.selectExpr(f"stack({len(checks)}, {stacked}) AS (check_name, breaching, denominator)")
    return long.withColumn("pct", pct("breaching", "denominator"))


def cfa_expected(bench="Benchmark_Cost_per_kW", size="System_Size_kW", tiers=CFA_TIERS,
                 cap: float = SCHEME_CFA_MAX) -> Column:
    """Tiered subsidy: first-tier rate x benchmark x size up to the tier
    size, the second rate beyond it, capped.  NULL input -> NULL (``least``
    alone would skip the NULL and return the cap)."""
    (tier_kw, r1), r2 = tiers
    b, s = col(bench), col(size)
    raw = F.when(s <= tier_kw, F.lit(r1) * b * s).otherwise(
        F.lit(r1) * b * F.lit(tier_kw) + F.lit(r2) * b * (s - F.lit(tier_kw)))
    return F.when(b.isNotNull() & s.isNotNull(), F.least(raw, F.lit(cap)))


def cfa_error_check(df: DataFrame, tolerance: float = CFA_ERROR_TOLERANCE) -> DataFrame:
    out = df.withColumn("Calculated_CFA", cfa_expected())
    out = out.withColumn("CFA_Error", F.col("Calculated_CFA") - F.col("CFA_Sanctioned_Rs"))
    return out.withColumn("CFA_Error_Flag", null_false(F.abs("CFA_Error") > F.lit(tolerance)))


def cfa_error_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("Total_Records"),
                       F.sum(F.col("CFA_Error_Flag").cast("int")).cast("bigint").alias("CFA_Errors")).select(
        "Total_Records", "CFA_Errors", pct("CFA_Errors", "Total_Records").alias("Error_Rate_Pct"))


def payback_months(cost="Market_Cost_Rs", subsidy="CFA_Sanctioned_Rs", savings="Monthly_Bill_Savings_Rs",
                   cap: float = PAYBACK_CAP_MONTHS) -> Column:
    """(cost - subsidy) / savings where savings > 0, clipped above at cap."""
    return clip(safe_ratio(col(cost) - col(subsidy), savings), upper=cap)


def payback_category(c="Payback_Months") -> Column:
    return case_bucket(c, PAYBACK_BUCKETS, "Long", null_label="N/A")


def performance_ratio(actual="Actual_Monthly_Units", expected="Expected_Monthly_Units") -> Column:
    return try_div(actual, expected)


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count, null count, % missing (half-even,
    2).  One aggregate of count(col) for every column, then unpivoted."""
    cols, kinds = df.columns, dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(cols)])
    stacked = ", ".join(f"'{c}', '{kinds[c]}', _nn{i}" for i, c in enumerate(cols))
    long = row.selectExpr("_rows", f"stack({len(cols)}, {stacked}) AS (column_name, dtype, non_null)")
    return long.select("column_name", "dtype", "non_null", (F.col("_rows") - F.col("non_null")).alias("null_count"),
                       F.bround(pct(F.col("_rows") - F.col("non_null"), "_rows"), 2).alias("pct_missing"))


def assign_codes(df: DataFrame, key: str, prefix: str = "ST", width: int = 2, code: str = "State_Code") -> DataFrame:
    """Sorted distinct keys -> prefix + zero-padded ordinal (ST01 ...); the
    ordinal is a distributed global row number over the distinct keys."""
    from .ranking import global_row_number

    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = global_row_number(keys, [key], "_rn")
    number = F.col("_rn").cast("string")
    # lpad alone would cut an ordinal longer than ``width``.
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return ranked.select(key, F.concat(F.lit(prefix), padded).alias(code))


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL in the named columns by a constant each."""
    return df.fillna(dict(values))


def lookup_join(df: DataFrame, dim: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """VLOOKUP: left join a dimension on ``key``.  No hint: AQE turns it
    into a broadcast join when the dimension's measured size is small and
    keeps a sort-merge join otherwise."""
    d = dim.select(key, *(cols or [c for c in dim.columns if c != key]))
    return df.join(d, key, "left")
