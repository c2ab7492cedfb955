"""Statistics: exact quantiles, describe/summary tables, Pearson r, Gini,
Lorenz points, equal-width histograms, box statistics, standardised OLS.

Exact quantiles are the scale-sensitive piece.  Spark's ``percentile``
aggregate merges a value->count map per group in ONE task, so a group that
holds a third of 100 TB would be collected into one executor.  Here the
rank of every value is derived from a range-partitioned sort of the
(group, value, count) pairs instead (see ``exact_quantiles``): a hot group
spreads over many partitions, and only the partitions that hold a wanted
rank are read a second time.  The partitioned pairs are frozen as a
parquet table in the reliable checkpoint folder between the passes, so
both passes see the same partitions even if executors are lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pandas_round, quantile_position, try_div
from ..session import cut_lineage
from .ranking import global_row_number


def attach_row(df: DataFrame, one_row: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add the columns of a ONE-row frame (bounds, fences, moments) to every
    row of ``df`` through a single scalar subquery - evaluated once and
    shipped to the tasks as a literal, with no join at all."""
    s = one_row.select(F.struct(*cols).alias("_row")).scalar()
    out = df.withColumn("_row", s)
    return out.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in cols])


def _qname(q: float) -> str:
    return "q" + format(q, ".6g").replace(".", "_")


def _null_safe_on(left: DataFrame, right: DataFrame, cols: Sequence[str]):
    cond = None
    for c in cols:
        t = left[c].eqNullSafe(right[c])
        cond = t if cond is None else cond & t
    return cond


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles of ``value_col`` per group (NULL and
    NaN skipped).  One row per group with one DOUBLE column per prob plus
    ``n`` (non-null count).

    (group, value) pairs are counted first, on the map side too, so a value
    that many rows share is one row from then on.  The pairs are range
    partitioned on (group, value): a hot group spreads over many partitions
    and no partition holds ties.  They are frozen with their partition id,
    every partition's rank offset comes from a window over the per-(group,
    partition) counts (at most groups x partitions rows), and running counts
    inside the few partitions that hold a wanted rank find it.
    """
    g = list(group_cols)
    names = list(names) if names else [_qname(q) for q in probs]
    v = F.col(value_col).cast("double")
    base = df.select(*[F.col(c) for c in g], v.alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    return _quantiles_from_counts(_ordered_counts(base, g), g, probs, names)


def _interpolate(picked: DataFrame, g: Sequence[str], names: Sequence[str]) -> DataFrame:
    out = [F.col(c) for c in g] + [F.col("n")]
    for name in names:
        lo_v, hi_v, f = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        out.append((lo_v + (hi_v - lo_v) * f).alias(name))
    return picked.select(*out)


def _segment_offsets(seg: DataFrame, g: Sequence[str], size: str) -> DataFrame:
    """Rank offset of every (group, partition) segment and the group size;
    the window runs over at most groups x partitions rows."""
    within = Window.partitionBy(*g) if g else Window.partitionBy()
    return (seg.withColumn("_off", F.sum(size).over(within.orderBy("_p")) - F.col(size))
               .withColumn("_n", F.sum(size).over(within)))


def _ordered_counts(base: DataFrame, g: Sequence[str]) -> DataFrame:
    """The different (group, value) pairs with their counts ``_c``, range
    partitioned and frozen with their partition ``_p``."""
    counted = base.groupBy(*g, "_v").agg(F.count("*").alias("_c"))
    return cut_lineage(counted.repartitionByRange(*[F.col(c) for c in g], F.col("_v"))
                       .withColumn("_p", F.spark_partition_id()))


def _quantiles_from_counts(ordered: DataFrame, g: Sequence[str], probs, names) -> DataFrame:
    seg = _segment_offsets(ordered.groupBy(*g, "_p").agg(F.sum("_c").alias("_pc")), g, "_pc")
    wanted = []
    for i, q in enumerate(probs):
        lo, hi, frac = quantile_position(F.col("_n"), q)
        wanted.append(F.struct(F.lit(2 * i).alias("tag"), lo.cast("long").alias("r"), frac.alias("f")))
        wanted.append(F.struct(F.lit(2 * i + 1).alias("tag"), hi.cast("long").alias("r"), frac.alias("f")))
    targets = (seg.select(*g, "_p", "_off", "_pc", "_n", F.explode(F.array(*wanted)).alias("_w"))
                  .where((F.col("_w.r") >= F.col("_off")) & (F.col("_w.r") < F.col("_off") + F.col("_pc")))
                  .select(*g, "_p", "_n", F.col("_w.tag").alias("_tag"), (F.col("_w.r") - F.col("_off")).alias("_lr"),
                          F.col("_w.f").alias("_f")))
    # Running counts only inside the partitions that hold a wanted rank,
    # once per partition; the wanted ranks are attached afterwards.
    o, tp = ordered.alias("o"), targets.select(*g, "_p").distinct().alias("tp")
    cand = o.join(tp, _null_safe_on(o, tp, list(g) + ["_p"]), "left_semi")
    run = Window.partitionBy(*g, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cand = cand.withColumn("_cum", F.sum("_c").over(run)).alias("c")
    t = targets.alias("t")
    hit = cand.join(t, _null_safe_on(cand, t, list(g) + ["_p"]), "inner").select(
        *[F.col(f"c.{c}").alias(c) for c in g], "c._v", "c._c", "c._cum", "t._n", "t._tag", "t._lr", "t._f")
    hit = hit.where((F.col("_cum") - F.col("_c") <= F.col("_lr")) & (F.col("_lr") < F.col("_cum")))
    aggs = [F.first("_n").alias("n")]
    for i, name in enumerate(names):
        aggs += [F.max(F.when(F.col("_tag") == 2 * i, F.col("_v"))).alias(f"_{name}_lo"),
                 F.max(F.when(F.col("_tag") == 2 * i + 1, F.col("_v"))).alias(f"_{name}_hi"),
                 F.max(F.when(F.col("_tag") == 2 * i, F.col("_f"))).alias(f"_{name}_f")]
    return _interpolate(hit.groupBy(*g).agg(*aggs), g, names)


def median(df: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, value_col, [0.5], group_cols, names=["median"])


def describe_numeric(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                     digits: int | None = None) -> DataFrame:
    """pandas ``describe``: count, mean, std (sample), min, 25/50/75 %, max."""
    g = list(group_cols)
    x = F.col(value_col).cast("double")
    moments = df.where(x.isNotNull()).groupBy(*g).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    qs = exact_quantiles(df, value_col, [0.25, 0.5, 0.75], g, names=["p25", "p50", "p75"]).drop("n")
    joined = moments.join(qs, on=g, how="left") if g else attach_row(moments, qs, ["p25", "p50", "p75"])
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    rnd = (lambda c: pandas_round(c, digits)) if digits is not None else (lambda c: c)
    return joined.select(*g, "count", *[rnd(F.col(s)).alias(s) for s in stats])


def summary_stats(df: DataFrame, cols: Sequence[str], digits: int | None = 2) -> DataFrame:
    """A5: Mean/Median/Std/Min/Max/P25/P75 per column, one row per column.
    Columns are unpivoted into (column_name, value), so that one quantile
    pass serves all of them."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ids=[], values=list(cols), variableColumnName="column_name", valueColumnName="value").where(
        F.col("value").isNotNull())
    moments = long.groupBy("column_name").agg(
        F.avg("value").alias("Mean"), F.stddev_samp("value").alias("Std_Dev"),
        F.min("value").alias("Min"), F.max("value").alias("Max"))
    qs = exact_quantiles(long, "value", [0.5, 0.25, 0.75], ["column_name"], names=["Median", "P25", "P75"]).drop("n")
    out = moments.join(qs, "column_name", "left")
    rnd = (lambda c: pandas_round(c, digits)) if digits is not None else (lambda c: c)
    return out.select("column_name", *[rnd(F.col(c)).alias(c) for c in
                                       ["Mean", "Median", "Std_Dev", "Min", "Max", "P25", "P75"]])


def pearson(df: DataFrame, x: str, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Pearson r over rows where both are non-null; NULL (not an error) for
    a constant column: covar_pop / (stddev_pop * stddev_pop)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*group_cols).agg(
        F.try_divide(F.covar_pop(x, y),
                     F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias("r"),
        F.count("*").alias("n"))


def _ascending(grouped: DataFrame, value_col: str) -> tuple[DataFrame, list[str]]:
    """The measure as ``x`` with the entity's other columns, and the order
    to rank it in: the entity is the last key, so that entities with equal
    measures (often most of them) spread over the range partitions."""
    rest = [c for c in grouped.columns if c != value_col]
    vals = grouped.select(F.col(value_col).cast("double").alias("x"),
                          *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(rest)])
    return vals, vals.columns


def gini(grouped: DataFrame, value_col: str) -> DataFrame:
    """Gini of a per-entity measure: sort ascending, (n + 1 - 2 * sum(cumsum)
    / total) / n, using sum(cumsum) = (n + 1) * total - sum(i * x_i).  The
    ranks i come from ``global_row_number`` (no single-task window)."""
    ranked = global_row_number(*_ascending(grouped, value_col), "i")
    agg = ranked.agg(F.count("*").alias("n"), F.sum("x").alias("total"),
                     F.sum(F.col("i") * F.col("x")).alias("ix"))
    cum_sum = (F.col("n") + 1) * F.col("total") - F.col("ix")
    return agg.select(
        F.col("n").cast("bigint").alias("n"),
        try_div(F.col("n") + 1 - F.lit(2.0) * try_div(cum_sum, F.col("total")), F.col("n")).alias("gini"))


def lorenz_points(grouped: DataFrame, value_col: str) -> DataFrame:
    """(population share, cumulative value share) after ascending sort,
    plus the origin point; ranks and running sums are distributed."""
    vals, order = _ascending(grouped, value_col)
    pts = global_row_number(vals, order, "i", running_sum="x", sum_name="cum")
    totals = vals.agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    pts = attach_row(pts, totals, ["n", "total"])
    pts = pts.select(F.col("i").cast("bigint").alias("i"),
                     (F.col("i") / F.col("n")).alias("pop_share"),
                     try_div("cum", "total").alias("cum_share"))
    origin = pts.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("i"),
                                              F.lit(0.0).alias("pop_share"),
                                              F.lit(0.0).alias("cum_share"))
    return origin.unionByName(pts)


def histogram_bins(df: DataFrame, value_col: str, bins: int) -> DataFrame:
    """numpy-style equal-width histogram over [min, max] with the last bin
    closed; a constant column is widened by 0.5 to both sides.  The computed
    index is compared with the edges that are returned and moved by one where
    rounding put it beside them, so every value lies between its own bin's
    edges.  One pass for the bounds, one partial/final aggregate for the
    counts; empty bins are generated from the bounds row (``bins`` rows)."""
    x = F.col(value_col).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    constant = F.when(F.min("x") == F.max("x"), 0.5).otherwise(0.0)
    bounds = vals.agg((F.min("x") - constant).alias("lo"), (F.max("x") + constant).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))

    def edge(i):
        return F.when(i == bins, F.col("hi")).otherwise(i * step + F.col("lo"))

    first = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"),
                    F.lit(bins - 1))
    i = F.col("first")
    idx = F.when(F.col("x") < edge(i), i - 1).when((F.col("x") >= edge(i + 1)) & (i < bins - 1), i + 1).otherwise(i)
    counts = attach_row(vals, bounds, ["lo", "hi"]).withColumn("first", first).select(idx.alias("bin")).groupBy(
        "bin").agg(F.count("*").alias("count"))
    grid = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = grid.select("bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"))
    return edges.join(counts, "bin", "left").select(
        "bin", "bin_lo", "bin_hi", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def box_stats(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers at the most extreme values
    inside the Q1 - k*IQR / Q3 + k*IQR fences, and the outlier count.  The
    rows are read once: the whiskers and outliers come from the frozen value
    counts that the quartiles were found in."""
    g = list(group_cols)
    x = F.col(value_col).cast("double")
    vals = df.select(*g, x.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ordered = _ordered_counts(vals, g)
    qs = _quantiles_from_counts(ordered, g, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    fences = qs.select(*g, "n", "q1", "median", "q3",
                       (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                       (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    joined = ordered.join(fences.select(*g, "lo_fence", "hi_fence"), g, "inner") if g else \
        attach_row(ordered, fences, ["lo_fence", "hi_fence"])
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    wh = joined.groupBy(*g).agg(
        F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).cast("bigint").alias("n_outliers"))
    out = fences.join(wh, g, "left") if g else attach_row(fences, wh, ["lower_whisker", "upper_whisker", "n_outliers"])
    return out.select(*g, "n", "q1", "median", "q3", "lower_whisker", "upper_whisker", "n_outliers")


def ols_standardised(df: DataFrame, features: Sequence[str], target: str,
                     fill_zero: Sequence[str] = ()) -> DataFrame:
    """C5: fill the given columns' nulls with 0, drop rows with any null,
    z-score every feature with the POPULATION std (zero std -> scale 1),
    fit least squares with intercept on Spark ML's normal-equation solver
    (Gram matrix aggregated across executors), report coefficients."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    cols = list(features) + [target]
    data = df.select(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in fill_zero
                        else F.col(c).cast("double")).alias(c) for c in cols]).dropna()
    data = cut_lineage(data)  # moments, fit and summary read these columns
    stats = data.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    z = attach_row(data, stats, stats.columns).select(
        *[try_div(F.col(c) - F.col(f"m_{c}"),
                  F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(F.lit(1.0))).alias(c)
          for c in features], F.col(target))
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(z)
    model = LinearRegression(featuresCol="features", labelCol=target, solver="normal",
                             regParam=0.0, standardization=False, fitIntercept=True).fit(vec)
    spark = df.sparkSession
    summary = model.summary
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    top = max(rows, key=lambda r: abs(r[1]))[0] if rows else None
    out = spark.createDataFrame(
        [(f, c, float(model.intercept), float(summary.r2), int(summary.numInstances), f == top)
         for f, c in rows],
        "Feature string, Coefficient double, Intercept double, R2 double, Rows bigint, Most_Influential boolean")
    return out.orderBy("Coefficient")
