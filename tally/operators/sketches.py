"""Mergeable sketches beside the exact operators: quantiles (KLL) and distinct
counts with set operations (theta).

Both are partial aggregates: a task folds its rows of a group into one sketch
of bounded size, so a group that holds a third of all rows shuffles one sketch
a task.  A table of sketches is data: write it per day, merge the days later.
The error bounds are functions of the sketch's size alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ------------------------------------------------------------- quantiles
def quantile_rank_bound(size: int) -> float:
    """Rank error, as a share of the rows, that a quantile of a sketch of
    ``size`` keeps with 99 % confidence (the published fit for KLL)."""
    return 2.296 / size ** 0.9723


def quantile_sketch(df: DataFrame, value: str, by: Sequence[str] = (), size: int = 200,
                    name: str = "sketch") -> DataFrame:
    """One row per group of ``by``: a quantile sketch of the numbers ``value``
    (null and NaN skipped) and ``n``, how many it has seen.  A group without a
    number has ``n`` 0."""
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v), v)
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(known, F.lit(size)).alias(name), F.count(known).alias("n"))


def merge_quantile_sketches(sketches: DataFrame, by: Sequence[str] = (), name: str = "sketch") -> DataFrame:
    """Sketches of finer groups folded into one per group of ``by``."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double(name).alias(name), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], names: Sequence[str],
                     name: str = "sketch") -> DataFrame:
    """The sketch column replaced by one column per probability: a value of
    the data whose rank is near it (0 and 1: least and greatest, exactly);
    null where the group has no number."""
    rest = [c for c in sketches.columns if c != name]
    return sketches.select(*rest, *[
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(name, F.lit(float(p)))).alias(c)
        for p, c in zip(probs, names, strict=True)])


def quantile_rank_errors(df: DataFrame, value: str, estimates: DataFrame, probs: Sequence[float],
                         names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Measured rank error of each estimate, as a share of the group's rows:
    how far its probability lies outside the ranks that the value covers.  One
    pass over the rows, counted before the shuffle."""
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    asked = estimates.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
                             *[F.col(c).alias(f"_q{i}") for i, c in enumerate(names)])
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).join(asked, same)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), *[
        f for i in range(len(names)) for f in (F.count_if(F.col("_v") < F.col(f"_q{i}")).alias(f"_below{i}"),
                                               F.count_if(F.col("_v") <= F.col(f"_q{i}")).alias(f"_upto{i}"))])
    return counts.select(*by, "n", *[
        F.greatest(F.lit(0e0), F.col(f"_below{i}") / F.col("n") - F.lit(float(p)),
                   F.lit(float(p)) - F.col(f"_upto{i}") / F.col("n")).alias(c)
        for i, (p, c) in enumerate(zip(probs, names, strict=True))])


# ------------------------------------------------------------- distinct keys
def distinct_bound(part: Column, whole: Column, lg_size: int, deviations: float = 4.0) -> Column:
    """Error that an estimate of ``part`` keys keeps when it is cut out of
    sketches over ``whole`` keys (``deviations`` standard errors of a sample of
    ``2 ** lg_size``)."""
    return F.lit(float(deviations)) * F.sqrt(part * whole / F.lit(2.0 ** lg_size))


def distinct_sketch(df: DataFrame, key: str, by: Sequence[str] = (), lg_size: int = 12,
                    name: str = "keys") -> DataFrame:
    """One row per group of ``by``: a sketch of the distinct non-null values of
    ``key``.  Sets of up to ``2 ** lg_size`` keys are held exactly."""
    return df.groupBy(*by).agg(F.theta_sketch_agg(key, F.lit(lg_size)).alias(name))


def merge_distinct_sketches(sketches: DataFrame, by: Sequence[str] = (), lg_size: int = 12,
                            name: str = "keys") -> DataFrame:
    """The unions of finer groups' key sets, one per group of ``by``."""
    return sketches.groupBy(*by).agg(F.theta_union_agg(name, F.lit(lg_size)).alias(name))


def sketch_key_overlap(left: DataFrame, lk: str, right: DataFrame, rk: str, lg_size: int = 12) -> DataFrame:
    """:func:`quality.key_overlap` from sketches: the same five columns,
    estimated, in one aggregate over both tables that moves two sketches a
    task and no key.  Both keys are cast to strings so that equal keys of
    different integer types meet."""
    both = left.select(F.col(lk).cast("string").alias("_l"), F.lit(None).cast("string").alias("_r")).unionByName(
        right.select(F.lit(None).cast("string").alias("_l"), F.col(rk).cast("string").alias("_r")))
    sets = both.agg(F.theta_sketch_agg("_l", F.lit(lg_size)).alias("_l"), F.theta_sketch_agg("_r", F.lit(lg_size)).alias("_r"))
    size = F.theta_sketch_estimate
    return sets.select(size("_l").alias("left_keys"), size("_r").alias("right_keys"),
                       size(F.theta_intersection("_l", "_r")).alias("overlapping"),
                       size(F.theta_difference("_l", "_r")).alias("only_left"),
                       size(F.theta_difference("_r", "_l")).alias("only_right"))
