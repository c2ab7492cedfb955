"""Ordering, top-k and window operators.

Windows here are either partitioned by a key (rank within state, share
within city), or run without a partition key over rows that are ALREADY
grouped (months, states, funnel stages) - never over raw rows.  Every
sort ends in a unique key so ties are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_ratio, sql_round
from ..session import cut_lineage


def _order(spec: Sequence[tuple[str | Column, bool]]) -> list[Column]:
    out = []
    for c, asc in spec:
        x = F.col(c) if isinstance(c, str) else c
        out.append(x.asc_nulls_first() if asc else x.desc_nulls_last())
    return out


#: A column to sort by: its name (ascending, nulls first) or (name, ascending).
OrderItem = str | tuple[str, bool]


def order_columns(order: Sequence[OrderItem]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else _order([c])[0] for c in order]


def sort_by(df: DataFrame, spec: Sequence[tuple[str | Column, bool]]) -> DataFrame:
    return df.orderBy(*_order(spec))


def top_k(df: DataFrame, k: int, spec: Sequence[tuple[str | Column, bool]]) -> DataFrame:
    """Sort + limit: planned as TakeOrderedAndProject (per-partition top-k,
    then a k-row merge), never a full sort."""
    return df.orderBy(*_order(spec)).limit(k)


def head_sample(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    return df.orderBy(*key).limit(n)


def arg_max(df: DataFrame, key: str, measure: str) -> DataFrame:
    """Key with the largest measure (ties -> smallest key), one row."""
    return df.orderBy(F.col(measure).desc_nulls_last(), F.col(key).asc()).limit(1).select(key, measure)


def dense_rank_top_n(df: DataFrame, part: Sequence[str], order: Sequence[tuple[str | Column, bool]],
                     n: int, name: str = "Rank") -> DataFrame:
    """Rows ranked 1..n by DENSE_RANK within each partition (ties kept).
    Catalyst adds a WindowGroupLimit, pruning each partition before the
    shuffle."""
    w = Window.partitionBy(*part).orderBy(*_order(order))
    return df.withColumn(name, F.dense_rank().over(w).cast("bigint")).where(F.col(name) <= n)


def row_number_top1(df: DataFrame, part: Sequence[str], order: Sequence[tuple[str | Column, bool]]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*_order(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def running_total(grouped: DataFrame, order: str, c: str, name: str) -> DataFrame:
    """Cumulative sum over already-grouped rows with unique ``order`` keys."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grouped.withColumn(name, F.sum(c).over(w))


def lag_growth(grouped: DataFrame, order: str, c: str, prev: str, growth: str, digits: int = 2) -> DataFrame:
    """Previous value and % change vs it, NULL when there is no positive
    previous value; rounded half-up like SQL ROUND."""
    w = Window.orderBy(order)
    out = grouped.withColumn(prev, F.lag(c).over(w))
    return out.withColumn(growth, sql_round(safe_ratio((F.col(c) - F.col(prev)) * 100.0, prev), digits))


#: Type of exact running sums of shares.
EXACT = "decimal(28,12)"


def cumulative_share(grouped: DataFrame, order: Sequence[tuple[str | Column, bool]], share: str,
                     name: str) -> DataFrame:
    """Running sum of ``share`` in a unique order, without a window over all
    rows.  It is formed in decimals (12 places), so that neither partitions
    nor the order of additions show in it."""
    exact = grouped.withColumn("_exact", F.col(share).cast(EXACT))
    out = global_row_number(exact, order, "_place", running_sum="_exact", sum_name="_running")
    return out.select(*[F.col(f"`{c}`") for c in grouped.columns if c != name], F.col("_running").cast("double").alias(name))


def prefix_until(grouped: DataFrame, order: Sequence[tuple[str | Column, bool]], share: str,
                 target: float = 50.0) -> DataFrame:
    """Shortest prefix (in ``order``) whose running share reaches
    ``target``: keep rows whose running share BEFORE them is below it."""
    exact = grouped.withColumn("_exact", F.coalesce(F.col(share).cast(EXACT), F.lit(0).cast(EXACT)))
    out = global_row_number(exact, order, "_place", running_sum="_exact", sum_name="_running")
    return out.where(F.col("_running") - F.col("_exact") < F.lit(target)).select(*grouped.columns)


def within_group_share(grouped: DataFrame, part: Sequence[str], count_col: str, name: str) -> DataFrame:
    w = Window.partitionBy(*part)
    return grouped.withColumn(name, F.col(count_col) * 100.0 / F.sum(count_col).over(w))


def fixed_order(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep only keys listed in ``order`` and sort by their position.  The
    order list is configuration (bounded), so it is broadcast."""
    dim = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(order)], f"`{key}` string, _ord int")
    return df.join(F.broadcast(dim), key, "inner").orderBy("_ord").drop("_ord")


def global_row_number(df: DataFrame, order: Sequence[OrderItem], name: str = "row_number",
                      running_sum: str | None = None, sum_name: str = "running_sum") -> DataFrame:
    """1-based position of every row in the order of ``order``
    (ties in any order; name a unique key last where many rows tie, so that
    they spread over the partitions), optionally with the running sum of ``running_sum``
    in that order - without a single-partition window.

    The rows are range-partitioned on the order columns and frozen with
    their partition id and row id in the checkpoint folder; per-partition
    counts (and sums) give each partition's offset through a window over at
    most ``partitions`` rows; a row's position is its offset plus its place
    inside the sorted partition.  The running sum inside a partition is a
    window partitioned by that partition, so no task holds more than one
    range partition."""
    by = order_columns(order)
    frozen = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("_p", F.spark_partition_id())
                         .withColumn("_i", F.monotonically_increasing_id()))
    aggs = [F.count("*").alias("_c"), F.min("_i").alias("_i0")]
    if running_sum:
        aggs.append(F.sum(running_sum).alias("_s"))
    seg = frozen.groupBy("_p").agg(*aggs)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if running_sum:
        seg = seg.withColumn("_soff", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    out = frozen.join(seg, "_p", "inner").withColumn(name, F.col("_off") + F.col("_i") - F.col("_i0") + 1)
    if running_sum:
        within = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(sum_name, F.col("_soff") + F.sum(running_sum).over(within))
    drop = ["_p", "_i", "_c", "_i0", "_off", "_s", "_soff"]
    return out.drop(*[c for c in drop if c in out.columns])
