"""Totals over several grouping levels in one scan, and the operations on
multisets of rows (the ``ALL`` forms of union, intersection, difference)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions

# ------------------------------------------------------------- levels
def rollup_levels(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """All keys, then one fewer from the right, down to the grand total."""
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_levels(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """Every subset of the keys."""
    return [level for n in range(len(keys), -1, -1) for level in combinations(keys, n)]


#: Rows that one task of :func:`level_totals` folds at most.
TASK_ROWS = 1 << 21


def _dealt(df: DataFrame, times: int) -> tuple[DataFrame, int]:
    """``df`` frozen and dealt evenly, for rows that will be repeated ``times``
    times, and the number of tasks that ``TASK_ROWS`` asks for."""
    held = cut_lineage(df)
    tasks = max(1, -(-held.count() * times // TASK_ROWS))
    return held.repartition(tasks) if tasks > 1 else held, tasks


def level_totals(df: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[str]],
                 sums: Mapping[str, Column | str] | None = None,
                 distinct: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Totals of every group of every level (a subset of ``keys``): the keys
    (null where the level leaves them out), ``level`` (SQL's GROUPING_ID: a
    bit per left-out key, the last key lowest), ``n_rows``, the ``sums`` and
    the exact counts of ``distinct`` non-null values.  A level named twice
    counts once; an empty table has no groups.

    The rows are read once and folded to *cells* (all keys, and per distinct
    column its value) before anything is repeated; the levels are expanded
    from the cells.  A distinct value is a group of its own until the last
    step, which only counts, so no task holds a group's set of values.

    Rows and cells are frozen before they are repeated, and dealt to so many
    tasks that none folds more than ``TASK_ROWS`` of the repeated rows: more
    rows mean more tasks, not larger ones."""
    keys, sums, distinct = list(keys), dict(sums or {}), dict(distinct or {})
    unknown = {c for level in levels for c in level} - set(keys)
    if unknown:
        raise ValueError(f"levels name columns that are no keys: {sorted(unknown)}")

    def column(c):
        return F.col(c) if isinstance(c, str) else c

    k = [f"_k{i}" for i in range(len(keys))]
    s = [f"_s{i}" for i in range(len(sums))]
    d = [f"_d{i}" for i in range(len(distinct))]
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)],
                     *[column(c).alias(a) for c, a in zip(sums.values(), s, strict=True)],
                     *[column(c).alias(a) for c, a in zip(distinct.values(), d, strict=True)])
    # kind 0 carries the sums, kind i the i-th distinct column
    kinds = [F.struct(F.lit(i).alias("kind"), *[
        (F.col(c) if i == j else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for j, c in enumerate(d, 1)])
        for i in range(len(d) + 1)]
    spark = df.sparkSession
    rows, tasks = _dealt(rows, len(kinds)) if d else (rows, 1)  # without distinct values a task holds few groups
    tagged = rows.select(*k, *s, F.explode(F.array(*kinds)).alias("_x")).select(
        *k, "_x.*", *[F.when(F.col("_x.kind") == 0, F.col(c)).alias(c) for c in s])
    filled = F.col("kind") == 0
    for i, c in enumerate(d, 1):
        filled = filled | ((F.col("kind") == i) & F.col(c).isNotNull())
    folded = [F.sum(c).alias(c) for c in s]
    cells = tagged.where(filled).groupBy(*k, "kind", *d).agg(F.count("*").alias("_n"), *folded)
    if d:
        with shuffle_partitions(spark, tasks):
            cells, tasks = _dealt(cells, len(levels))

    wanted = sorted({sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in level) for level in levels})
    masks = [F.struct(F.lit(w).cast("bigint").alias("_level"), *[
        (F.lit(None).cast(rows.schema[c].dataType) if w >> (len(keys) - 1 - i) & 1 else F.col(c)).alias(c)
        for i, c in enumerate(k)]) for w in wanted]
    spread = cells.select(F.explode(F.array(*masks)).alias("_m"), "kind", *d, "_n", *s).select("_m.*", "kind", *d, "_n", *s)
    sets = spread
    if d:
        with shuffle_partitions(spark, tasks):
            sets = cut_lineage(spread.groupBy("_level", *k, "kind", *d).agg(F.sum("_n").alias("_n"), *folded))
    out = sets.groupBy("_level", *k).agg(
        F.sum(F.when(F.col("kind") == 0, F.col("_n"))).alias("n_rows"), *folded,
        *[F.count_if(F.col("kind") == i).alias(c) for i, c in enumerate(d, 1)])
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)], F.col("_level").alias("level"), "n_rows",
                      *[F.col(a).alias(c) for c, a in zip(sums, s, strict=True)],
                      *[F.col(a).alias(c) for c, a in zip(distinct, d, strict=True)])


# ------------------------------------------------------------- multisets
COPIES = 4096
"""Copies of a row that one generated block holds."""


def multiplicities(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each different row (``row``, columns matched by name, nulls equal) with
    ``left_n`` and ``right_n``, how often it occurs on either side.  One
    aggregate over both tables, no join: copies are counted before the
    shuffle.  Maps cannot be grouped and are refused by Spark."""
    if set(left.columns) != set(right.columns):
        raise ValueError("both tables need the same columns")
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row")
    both = left.select(row, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(row, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy("row").agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))


def unfold(counted: DataFrame, copies: Column) -> DataFrame:
    """The rows of ``row``, each ``copies`` times.  A row with many copies is
    cut into blocks that are dealt over the tasks."""
    held = counted.select("row", copies.cast("bigint").alias("_n")).where("_n > 0")
    few = held.where(F.col("_n") <= COPIES)
    blocks = held.where(F.col("_n") > COPIES).select(
        "row", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES).cast("bigint"))).alias("_b"))
    many = blocks.repartition("row", "_b").select(
        "row", F.least(F.lit(COPIES).cast("bigint"), F.col("_n") - F.col("_b") * COPIES).alias("_n"))
    return few.unionByName(many).select("row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("row.*")


def intersect_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """INTERSECT ALL: a row as often as on the side that has it less often."""
    return unfold(multiplicities(left, right), F.least("left_n", "right_n"))


def except_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT ALL: a row of the left as often as it is there in excess."""
    return unfold(multiplicities(left, right), F.col("left_n") - F.col("right_n"))


def largest_union_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset union: a row as often as on the side that has it more often
    (UNION ALL, which adds the counts, is ``unionByName``)."""
    return unfold(multiplicities(left, right), F.greatest("left_n", "right_n"))
