"""Operators over an ordered table that need no window over a hot key.

Rows are range-partitioned by (keys, order) and frozen with their partition
and place, so a key that holds a third of all rows lies in many partitions.
Inside a partition a window by (partition, key) does the work; what must pass
from one partition to the next is one *carry row* per partition, found by a
window over as many rows as there are partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import OrderItem, global_row_number, order_columns


# ------------------------------------------------------------- segmented scan
def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[OrderItem],
               values: Mapping[str, Column | str]) -> DataFrame:
    """``df`` with one column per entry of ``values``: its last non-null value
    at or before the row, in ``order``, among the rows of the same ``keys``
    (nulls are a key like any other; no keys: the whole table).  ``order``
    ends in a unique column if the result is to be unique."""
    held = df.withColumns({name: F.col(v) if isinstance(v, str) else v for name, v in values.items()})
    by = [*[F.col(k) for k in keys], *order_columns(order)]
    frozen = cut_lineage(held.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_all"))
    ends = frozen.groupBy("_p").agg(
        F.min_by(key, "_i").alias("_begins"), F.max_by(key, "_i").alias("_stops"),
        # the last value in the partition, with the key that it belongs to
        *[F.max_by(F.when(F.col(v).isNotNull(), F.struct(key.alias("k"), F.col(v).alias("v"))),
                   F.when(F.col(v).isNotNull(), F.col("_i"))).alias(f"_last_{i}") for i, v in enumerate(values)])
    ends = cut_lineage(ends)  # one row per partition
    leave = ends.select(
        F.col("_stops").alias("_key"), "_p", F.lit(1).alias("_kind"),
        *[F.when(F.col(f"_last_{i}.k").eqNullSafe(F.col("_stops")), F.col(f"_last_{i}.v")).alias(f"_v{i}")
          for i in range(len(values))])
    enter = ends.select(F.col("_begins").alias("_key"), "_p", F.lit(0).alias("_kind"),
                        *[F.lit(None).cast(frozen.schema[v].dataType).alias(f"_v{i}") for i, v in enumerate(values)])
    so_far = Window.partitionBy("_key").orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (leave.unionByName(enter)
             .select("_key", "_p", "_kind", *[F.last(f"_v{i}", ignorenulls=True).over(so_far).alias(f"_v{i}")
                                              for i in range(len(values))])
             .where("_kind = 0").drop("_kind"))
    here = Window.partitionBy("_p", *keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = frozen.join(carry, "_p")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in values], *[
        F.coalesce(F.last(v, ignorenulls=True).over(here), F.when(key.eqNullSafe(F.col("_key")), F.col(f"_v{i}"))).alias(v)
        for i, v in enumerate(values)])


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[OrderItem], cols: Sequence[str]) -> DataFrame:
    """Nulls of ``cols`` replaced by the last value before them."""
    return carry_last(df, keys, order, {c: c for c in cols}).select(*df.columns)


def fill_backward(df: DataFrame, keys: Sequence[str], order: Sequence[OrderItem], cols: Sequence[str]) -> DataFrame:
    """Nulls of ``cols`` replaced by the next value behind them."""
    back = [(c, False) if isinstance(c, str) else (c[0], not c[1]) for c in order]
    return fill_forward(df, keys, back, cols)


def asof_join(left: DataFrame, right: DataFrame, on: Mapping[str, str], left_time: str, right_time: str,
              columns: Sequence[str], ties: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the last row of ``right`` of
    the same keys (``on``: left name to right name) whose time is at or before
    the left one (``strict``: before).  Equal times of ``right`` count in the
    order of ``ties``, the last one wins.  Rows without a key or time match
    nothing.

    One range sort of both tables together; the matched row is carried along,
    also from partition to partition."""
    keys = [f"_k{i}" for i in range(len(on))]
    ranks = [f"_t{i}" for i in range(len(ties))]
    known = F.lit(True)
    for c in (*on, left_time):
        known = known & F.col(c).isNotNull()
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    found = right.select(*columns).schema
    side = 0 if strict else 1
    asks = left.select(*[F.col(a).alias(k) for a, k in zip(on, keys, strict=True)], F.col(left_time).alias("_time"),
                       F.lit(side).alias("_side"), known.alias("_known"), row.alias("_row"))
    answers = right.dropna(subset=[*on.values(), right_time]).select(
        *[F.col(b).alias(k) for b, k in zip(on.values(), keys, strict=True)], F.col(right_time).alias("_time"),
        F.lit(1 - side).alias("_side"), *[F.col(c).alias(r) for c, r in zip(ties, ranks, strict=True)],
        F.struct(*[F.col(c) for c in columns]).alias("_found"))
    both = asks.where("_known").unionByName(answers, allowMissingColumns=True)
    done = carry_last(both, keys, ["_time", "_side", *ranks], {"_found": "_found"}).where("_row is not null")
    unknown = asks.where(~F.col("_known")).select("_row", F.lit(None).cast(done.schema["_found"].dataType).alias("_found"))
    return done.select("_row", "_found").unionByName(unknown).select(
        "_row.*", *[F.col(f"_found.`{f.name}`").alias(f.name) for f in found])


# ------------------------------------------------------------- ranks
def global_rank(df: DataFrame, order: Sequence[OrderItem], rank: str | None = "rank",
                dense: str | None = None) -> DataFrame:
    """RANK and DENSE_RANK of every row over the whole table.  Ties are
    counted first; the distinct order values get their positions and running
    counts (no window over all rows), which are joined back."""
    names = [c if isinstance(c, str) else c[0] for c in order]
    counted = df.groupBy(*names).agg(F.count("*").alias("_ties"))
    placed = global_row_number(counted, order, "_dense", running_sum="_ties", sum_name="_upto")
    placed = placed.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(names)],
                           (F.col("_upto") - F.col("_ties") + 1).alias("_rank_"), F.col("_dense").alias("_dense_"))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(f"_row.`{c}`").eqNullSafe(F.col(f"_o{i}"))
    wanted = [(rank, F.col("_rank_")), (dense, F.col("_dense_"))]
    return row.join(placed, same).select("_row.*", *[x.cast("bigint").alias(n) for n, x in wanted if n])


def global_ntile(df: DataFrame, order: Sequence[OrderItem], buckets: int, name: str = "ntile") -> DataFrame:
    """NTILE over the whole table: the first buckets hold one row more where
    the rows do not divide evenly.  ``order`` ends in a unique column."""
    if buckets < 1:
        raise ValueError("at least one bucket")
    placed = global_row_number(df, order, "_place")
    total = df.select(F.count("*")).scalar()
    least = F.floor(total / buckets)
    more = total % buckets  # buckets with one more
    edge = more * (least + 1)
    early = F.ceil(F.col("_place") / (least + 1))
    late = more + F.ceil((F.col("_place") - edge) / F.greatest(least, F.lit(1)))
    return placed.withColumn(name, F.when(F.col("_place") <= edge, early).otherwise(late).cast("bigint")).drop("_place")


# ------------------------------------------------------------- intervals
def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                  on: Mapping[str, str] | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals overlap (``on``: left key to right
    key); a span's columns are whole numbers, dates or timestamps.  Columns of
    both sides; names must differ.

    An interval belongs to the level of its length (powers of two) and there
    touches at most two buckets, however long it is.  A pair meets at the
    larger of its two levels: one join takes left intervals at their own level
    with right ones of that level or below, the other right intervals with
    lower left ones; the lower side is repeated at the higher levels that the
    other side has, twice at most each.  A pair that shares two buckets counts
    in the first.  Both are plain equi-joins with the exact test as a residual
    condition, so Spark splits skewed buckets; empty (end before begin) and
    unknown spans join nothing."""
    on = dict(on or {})
    a, b = _leveled(left, left_span, list(on), "l"), _leveled(right, right_span, list(on.values()), "r")
    keys = [f"_key{i}" for i in range(len(on))]
    first = _meet(a, "l", _lifted(b, "r", a.select(F.col("_l_level").alias("_level"))), "r", keys)
    second = _meet(b, "r", _lifted(a, "l", b.select(F.col("_r_level").alias("_level")), below=True), "l", keys)
    names = ["_l_row", "_r_row"]
    return first.select(*names).unionByName(second.select(*names)).select("_l_row.*", "_r_row.*")


def _whole(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    if kind == "date":
        return F.unix_date(F.col(c)).cast("long")
    return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c).cast("long")


def _leveled(df: DataFrame, span: tuple[str, str], keys: Sequence[str], side: str) -> DataFrame:
    """Rows with ``_<side>_`` begin, end and level (2**level exceeds the length)."""
    begin, end = (_whole(df, c) for c in span)
    out = df.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], begin.alias(f"_{side}_begin"),
                    end.alias(f"_{side}_end"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"_{side}_row"))
    length = F.col(f"_{side}_end") - F.col(f"_{side}_begin")
    out = out.where(length >= 0)
    return out.withColumn(f"_{side}_level", F.length(F.ltrim(F.bin(length), F.lit("0"))).cast("int"))


def _buckets(side: str, level: Column) -> Column:
    """The one or two buckets of width 2**level that an interval touches."""
    low, high = (F.call_function("shiftright", F.col(f"_{side}_{x}"), level) for x in ("begin", "end"))
    return F.sequence(low, high)


def _lifted(df: DataFrame, side: str, levels: DataFrame, below: bool = False) -> DataFrame:
    """The rows at every level of ``levels`` from their own (or above) on."""
    # At most 64 levels exist, so they are an array in every row.
    held = F.lit(levels.select(F.sort_array(F.collect_set("_level"))).scalar())
    level, own = F.col("_level"), F.col(f"_{side}_level")
    out = df.withColumn("_held", held).withColumn("_level", F.explode("_held")).drop("_held")
    out = out.where(level > own if below else level >= own)
    return out.withColumn("_bucket", F.explode(_buckets(side, F.col("_level"))))


def _meet(own: DataFrame, side: str, other: DataFrame, other_side: str, keys: Sequence[str]) -> DataFrame:
    own = own.withColumn("_level", F.col(f"_{side}_level")).withColumn("_bucket", F.explode(_buckets(side, F.col("_level"))))
    begin = F.greatest(F.col(f"_{side}_begin"), F.col(f"_{other_side}_begin"))
    overlap = begin <= F.least(F.col(f"_{side}_end"), F.col(f"_{other_side}_end"))
    once = F.col("_bucket") == F.call_function("shiftright", begin, F.col("_level"))
    return own.join(other, [*keys, "_level", "_bucket"]).where(overlap & once)


# ------------------------------------------------------------- source order
def with_source_order(df: DataFrame, name: str = "_source_order") -> DataFrame:
    """``df``, read from files, with the place of every row in its source: the
    file's path, then the row's number in it where the format knows it
    (parquet), else the block's start and the row's turn in the block.  Place
    this directly behind the read; the result does not depend on how rows are
    dealt to tasks."""
    fields = df.select("_metadata").schema["_metadata"].dataType.fieldNames()
    inside = F.col("_metadata.row_index") if "row_index" in fields else F.col("_metadata.file_block_start")
    turn = F.lit(0).cast("long") if "row_index" in fields else F.monotonically_increasing_id()
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), inside.alias("at"), turn.alias("turn"))
                     .alias(name))


def counts_by_first_seen(df: DataFrame, c: str, order: str, count_name: str = "n", place: str = "place") -> DataFrame:
    """Rows per value, most first, ties in the order in which the values first
    appear; ``place`` is the position in that order.  Null is no value."""
    grouped = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(count_name), F.min(order).alias("_seen"))
    return global_row_number(grouped, [(count_name, False), "_seen"], place).select(c, count_name, F.col(place).cast("bigint"))


#: Day-first formats: how a value that has the form reads (fixed values).
DAY_FIRST_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
)


def infer_day_first(df: DataFrame, c: str, order: str, name: str) -> DataFrame:
    """``df`` with ``name``: the date that ``c`` holds, read in the one format
    that its first non-null value (in ``order``) has; values of another format
    are null, as are all if the first has none of the known ones."""
    first = df.where(F.col(c).isNotNull()).select(F.min_by(F.trim(F.col(c)), order).alias("x"))
    value = first.scalar()  # one aggregate, read once
    out = F.lit(None).cast("date")
    for form, pattern in reversed(DAY_FIRST_FORMATS):
        fits = F.trim(F.col(c)).rlike(form)
        out = F.when(value.rlike(form), F.when(fits, F.try_to_timestamp(F.trim(F.col(c)), F.lit(pattern)).cast("date"))
                     ).otherwise(out)
    return df.withColumn(name, out)
