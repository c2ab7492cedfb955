"""Levels and multisets against plain Python; sketches against the exact
operators, within their bounds; hot groups and empty tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tally.operators import bags as bg
from tally.operators import sketches as sk
from tally.operators import stats as st


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------- multisets
BAG = "a long, b string"


def _bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_multisets_like_counters(spark):
    rng = random.Random(3)

    def some(n):
        return [(rng.choice([1, 2, None]), rng.choice(["x", "y", None])) for _ in range(n)]

    rows = some(200) + [(7, "hot")] * 9000, some(120) + [(7, "hot")] * 4097 + [(8, "right")]
    left, right = (spark.createDataFrame(r, BAG) for r in rows)
    l, r = map(Counter, rows)
    assert _bag(bg.intersect_rows(left, right)) == l & r
    assert _bag(bg.except_rows(left, right)) == l - r
    assert _bag(bg.largest_union_rows(left, right)) == l | r
    assert _bag(bg.except_rows(left, left)) == Counter()


def test_multisets_by_name_and_empty(spark):
    left = spark.createDataFrame([(1, "x"), (1, "x")], BAG)
    swapped = spark.createDataFrame([("x", 1)], "b string, a long")
    assert _bag(bg.except_rows(left, swapped)) == Counter([(1, "x")])
    none = spark.createDataFrame([], BAG)
    assert _bag(bg.except_rows(left, none)) == Counter([(1, "x")] * 2)
    assert _bag(bg.intersect_rows(none, left)) == _bag(bg.largest_union_rows(none, none)) == Counter()
    with pytest.raises(ValueError):
        bg.multiplicities(left, left.drop("b"))


def test_multisets_need_no_join(spark):
    left = spark.range(10).select("id", F.lit("x").alias("row"))
    out = bg.intersect_rows(left, left)
    assert "Join" not in plan_of(out)
    assert out.columns == ["id", "row"] and out.count() == 10


# ------------------------------------------------------------- levels
def test_levels_like_plain_python(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", None]), rng.choice([1, 2, None]), rng.choice([None, 2, 3, 5]),
             rng.choice(["p", "q", None]), rng.choice([None, *range(40)])) for i in range(500)]
    df = spark.createDataFrame(rows, "x string, level int, v long, d string, e int")
    got = bg.level_totals(df, ["x", "level"], bg.cube_levels(["x", "level"]), {"s": "v"}, {"ds": "d", "es": "e"})
    # a key named like a result column comes out beside it, by place
    have = Counter(tuple(r) for r in got.collect())
    want = Counter()
    for bits in range(4):
        groups = {}
        for r in rows:
            groups.setdefault((None if bits & 2 else r[0], None if bits & 1 else r[1]), []).append(r)
        for key, g in groups.items():
            vs = [r[2] for r in g if r[2] is not None]
            want[(*key, bits, len(g), sum(vs) if vs else None, len({r[3] for r in g} - {None}),
                  len({r[4] for r in g} - {None}))] += 1
    assert have == want


def test_levels_read_the_table_once(spark, tables):
    keys = ["o_orderstatus", "o_orderpriority"]
    orders = tables.base("orders")
    out = bg.level_totals(orders, keys, [*bg.rollup_levels(keys), ()], {"s": "o_totalprice"}, {"c": "o_custkey"})
    assert plan_of(out).count("Scan parquet") == 1
    assert out.where("level = 3").count() == 1
    total = out.where("level = 3").first()
    assert (total.n_rows, total.c) == (orders.count(), orders.select("o_custkey").distinct().count())
    assert out.where("level = 2").count() == 0  # a rollup has no level without its first key
    plain = bg.level_totals(orders, keys, [keys])
    assert plain.columns == [*keys, "level", "n_rows"]
    assert plain.agg(F.sum("n_rows").alias("n")).first().n == orders.count()
    assert bg.level_totals(orders.where("o_orderkey < 0"), keys, bg.cube_levels(keys), {}, {"c": "o_custkey"}).count() == 0
    with pytest.raises(ValueError):
        bg.level_totals(orders, keys, [("o_custkey",)])


# ------------------------------------------------------------- sketches
def _numbers(spark, n=60_000):
    """A hot group with a hot value, one of few rows, one without numbers."""
    i = F.col("id")
    return spark.range(n, numPartitions=11).select(
        F.when(i % 3 > 0, "hot").when(i % 300 == 0, "few").when(i % 301 == 0, "none").otherwise("other").alias("g"),
        F.when(i % 301 == 0, F.when(i % 2 == 0, F.lit(math.nan))).when(i % 5 == 0, 42e0)
        .otherwise((i * 7919 % 10007).cast("double")).alias("v"))


@pytest.mark.parametrize("size", [100, 400])
def test_quantile_error_stays_in_its_bound(spark, size):
    df, probs, names = _numbers(spark), [0.0, 0.05, 0.5, 0.95, 1.0], ["lo", "a", "m", "z", "hi"]
    whole = sk.quantile_sketch(df, "v", ["g"], size)
    found = sk.sketch_quantiles(whole, probs, names)
    errors = sk.quantile_rank_errors(df, "v", found, probs, names, ["g"]).collect()
    assert len(errors) == 3 + (df.where("g = 'none' and v is not null and not isnan(v)").count() > 0)
    for r in errors:
        assert r.lo == r.hi == 0 and max(r.a, r.m, r.z) <= 2 * sk.quantile_rank_bound(size)
    exact = {r.g: r for r in st.exact_quantiles(df, "v", [0.0, 1.0], ["g"], ["lo", "hi"]).collect()}
    for r in found.where("n > 0").collect():
        assert (r.lo, r.hi, r.n) == (exact[r.g].lo, exact[r.g].hi, exact[r.g].n)


def test_merged_quantile_sketches_and_groups_without_numbers(spark):
    df = _numbers(spark).withColumn("day", F.spark_partition_id())
    days = sk.quantile_sketch(df, "v", ["day", "g"], 400)
    found = sk.sketch_quantiles(sk.merge_quantile_sketches(days, ["g"]), [0.5], ["m"])
    for r in sk.quantile_rank_errors(df, "v", found, [0.5], ["m"], ["g"]).collect():
        assert r.m <= 2 * sk.quantile_rank_bound(400)
    blank = spark.createDataFrame([("a", None), ("a", math.nan), (None, 3.0)], "g string, v double")
    got = sk.sketch_quantiles(sk.merge_quantile_sketches(sk.quantile_sketch(blank, "v", ["g"]), ["g"]), [0.5], ["m"])
    assert {r.g: (r.n, r.m) for r in got.collect()} == {"a": (0, None), None: (1, 3.0)}


def test_distinct_sets_keep_their_bound(spark):
    left = spark.range(50_000).select((F.col("id") % 30_000).alias("k"))
    right = spark.range(20_000, 60_000).select(F.col("id").cast("int").alias("j"))
    want = {"left_keys": 30_000, "right_keys": 40_000, "overlapping": 10_000, "only_left": 20_000, "only_right": 30_000}
    got = sk.sketch_key_overlap(left, "k", right, "j").first().asDict()
    for c, n in want.items():
        assert abs(got[c] - n) <= 4 * math.sqrt(n * 60_000 / 4096)
    small = sk.sketch_key_overlap(left.where("k < 1500"), "k", right.where("j < 20700"), "j").first().asDict()
    assert small == {"left_keys": 1500, "right_keys": 700, "overlapping": 0, "only_left": 1500, "only_right": 700}
    none = sk.sketch_key_overlap(left.where("k < 0"), "k", right.where("j < 0"), "j").first()
    assert set(none) == {0}


def test_distinct_sketches_merge(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("day"), (F.col("id") % 2).alias("g"),
                                  (F.col("id") % 1800).alias("k"))
    merged = sk.merge_distinct_sketches(sk.distinct_sketch(df, "k", ["day", "g"]), ["g"])
    assert {r.g: r.n for r in merged.select("g", F.theta_sketch_estimate("keys").alias("n")).collect()} == {0: 900, 1: 900}
