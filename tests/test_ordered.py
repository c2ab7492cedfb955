"""Operators over ordered tables against plain Python, with hot keys and
borders between partitions, and their plans."""

import random
import re
from collections import Counter
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tally.operators import ordered as od
from tally.operators import ranking as rk


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def whole_exchanges(plan):
    """Exchanges to one task of anything but one row per partition."""
    found = re.findall(r"SinglePartition[^\n]*\n([^\n]*)", plan)
    return [x for x in found if not re.search(r"HashAggregate\(keys=\[_p#", x)]


@pytest.fixture(params=[1, 7])
def dealt(spark, request):
    """Partitions of the range sorts."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows_with_a_hot_key(seed, n=400):
    rng = random.Random(seed)
    keys = ["hot"] * 3 + ["a", None, "b", "c", "d"]
    return [(i, rng.choice(keys), rng.randrange(n), rng.choice([None, None, None, i * 1.5]) if i % 50 else None)
            for i in range(n)]


def test_fill_both_ways(spark, dealt):
    rows = rows_with_a_hot_key(1)
    df = spark.createDataFrame(rows, "id long, k string, t int, v double")
    for fill, sign in ((od.fill_forward, 1), (od.fill_backward, -1)):
        want, last = {}, {}
        for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0]), reverse=sign < 0):
            last[k] = v if v is not None else last.get(k)
            want[i] = last[k]
        got = fill(df, ["k"], ["t", "id"], ["v"])
        assert got.columns == df.columns
        assert {r.id: r.v for r in got.collect()} == want


def test_a_value_crosses_many_partitions(spark, dealt):
    """One value at the beginning of a key that fills most partitions."""
    rows = [(i, "hot", "first" if i == 0 else None, 7 if i == 150 else None) for i in range(300)]
    rows += [(400 + i, "z", None, None) for i in range(40)] + [(-1, "a", "other", 9)]
    df = spark.createDataFrame(rows, "id int, k string, s string, n int")
    got = {r.id: (r.s, r.n) for r in od.fill_forward(df, ["k"], ["id"], ["s", "n"]).collect()}
    assert got == {i: (("first" if k == "hot" else "other" if k == "a" else None),
                       (9 if k == "a" else 7 if k == "hot" and i >= 150 else None)) for i, k, _, _ in rows}
    assert od.fill_forward(df.limit(0), ["k"], ["id"], ["s"]).collect() == []
    whole = {r.id: r.n for r in od.fill_forward(df, [], [("id", False)], ["n"]).collect()}
    assert whole[0] == 7 and whole[150] == 7 and whole[151] is None and whole[-1] == 9


def test_no_window_over_the_key_alone(spark):
    df = spark.createDataFrame(rows_with_a_hot_key(2), "id long, k string, t int, v double")
    plan = plan_of(od.fill_forward(df, ["k"], ["t", "id"], ["v"]))
    assert "SinglePartition" not in plan and "hashpartitioning(k#" not in plan


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, dealt, strict):
    rng = random.Random(3)
    pick = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(i, pick(), rng.choice([rng.randrange(60), None])) for i in range(200)]
    right = [(i, pick(), rng.choice([rng.randrange(60), None]), rng.choice([None, "x", "y"])) for i in range(150)]
    a = spark.createDataFrame(left, "id int, k int, t int").withColumn("_side", F.lit(1))
    b = spark.createDataFrame(right, "rid int, rk int, rt int, v string")
    out = od.asof_join(a, b, {"k": "rk"}, "t", "rt", ["rid", "v"], ties=["rid"], strict=strict)
    assert out.columns == ["id", "k", "t", "_side", "rid", "v"]
    want = {}
    for i, k, t in left:
        fit = [(rt, rid, v) for rid, key, rt, v in right if None not in (k, t, key, rt) and key == k
               and (rt < t if strict else rt <= t)]
        want[i] = max(fit, key=lambda x: x[:2])[1:] if fit else (None, None)
    assert {r.id: (r.rid, r.v) for r in out.collect()} == want
    assert {r.rid for r in od.asof_join(a, b.limit(0), {"k": "rk"}, "t", "rt", ["rid"]).collect()} == {None}
    assert od.asof_join(a.limit(0), b, {"k": "rk"}, "t", "rt", ["rid"]).collect() == []


def test_asof_join_against_pandas(spark):
    rng = random.Random(4)
    left = sorted((datetime(2024, 1, 1 + rng.randrange(28), rng.randrange(24)), i) for i in range(120))
    right = sorted((datetime(2024, 1, 1 + rng.randrange(28), rng.randrange(24), 30), i) for i in range(80))
    a, b = pd.DataFrame(left, columns=["t", "i"]), pd.DataFrame(right, columns=["t", "j"])
    want = pd.merge_asof(a, b, on="t")
    out = od.asof_join(spark.createDataFrame(left, "t timestamp, i int"), spark.createDataFrame(right, "rt timestamp, j int"),
                       {}, "t", "rt", ["j"], ties=["j"]).collect()
    got = {r.i: r.j for r in out}
    times = {i: t for t, i in left}
    best = {j: t for t, j in right}
    for i, j in zip(want.i, want.j):
        assert (got[i] is None) == pd.isna(j)
        if got[i] is not None:
            assert best[got[i]] == best[int(j)] <= times[i]


@pytest.mark.parametrize("kind", ["int", "date"])
def test_interval_join(spark, kind):
    rng = random.Random(5)

    def spans(n, base):
        out = []
        for i in range(n):
            begin = rng.randrange(-40, 400)
            length = rng.choice([0, 0, 1, 3, 7, 8, 30, 300, -2])
            out.append((base + i, rng.choice([1, 1, 1, 2, None]), rng.choice([begin, begin, begin, None]), begin + length))
        return out

    left, right = spans(150, 0), spans(120, 1000)
    cast = (lambda c: c) if kind == "int" else (lambda c: F.date_add(F.lit(date(2024, 1, 1)), F.col(c)).alias(c))
    a = spark.createDataFrame(left, "i int, k int, b int, e int").select("i", "k", cast("b"), cast("e"))
    c = spark.createDataFrame(right, "j int, rk int, rb int, re int").select("j", "rk", cast("rb"), cast("re"))
    ok = lambda b, e: b is not None and b <= e
    want = Counter((i, j) for i, k, b, e in left for j, rk_, rb, re_ in right if ok(b, e) and ok(rb, re_)
                   and k is not None and k == rk_ and b <= re_ and rb <= e)
    out = od.interval_join(a, c, ("b", "e"), ("rb", "re"), {"k": "rk"})
    assert out.columns == ["i", "k", "b", "e", "j", "rk", "rb", "re"]
    assert Counter((r.i, r.j) for r in out.collect()) == want and want
    plan = plan_of(out)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    free = Counter((i, j) for i, _, b, e in left for j, _, rb, re_ in right if ok(b, e) and ok(rb, re_) and b <= re_ and rb <= e)
    assert Counter((r.i, r.j) for r in od.interval_join(a, c, ("b", "e"), ("rb", "re")).collect()) == free
    assert od.interval_join(a.limit(0), c, ("b", "e"), ("rb", "re")).collect() == []


def test_long_intervals_are_not_repeated_per_bucket(spark):
    """A long interval among short ones stays at two buckets a level."""
    a = spark.createDataFrame([(0, 0, 10**9)] + [(i, i, i) for i in range(1, 50)], "i long, b long, e long")
    held = od._leveled(a, ("b", "e"), [], "l")
    levels = held.select(F.col("_l_level").alias("_level"))
    assert levels.distinct().count() == 2
    assert od._lifted(held, "l", levels).count() <= 2 * 2 * 50
    assert od.interval_join(a, a.toDF("j", "rb", "re"), ("b", "e"), ("rb", "re")).count() == 1 + 2 * 49 + 49


def test_ranks_and_tiles(spark, dealt):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 5, 5, 5, 1, 2, 9]), rng.choice("ab")) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v int, g string").withColumn("_dense", F.lit(0))
    out = od.global_rank(df, [("v", False), "g"], "rank", "dense")
    key = {i: (v is None, -(v or 0), g) for i, v, g in rows}
    order = sorted(key.values())
    want = {i: (order.index(k) + 1, sorted(set(order)).index(k) + 1) for i, k in key.items()}
    assert {r.id: (r.rank, r.dense) for r in out.collect()} == want
    assert whole_exchanges(plan_of(out)) == []
    for n in (1, 3, 7, 100, 130):
        got = {r.id: r.ntile for r in od.global_ntile(df.drop("_dense"), [("v", False), "id"], n).collect()}
        ids = sorted((k[:2], i) for i, k in key.items())
        size, more = divmod(100, n)
        want, at = {}, 0
        for bucket in range(1, n + 1):
            for _ in range(size + (bucket <= more)):
                want[ids[at][1]] = bucket
                at += 1
        assert got == want
    assert od.global_ntile(df.limit(0), ["id"], 3).collect() == []


def test_running_shares_have_no_window_over_all_rows(spark, dealt):
    df = spark.createDataFrame([("a", 50.0), ("b", 0.1), ("c", 0.2), ("d", 49.7), ("e", None)], "k string, s double")
    out = rk.cumulative_share(df, [("s", False), "k"], "s", "run")
    assert [(r.k, r.run) for r in out.orderBy(F.desc_nulls_last("s")).collect()][:4] == [
        ("a", 50.0), ("d", 99.7), ("c", 99.9), ("b", 100.0)]
    first = rk.prefix_until(df, [("s", False), "k"], "s", 50.0)
    assert [r.k for r in first.collect()] == ["a"] and first.columns == ["k", "s"]
    assert whole_exchanges(plan_of(out)) == []


def test_source_order(spark, tmp_path):
    """The same whatever tasks read; ties and formats follow the first row."""
    raw = [None, "  3/4/2024 ", "13/12/2023", "2024-05-06", "31/2/2024", "x"] + ["1/1/2020"] * 3000
    rows = [(i, raw[i] if i < len(raw) else None, ["p", "q", "r"][i % 3]) for i in range(3006)]
    for form in ("parquet", "json"):
        path = str(tmp_path / form)
        spark.createDataFrame(rows, "i int, d string, v string").coalesce(1).write.format(form).save(path)
        results = set()
        for size in ("2000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = od.with_source_order(spark.read.schema("i int, d string, v string").format(form).load(path))
            counts = od.counts_by_first_seen(df, "v", "_source_order")
            dates = od.infer_day_first(df, "d", "_source_order", "day")
            back = [r.i for r in df.orderBy("_source_order").select("i").collect()]
            assert back == list(range(3006))
            results.add((tuple(sorted((r.place, r.v, r.n) for r in counts.collect())),
                         tuple(sorted((r.i, str(r.day)) for r in dates.where("i < 6").collect()))))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert results == {(((1, "p", 1002), (2, "q", 1002), (3, "r", 1002)),
                            ((0, "None"), (1, "2024-04-03"), (2, "2023-12-13"), (3, "None"), (4, "None"), (5, "None")))}


def test_inferred_format(spark):
    def parsed(values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, d string")
        return [str(r.day) for r in od.infer_day_first(df, "d", "i", "day").orderBy("i").collect()]

    assert parsed(["2024-05-06", "3/4/2024"]) == ["2024-05-06", "None"]
    assert parsed([None, "02-03-2024", "2024-05-06"]) == ["None", "2024-03-02", "None"]
    assert parsed(["what", "2024-05-06"]) == ["None", "None"]
    assert parsed([None]) == ["None"] and parsed([]) == []
    assert parsed(["5 Mar 2024", "6.3.2024"]) == ["2024-03-05", "None"]
