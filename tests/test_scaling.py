"""Steps whose cost must not grow faster than the rows: messages formed by
batches, folds of bounded tasks, rows read once."""

import pytest
from pyspark.sql import functions as F

from tally.operators import bags as bg
from tally.operators import quality as q
from tally.operators import stats as st
from tally.operators import table_functions as tf
from tally.plans import catalog

ODD = [None, "", " ", ".", "1.2.3", "5", "5.00005", "5.00015", " 7 ", "-3", "+9", "1e400", "-inf", "Infinity", "nan", "NaN",
       "+nan", "+NaN", "1_0", "1__0", "9.", ".9", "９", "7d", "0x9", "ND", "land", "<9", " 9 ", "1e1_0",
       "123456789012345678901234.5", "Positive", " POSITIVE "]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_agree_with_the_outcome(spark):
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(ODD)], "id int, lead string, argemone string")
    rules = [r for r in q.DEFAULT_RULES if r.param in ("lead", "argemone")]
    for r in q.rule_evaluate(df).collect():
        said = [m for m in (q.failure_message(x, r.lead, q.PASS_TOKENS) for x in rules if r.lead is not None) if m]
        assert r.Failure_Reason == " | ".join(said), r
        assert r.Pass_Fail == ("FAIL" if said else "PASS"), r
    number = {r.lead: r.number for r in df.select("lead", q.py_float("lead").alias("number")).collect()}
    for v in filter(None, ODD):
        got = q._read_number(v.strip())
        assert repr(got) == repr(number[v]), v


@pytest.mark.parametrize("name", ["rule_evaluate", "fail_records", "failure_message", "link_master"])
def test_messages_are_formed_by_batches(tables, name):
    plan = plan_of(catalog.QUERIES[name][0](tables))
    assert "ArrowEvalPython" in plan and "max allowed" not in plan


@pytest.mark.parametrize("name", ["status_summary", "city_fail_rate", "shop_fail_rate"])
def test_outcomes_form_no_messages(tables, name):
    plan = plan_of(catalog.QUERIES[name][0](tables))
    assert "greatest" not in plan and "reason(" not in plan  # the first failing rule settles it


def test_tally_takes_batches(spark):
    name = tf.register_rule_tally(spark, "tally_by_batch")
    spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "rule string, number double").createOrReplaceTempView("tb")
    out = spark.sql(f"SELECT rule, sum(n) n, sum(n_without_number) b, max(worst) w FROM {name}(TABLE(tb)) GROUP BY rule")
    assert {tuple(r) for r in out.collect()} == {("a", 2, 1, 1.0), (None, 1, 0, 2.0)}
    assert "BatchEvalPythonUDTF" not in plan_of(out)


def test_levels_are_folded_by_bounded_tasks(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"), F.col("id").alias("v"),
                                  F.col("id").cast("double").alias("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    keys = ["a", "b"]
    whole = bg.level_totals(df, keys, bg.cube_levels(keys), {"x": "x"}, {"v": "v"})
    want = {tuple(r) for r in whole.collect()}
    seen = []
    dealt = bg._dealt
    monkeypatch.setattr(bg, "TASK_ROWS", 500)
    monkeypatch.setattr(bg, "_dealt", lambda *x: seen.append(dealt(*x)) or seen[-1])
    out = bg.level_totals(df, keys, bg.cube_levels(keys), {"x": "x"}, {"v": "v"})
    assert {tuple(r) for r in out.collect()} == want and len(want) == 32
    assert [(d.rdd.getNumPartitions(), n) for d, n in seen] == [(20, 20), (41, 41)]  # 5000 x 2, 5021 x 4 rows
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_box_stats_read_the_rows_once(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") % 100 + F.when(F.col("id") == 5, 900).otherwise(0)).alias("x"))
    for groups in (["g"], []):
        out = st.box_stats(df, "x", groups)
        assert "Range (" not in plan_of(out)
        r = out.first()
        assert (r.n, r.lower_whisker, r.upper_whisker, r.n_outliers) == (1000, 0.0, 99.0, 1)
