"""Rules as rows, and the registered table function with its own state."""

import re

from pyspark.sql import functions as F

from tally.operators import quality as q
from tally.operators import table_functions as tf

ROWS = [(1, "9", " positive ", "4", "x"), (2, "1", "Negative", "abc", "x"), (3, None, None, None, None),
        (4, "BLQ", "", "nan", "x"), (5, "inf", "POSITIVE", "-1e3", "x"), (5, "inf", "POSITIVE", "-1e3", "x")]


def _df(spark):
    return spark.createDataFrame(ROWS, "id int, lead string, argemone string, acid_value string, message string")


def test_rows_state_what_the_wide_form_states(spark):
    df = _df(spark)
    order = {r.param: i for i, r in enumerate(q.DEFAULT_RULES)}
    got = {}
    for r in tf.rule_rows(df, ["id"]).dropDuplicates(["id", "rule"]).collect():
        got.setdefault(r.id, []).append((order[r.rule], r.outcome, r.message))
    want = {r.id: (r.Pass_Fail, r.Failure_Reason) for r in q.rule_evaluate(df).collect()}
    assert 3 not in got and want[3] == ("PASS", "")
    for i, rows in got.items():
        said = [m for _, _, m in sorted(rows) if m is not None]
        assert (("FAIL" if said else "PASS"), " | ".join(said)) == want[i]
        assert all((o == "FAIL") == (m is not None) for _, o, m in rows)


def test_no_rules_and_empty_tables(spark):
    df = _df(spark)
    full = tf.rule_rows(df, ["id"])
    none = tf.rule_rows(df, ["id"], rules=[q.Rule("absent", 1)])
    assert none.count() == 0 and none.dtypes == full.dtypes
    assert tf.rule_rows(df.where("false"), ["id"]).count() == 0
    assert tf.rule_rows(df, []).count() == full.count()


def test_rows_need_no_shuffle_and_no_python(spark):
    plan = tf.rule_rows(_df(spark), ["id"]).where("rule = 'lead' and outcome = 'FAIL'")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate inline" in plan


def test_tally_from_sql_in_any_partitioning(spark):
    name = tf.register_rule_tally(spark, "tally_under_test")
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("rule"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("number"))
    want = {r.rule: (r.n, r.b, r.w) for r in rows.groupBy("rule").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("number").isNull(), 1)).alias("b"),
        F.max("number").alias("w")).collect()}
    for parts in (1, 9):
        rows.repartition(parts).createOrReplaceTempView("tally_rows")
        part = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT rule, number FROM tally_rows))")
        assert part.where("rule = 'hot'").count() == parts  # one row a task: the state is the task's own
        got = part.groupBy("rule").agg(F.sum("n"), F.sum("n_without_number"), F.max("worst")).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want
        plan = part._jdf.queryExecution().executedPlan().toString()
        if parts > 1:  # (one partition is the input's own here)
            assert "SinglePartition" not in plan and len(re.findall(r"Exchange ", plan)) == 1
    spark.range(0).selectExpr("'a' AS rule", "1d AS number").createOrReplaceTempView("tally_none")
    assert spark.sql(f"SELECT * FROM {name}(TABLE(tally_none))").count() == 0
