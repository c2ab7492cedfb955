"""Rules as tables: one row per (record, rule), and a table function with its
own state that SQL text can call.

:func:`rule_rows` turns a wide form into rows with one generator and states
the verdict once, over columns, instead of once per rule: a filter on the
verdict comes before any message is formed.  :func:`register_rule_tally`
registers ``rule_tally(TABLE(...))``: every task folds its own partition into
one row per rule, so what is shuffled afterwards is rules x tasks rows
however many records fail, and no rule's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from ..functions.exprs import py_fixed4, py_float, py_strip
from .quality import DEFAULT_RULES, PASS_TOKENS, Rule, nondetect_token


def rule_rows(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule] = DEFAULT_RULES,
              tokens: Sequence[str] = PASS_TOKENS) -> DataFrame:
    """Columns: the keys, ``rule``, ``value`` (as given), ``number`` (of
    limits; NULL where it cannot be read), ``outcome`` and ``message`` (NULL
    when the rule passes).

    A record has one row for each rule whose column exists and is not NULL; a
    column called like an output but not among the keys is no key.  No rules
    or none that apply: no rows."""
    used = [r for r in rules if r.param in df.columns]
    one = [F.struct(F.lit(r.param).alias("rule"), F.col(r.param).cast("string").alias("value"),
                    F.lit(None if r.qualitative else float(r.max)).cast("double").alias("_max"),
                    F.lit(r.max_text or str(r.max)).alias("_said"),
                    F.array(*[F.lit(v) for v in r.fail_values]).cast("array<string>").alias("_bad")) for r in used]
    if not one:
        return df.where(F.lit(False)).select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("rule", "string"), ("value", "string"), ("number", "double"), ("outcome", "string"),
            ("message", "string"))])
    rows = df.select(*keys, F.inline(F.array(*one))).where("value IS NOT NULL")
    rows = rows.withColumn("number", F.when(F.col("_max").isNotNull(), py_float("value")))
    text = py_strip("value")
    over = F.coalesce(F.nanvl("number", F.lit(float("-inf"))) > F.col("_max"), F.lit(True))
    failed = F.when(F.col("_max").isNull(), F.array_contains("_bad", F.lower(text))).otherwise(
        over & ~nondetect_token("value", tokens))
    rows = rows.withColumn("outcome", F.when(failed, F.lit("FAIL")).otherwise(F.lit("PASS")))
    said = (F.when(F.col("_max").isNull(), F.format_string("%s = %s (expected Negative)", "rule", text))
            .when(F.col("number").isNull(), F.format_string("%s = '%s' (unreadable value)", "rule", text))
            .otherwise(F.format_string("%s = %s (max allowed: %s)", "rule", py_fixed4(F.col("number")), "_said")))
    return rows.select(*keys, "rule", "value", "number", "outcome",
                       F.when(F.col("outcome") == "FAIL", said).alias("message"))


class _RuleTally:
    """Counts and greatest number per rule of the rows that one task sees,
    folded one Arrow batch at a time."""

    def __init__(self) -> None:
        self.seen: dict[str | None, list] = {}

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = pa.table({"rule": batch.column("rule"), "number": batch.column("number")})
        folded = rows.group_by("rule").aggregate([
            ("number", "count", pc.CountOptions(mode="all")), ("number", "count", pc.CountOptions(mode="only_null")),
            ("number", "max")])
        for rule, n, blank, worst in zip(*(c.to_pylist() for c in folded.columns), strict=True):
            state = self.seen.setdefault(rule, [0, 0, None])
            state[0] += n
            state[1] += blank
            if worst is not None and (state[2] is None or worst > state[2]):
                state[2] = worst
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        rows = [(rule, *state) for rule, state in self.seen.items()]
        yield pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (
            pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
            names=["rule", "n", "n_without_number", "worst"])


def register_rule_tally(spark: SparkSession, name: str = "rule_tally") -> str:
    """Register the table function: its argument is a table with ``rule`` and
    ``number``; it returns partial rows (rule, n, n_without_number, worst)
    that the caller sums up.  NaN is never the worst beside a number; rows
    that :func:`rule_rows` calls failed hold none."""
    spark.udtf.register(name, arrow_udtf(
        _RuleTally, returnType="rule string, n bigint, n_without_number bigint, worst double"))
    return name
