"""Property checks (hypothesis): JVM expressions against the Python
semantics they reproduce, on random batches."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tally.functions import exprs as X
from tally.operators import quality as q
from tally.operators import stats as st

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

FRAGMENTS = list("abcXYZ 019._-<'\t\xa0eéß\x1c\u3000\n") + ["nd", "blq", "inf", "nan", "1_0"]
TEXT = hs.lists(hs.sampled_from(FRAGMENTS), max_size=8).map("".join)
NUMERIC_TEXT = hs.one_of(TEXT, hs.floats(allow_nan=False, allow_infinity=False, width=32).map(repr),
                         hs.integers(-10000, 10000).map(str), hs.just("1_000"), hs.just("1d"))


def _py_float(s):
    try:
        return float(s)
    except ValueError:
        return None


def _col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.r for r in df.select("i", expr.alias("r")).orderBy("i").collect()]


@SETTINGS
@given(hs.lists(TEXT, min_size=1, max_size=40))
def test_title_and_strip_match_python(spark, values):
    assert _col(spark, values, X.py_title("x")) == [v.title() for v in values]
    assert _col(spark, values, X.py_strip("x")) == [v.strip() for v in values]


@SETTINGS
@given(hs.lists(NUMERIC_TEXT, min_size=1, max_size=40))
def test_float_parse_matches_python(spark, values):
    got = _col(spark, values, X.py_float("x"))
    want = [_py_float(v) for v in values]
    for g, w, v in zip(got, want, values):
        if w is not None and np.isnan(w):
            assert g is not None and np.isnan(g), v
        else:
            assert g == w, v


def _rule_reference(val, rule):
    """The rule cascade stated in plain Python, for comparison only."""
    if val is None:
        return None
    s = str(val).strip()
    if rule.qualitative:
        return f"{rule.param} = {s} (expected Negative)" if s.lower() in rule.fail_values else None
    if any(t in s.strip().lower() for t in q.PASS_TOKENS):
        return None
    try:
        num = float(val)
    except ValueError:
        return f"{rule.param} = '{s}' (unreadable value)"
    return f"{rule.param} = {num:.4f} (max allowed: {rule.max_text})" if num > rule.max else None


@SETTINGS
@given(hs.lists(hs.tuples(hs.one_of(hs.none(), NUMERIC_TEXT), hs.one_of(hs.none(), NUMERIC_TEXT),
                          hs.one_of(hs.none(), hs.sampled_from(["Positive", " positive", "Negative", "x"]))),
                min_size=1, max_size=30))
def test_rule_engine_matches_reference(spark, rows):
    rules = [r for r in q.DEFAULT_RULES if r.param in ("lead", "acid_value", "argemone")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lead string, acid_value string, argemone string")
    got = {r.i: (r.Pass_Fail, r.Failure_Reason) for r in q.rule_evaluate(df).collect()}
    for i, (lead, acid, arg) in enumerate(rows):
        msgs = [m for m in (_rule_reference(v, r) for v, r in zip((lead, acid, arg), rules)) if m is not None]
        assert got[i] == ("FAIL" if msgs else "PASS", " | ".join(msgs)), rows[i]


@SETTINGS
@given(hs.lists(hs.tuples(hs.sampled_from("abc"), hs.integers(0, 50)), min_size=1, max_size=300))
def test_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    probs = [0.1, 0.25, 0.5, 0.9]
    got = {r.g: r for r in st.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for key in {g for g, _ in rows}:
        x = np.array([v for g, v in rows if g == key], dtype=float)
        for p, w in zip(probs, np.quantile(x, probs)):
            assert got[key][st._qname(p)] == pytest.approx(w, abs=1e-9)


@SETTINGS
@given(hs.lists(TEXT, min_size=1, max_size=40))
def test_clean_label_matches_python(spark, values):
    import re

    cleaned, lower, nospace = q.clean_label("x")
    want = [re.sub(r"\s+", " ", v).strip() for v in values]
    assert _col(spark, values, cleaned) == want
    assert _col(spark, values, nospace) == [re.sub(r"\s+", "", w.lower()) for w in want]


@SETTINGS
@given(hs.lists(hs.one_of(
    hs.floats(allow_nan=True, allow_infinity=True).filter(lambda x: not 2.0 ** 115 <= abs(x) < float("inf")),
    hs.integers(-10**9, 10**9).map(lambda n: n / 32),
    hs.integers(-10**9, 10**9).map(lambda n: n / 100000)), min_size=1, max_size=200))
def test_fixed4_equals_python(spark, values):
    from tally.functions.exprs import py_fixed4

    values = values + [5.03125, 6.00005, 0.00005, 1e30, 2.0 ** 53, 2.0 ** 52 + 0.5, 0.99995, 9.99995]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", "x", py_fixed4(F.col("x")).alias("t"))
    for r in df.collect():
        want = f"{r.x:.4f}"
        assert r.t == want or (r.x == 0 and r.t == "0.0000"), (r.x, r.t, want)
