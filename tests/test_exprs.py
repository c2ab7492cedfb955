"""Expression helpers against the semantic traps of SURVEY §1.4."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tally.functions import exprs as X


def one(spark, expr, schema="x double", value=None):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr.alias("r")).first()["r"]


def test_null_comparison_is_false(spark):  # N1
    assert one(spark, X.null_false(F.col("x") > 1)) is False
    assert one(spark, X.threshold_flag("x", ">", 20)) is False
    assert one(spark, X.threshold_flag("x", "<", 60), value=59.0) is True


def test_half_even_vs_half_up(spark):  # N8
    assert one(spark, X.pandas_round("x", 2), value=0.125) == 0.12
    assert one(spark, X.pandas_round("x", 0), value=2.5) == 2.0
    assert one(spark, X.sql_round("x", 2), value=0.125) == 0.13
    assert one(spark, X.sql_round("x", 0), value=2.5) == 3.0


def test_division_never_raises(spark):  # N6
    assert one(spark, X.try_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, X.safe_ratio(F.lit(5.0), F.lit(0.0))) is None
    assert one(spark, X.safe_ratio(F.lit(5.0), F.lit(-1.0))) is None
    assert one(spark, X.safe_ratio(F.lit(5.0), F.lit(2.0))) == 2.5
    assert one(spark, X.pct(F.lit(1), F.lit(0))) is None


def test_clip_keeps_null(spark):  # N5
    assert one(spark, X.clip("x", upper=360.0)) is None
    assert one(spark, X.clip("x", upper=360.0), value=400.0) == 360.0
    assert one(spark, X.clip("x", 1.0, 2.0), value=0.5) == 1.0
    assert one(spark, X.clip("x", 1.0, 2.0), value=1.5) == 1.5


def test_case_bucket_boundaries(spark):
    b = [(7, "C"), (9, "M")]
    got = [one(spark, X.case_bucket("x", b, "N", "N/A"), value=v) for v in [None, 6.9, 7.0, 7.01, 9.0, 9.5]]
    assert got == ["N/A", "C", "C", "M", "M", "N"]


def test_title_like_python(spark):  # N11
    for s in ["ghee blend", "multi-source edible oil", "3rd party", "it's", "ALL CAPS", "  a  b "]:
        assert one(spark, X.py_title("x"), "x string", s) == s.title()


def test_python_float_parse(spark):  # N12
    cases = {"1_000": 1000.0, "1d": None, " 5 ": 5.0, "abc": None, "<5": None, "5.0001": 5.0001,
             "1e3": 1000.0, ".5": 0.5, "1.": 1.0, "-2": -2.0, "": None, "1__0": None, "inf": math.inf}
    for s, want in cases.items():
        try:
            py = float(s)
        except ValueError:
            py = None
        assert py == want
        assert one(spark, X.py_float("x"), "x string", s) == want, s


def test_day_first_dates(spark):  # N13
    assert one(spark, X.day_first_date("x"), "x string", "04/03/2024") == dt.date(2024, 3, 4)
    assert one(spark, X.day_first_date("x"), "x string", "4/3/2024") == dt.date(2024, 3, 4)
    assert one(spark, X.day_first_date("x"), "x string", "not printed") is None
    assert one(spark, X.month_key(F.lit(dt.date(2024, 3, 4)))) == "2024-03"


def test_contains_any_is_literal(spark):
    assert one(spark, X.contains_any("x", ["<", "nd"]), "x string", "<0.05") is True
    assert one(spark, X.contains_any("x", [".*"]), "x string", "abc") is False


def test_quantile_position(spark):
    lo, hi, f = X.quantile_position(F.lit(4), 0.25)
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), f.alias("f")).first()
    assert (r.lo, r.hi, r.f) == (0, 1, 0.75)
