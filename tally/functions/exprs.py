"""Column-expression helpers.

Everything here returns a ``Column`` built from JVM-side functions, so it
stays inside whole-stage codegen.  The helpers encode the semantic traps
listed in SURVEY §1.4: pandas comparisons with null are False, pandas
rounding is half-even, ANSI division raises, ``least`` skips nulls,
``initcap`` is not Python's ``str.title``, and ``cast`` accepts strings
Python's ``float`` rejects.
"""

from __future__ import annotations

import sys
from functools import lru_cache
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- rounding
def pandas_round(c, digits: int = 0) -> Column:
    """Half-even rounding, as pandas/numpy ``round``."""
    return F.bround(col(c), digits)


def sql_round(c, digits: int = 0) -> Column:
    """Half-up rounding, as SQL ``ROUND``."""
    return F.round(col(c), digits)


# ------------------------------------------------------- null and division
def null_false(cond: Column) -> Column:
    """Comparison flag where a null operand gives False (pandas), not NULL."""
    return F.coalesce(cond, F.lit(False))


def try_div(num, den) -> Column:
    """Division that yields NULL instead of raising under ANSI."""
    return F.try_divide(col(num), col(den))


def safe_ratio(num, den) -> Column:
    """``num / den`` only where ``den > 0``; NULL otherwise."""
    return F.when(col(den) > 0, F.try_divide(col(num), col(den)))


def pct(num, den) -> Column:
    """``100 * num / den`` as DOUBLE, NULL on a zero denominator."""
    return F.try_divide(F.lit(100.0) * col(num).cast("double"), col(den).cast("double"))


def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT; a NULL
    condition counts as not met."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def mean_of_flag(cond: Column) -> Column:
    """pandas ``(cond).mean()`` where a NULL comparison is False."""
    return F.avg(F.when(null_false(cond), F.lit(1.0)).otherwise(F.lit(0.0)))


def clip(c, lower=None, upper=None) -> Column:
    """pandas ``clip``: bounds applied only to non-null values.  Written as
    ``when`` guards because ``least``/``greatest`` skip nulls."""
    x = col(c)
    out = x
    if upper is not None:
        out = F.when(x > col_or_lit(upper), col_or_lit(upper)).otherwise(out)
    if lower is not None:
        out = F.when(x < col_or_lit(lower), col_or_lit(lower)).otherwise(out)
    return out


def col_or_lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def case_bucket(c, bounds: Sequence[tuple[float, str]], else_label: str,
                null_label: str | None = None) -> Column:
    """Ordered upper-bound buckets: first ``c <= ub`` wins, else
    ``else_label``; a NULL value gets ``null_label``."""
    x = col(c)
    expr = F.when(x.isNull(), F.lit(null_label))
    for ub, label in bounds:
        expr = expr.when(x <= F.lit(ub), F.lit(label))
    return expr.otherwise(F.lit(else_label))


def threshold_flag(c, op: str, value) -> Column:
    """Boolean rule ``c <op> value`` with NULL → False (formatting rules
    turned into data)."""
    x = col(c)
    v = col_or_lit(value)
    cmp = {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v, "=": x == v, "!=": x != v}[op]
    return null_false(cmp)


def month_key(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def day_first_date(c, formats: Sequence[str] = ("dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy",
                                                   "yyyy-MM-dd")) -> Column:
    """Day-first date parse with coercion to NULL.  A fixed ordered list of
    formats, so the result does not depend on which value is read first."""
    x = col(c)
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats])


# ------------------------------------------------------------- strings


# Every character Python's str.isspace() accepts (derived, not listed),
# and the same set as a Java regex class: Python's `\s` on str patterns.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_WS = "[" + "".join(f"\\x{{{ord(ch):04x}}}" for ch in PY_WHITESPACE) + "]+"


def py_strip(c) -> Column:
    """Python ``str.strip()``: strip Python whitespace at both ends, as a
    character-set trim (no regex)."""
    return F.trim(col(c), F.lit(PY_WHITESPACE))


def collapse_ws(c) -> Column:
    return F.regexp_replace(col(c), _WS, " ")


def remove_ws(c) -> Column:
    return F.regexp_replace(col(c), _WS, "")


@lru_cache(maxsize=1)
def _title_special() -> dict[str, str]:
    """Characters whose Unicode titlecase differs from their uppercase
    ('ß' -> 'Ss', 'ǆ' -> 'ǅ'), derived from Python's own tables on first
    use."""
    return {ch: ch.title() for ch in map(chr, range(sys.maxunicode + 1)) if ch.title() != ch.upper()}


def py_title(c) -> Column:
    """Python ``str.title()``: title-case a letter that follows a non-cased
    character, lower-case every other letter (``Multi-Source``, ``3Rd``),
    unlike ``initcap`` which only looks at whitespace."""
    chars = F.split(col(c), "")
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    special = F.create_map(*[F.lit(x) for kv in _title_special().items() for x in kv])
    return F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                (i == 0) | ~F.get(chars, i - 1).rlike(cased),  # previous character
                F.coalesce(F.try_element_at(special, ch), F.upper(ch)),
            ).otherwise(F.lower(ch)),
        ),
        "",
    )


def contains_any(c, tokens: Iterable[str]) -> Column:
    """Substring membership of any token (no regex, so tokens are literal)."""
    x = col(c)
    expr = None
    for t in tokens:
        term = F.instr(x, F.lit(t)) > 0
        expr = term if expr is None else (expr | term)
    return expr if expr is not None else F.lit(False)


# A string Python's float() accepts: optional sign, digits with single
# underscores between them, optional fraction and exponent, or inf/nan words.
_DIGITS = r"\d(?:_?\d)*"
PY_FLOAT_PATTERN = (
    r"(?i)^[+-]?(?:(?:" + _DIGITS + r"(?:\." + r"(?:" + _DIGITS + r")?)?|\." + _DIGITS + r")"
    r"(?:e[+-]?" + _DIGITS + r")?|inf|infinity|nan)$"
)


def is_digits(x: Column) -> Column:
    """Whether a text holds nothing but ASCII digits and points."""
    return F.translate(x, "0123456789.", "") == ""


def py_float(c) -> Column:
    """Python ``float(str)``: NULL where Python would raise.  ``try_cast``
    alone would accept ``'1d'`` and reject ``'1_000'``.  A text of digits and
    points alone needs neither stripping nor the pattern: the cast decides."""
    x = col(c).cast("string")
    s = py_strip(x)
    return F.when(is_digits(x), x.try_cast("double")).when(
        s.rlike(PY_FLOAT_PATTERN), F.regexp_replace(s, "_", "").try_cast("double"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` written once (an expression that names
    it several times would otherwise grow with every step)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def py_fixed4(x: Column) -> Column:
    """Python ``f"{x:.4f}"`` of a double: the exact binary value rounded
    half-even to four decimals (Java formats the shortest decimal half-up).

    The fraction times 10^4 is taken as a product and its exact error
    (splitting the fraction in two halves), so the comparison with one half
    is exact.  Whole parts of 2^53 and more are exact integers, spelt through
    a decimal product up to 2^115; larger ones keep Java's digits."""
    def rounded(part, product, high, whole):
        digits = F.floor(product).cast("double")
        over = ((product - digits) - 0.5) + ((high * 10000.0 - product) + (part - high) * 10000.0)
        up = lambda o: F.when((o > 0) | ((o == 0) & (F.pmod(digits, F.lit(2.0)) == 1)), 1.0).otherwise(0.0)
        return _let(_let(over, lambda o: (digits + up(o)).cast("bigint")), lambda n: F.concat(
            (whole + F.when(n >= 10000, 1).otherwise(0)).cast("string"), F.lit("."),
            F.lpad(F.pmod(n, F.lit(10000)).cast("string"), 4, "0")))

    def small(size):
        whole = F.floor(size)
        high = lambda part: _let(part * 134217729.0, lambda s: s - (s - part))
        return _let(size - whole.cast("double"), lambda part: _let(part * 10000.0, lambda product: _let(
            high(part), lambda h: rounded(part, product, h, whole))))

    def large(size):
        # 62 binary places at most: the mantissa stays below 2^53
        power = F.least(F.greatest(F.floor(F.log2(size)).cast("int") - 52, F.lit(0)), F.lit(62))
        factor = F.call_function("shiftleft", F.lit(1).cast("bigint"), power)
        return _let(factor, lambda f: F.concat(F.try_multiply(
            (size / f.cast("double")).try_cast("bigint").cast("decimal(19,0)"), f.cast("decimal(19,0)")).cast("string"),
            F.lit(".0000")))

    text = _let(F.abs(x), lambda size: F.when(size < 2.0 ** 53, small(size)).when(size < 2.0 ** 115, large(size))
                .otherwise(F.format_string("%.4f", size)))
    return (F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), F.lit("nan"))
            .when(F.abs(x) == F.lit(float("inf")), F.when(x > 0, "inf").otherwise("-inf"))
            .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text)))


def quantile_position(n: Column, q: float) -> tuple[Column, Column, Column]:
    """Linear-interpolation position of quantile q among n sorted values
    (0-based): (floor index, ceil index, fraction)."""
    h = (n - F.lit(1)).cast("double") * F.lit(float(q))
    lo = F.floor(h)
    hi = F.ceil(h)
    return lo, hi, h - lo
