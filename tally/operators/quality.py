"""Data-quality operators for survey / laboratory sample forms.

Label standardisation runs on DISTINCT raw values and is joined back, so
its cost is the vocabulary of dirty labels, not the row count; AQE picks
a broadcast or a (skew-split) sort-merge join for that mapping at runtime
from its measured size.  Rules, vocabularies and families are small
configuration and become literal expressions (no shuffle): rule
evaluation is a single projection.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (PY_FLOAT_PATTERN, col, collapse_ws, contains_any, day_first_date, is_digits, null_false,
                               pandas_round, py_float, py_strip, py_title, remove_ws)
from ..functions.similarity import gestalt_cascade, levenshtein_match

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Canonical label vocabulary, in its original order.
CANONICAL_LABELS = [
    "Mustard Oil",
    "Sunflower Seed Oil",
    "Groundnut Oil",
    "Soybean Oil",
    "Rice Bran Oil",
    "Olive Oil",
    "Coconut Oil",
    "Multi-Source Edible Oil",
    "Palm Oil",
    "Cotton Seed Oil",
    "Sesame Oil",
    "Refined Vegetable Oil",
]
# Override map: lower-case, no-space raw value -> canonical label.
LABEL_OVERRIDES = {
    "refinedvegetbleoil": "Refined Vegetable Oil",
    "refinedvegtoil": "Refined Vegetable Oil",
    "refinedvegetoil": "Refined Vegetable Oil",
    "palmmoil": "Palm Oil",
    "groundnutsoil": "Groundnut Oil",
    "groundnutsoils": "Groundnut Oil",
}
# Label families: family -> member labels.
LABEL_FAMILIES = {
    "sunflower": ["Sunflower Seed Oil", "Sunflower Oil"],
    "soy": ["Soybean Oil"],
    "mustard": ["Mustard Oil"],
    "groundnut": ["Groundnut Oil"],
    "rice": ["Rice Bran Oil"],
    "palm": ["Palm Oil"],
    "coconut": ["Coconut Oil"],
    "sesame": ["Sesame Oil"],
    "cotton": ["Cotton Seed Oil"],
    "olive": ["Olive Oil"],
    "blended": ["Refined Vegetable Oil", "Multi-Source Edible Oil"],
}
# Tokens meaning "below detection", tested as substrings of the lowered value.
PASS_TOKENS = ["blq", "nd", "loq", "<loq", "not detected", "<"]
# Match threshold for fuzzy label matching.
MATCH_CUTOFF = 0.80
# Between the messages of one record.
SEPARATOR = " | "
_PY_FLOAT = re.compile(PY_FLOAT_PATTERN, re.ASCII)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One test parameter: numeric (``max``) or qualitative (fail values)."""

    param: str
    max: float | None = None
    max_text: str | None = None
    fail_values: tuple[str, ...] = ()

    @property
    def qualitative(self) -> bool:
        return bool(self.fail_values)


# Parameter limits in evaluation order (numeric max first,
# qualitative Positive-fails last), keyed by the build's column names.
DEFAULT_RULES = [
    Rule("lead", 5, "5"), Rule("copper", 5, "5"), Rule("arsenic", 5, "5"), Rule("tin", 5, "5"),
    Rule("cadmium", 5, "5"), Rule("mercury", 5, "5"),
    Rule("aflatoxin_b1", 1, "1"), Rule("total_aflatoxins", 5, "5"),
    Rule("saponification_value", 180, "180"), Rule("iodine_value", 120, "120"),
    Rule("unsaponifiable_matter", 130, "130"), Rule("acid_value", 3, "3"),
    Rule("polybromide_test", fail_values=("positive",)),
    Rule("argemone", fail_values=("positive",)),
    Rule("mineral_oil", fail_values=("positive",)),
]


# ------------------------------------------------------------- cleaning
def clean_label(c) -> tuple[Column, Column, Column]:
    """(cleaned, lower, nospace): whitespace runs collapsed and trimmed,
    lower-cased, and all whitespace removed."""
    cleaned = py_strip(collapse_ws(col(c).cast("string")))
    lower = F.lower(cleaned)
    return cleaned, lower, remove_ws(lower)


def _map_literal(d: Mapping[str, str]) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def label_mapping_frame(distinct_raw: DataFrame, raw: str, vocabulary: Sequence[str] = CANONICAL_LABELS,
                        overrides: Mapping[str, str] = LABEL_OVERRIDES, cutoff: float = MATCH_CUTOFF,
                        method: str = "gestalt", out: str = "std") -> DataFrame:
    """raw -> standard label for a frame of distinct non-null raw values.
    Cascade: override map on the no-space key, best match on the no-space
    key, best match on the spaced lower key, else Python-style title case."""
    vocab = list(vocabulary)
    v_lower = [c.lower() for c in vocab]
    v_nospace = ["".join(c.lower().split()) for c in vocab]
    if method not in ("gestalt", "levenshtein"):
        raise ValueError(f"unknown method {method!r}")
    cleaned, lower, nospace = clean_label(raw)
    names = F.array(*[F.lit(c) for c in vocab])
    staged = distinct_raw.select(F.col(raw), cleaned.alias("_cleaned"), lower.alias("_lower"),
                                 nospace.alias("_nospace"))
    staged = staged.withColumn("_ov", F.try_element_at(_map_literal(overrides), F.col("_nospace")))
    if method == "gestalt":
        # An equal key scores 1, above every other: settled natively.  One
        # Python pass scores the distinct labels that are still open.
        exact = F.array_position(F.array(*[F.lit(v) for v in v_nospace]), F.col("_nospace"))
        equal = F.when(exact > 0, exact - 1).cast("int")
        scored = gestalt_cascade(F.col("_ov").isNotNull() | equal.isNotNull(), F.col("_nospace"), F.col("_lower"),
                                 v_nospace, v_lower, cutoff)
        idx = F.coalesce(equal, scored)
    else:
        idx = F.when(F.col("_ov").isNull(), F.coalesce(
            levenshtein_match(F.col("_nospace"), v_nospace, cutoff),
            levenshtein_match(F.col("_lower"), v_lower, cutoff)))
    staged = staged.withColumn("_m", idx)
    std = F.coalesce(F.col("_ov"), F.try_element_at(names, F.col("_m") + 1), py_title(F.col("_cleaned")))
    return staged.select(F.col(raw), std.alias(out))


def standardize_labels(df: DataFrame, c: str, out: str, vocabulary: Sequence[str] = CANONICAL_LABELS,
                       overrides: Mapping[str, str] = LABEL_OVERRIDES, cutoff: float = MATCH_CUTOFF,
                       method: str = "gestalt") -> DataFrame:
    """Add ``out`` = standard label of ``c`` (NULL stays NULL).  Distinct
    values are scored once, then joined back on the raw value."""
    distinct_raw = df.select(F.col(c)).where(F.col(c).isNotNull()).distinct()
    mapping = label_mapping_frame(distinct_raw, c, vocabulary, overrides, cutoff, method, out)
    return df.join(mapping, on=c, how="left")


def label_mapping(df: DataFrame, raw: str, std: str) -> DataFrame:
    """Distinct (raw, standard) pairs with ``Changed`` (NULL vs NULL counts
    as changed), changed first."""
    pairs = df.select(raw, std).distinct()
    return pairs.withColumn("Changed", F.coalesce(F.col(raw) != F.col(std), F.lit(True))).orderBy(
        F.col("Changed").desc(), F.col(raw).asc_nulls_first())


def label_change_counts(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count("*").alias("n_distinct"),
                       F.sum(F.col("Changed").cast("int")).cast("bigint").alias("n_changed"))


# ------------------------------------------------------------- rules
def nondetect_token(c, tokens: Sequence[str] = PASS_TOKENS) -> Column:
    """Stripped, lowered value contains any below-detection token."""
    return contains_any(F.lower(py_strip(col(c).cast("string"))), tokens)


def rule_violated(df_columns: Sequence[str], r: Rule, tokens: Sequence[str] = PASS_TOKENS) -> Column | None:
    """Whether one rule fails for one row, never null; None when the column
    is absent (rule skipped).  A NULL value or a below-detection token
    passes, a value that is no number fails, NaN does not exceed a limit."""
    if r.param not in df_columns:
        return None
    raw = F.col(r.param).cast("string")
    if r.qualitative:
        return F.coalesce(F.lower(py_strip(raw)).isin(list(r.fail_values)), F.lit(False))
    limit = F.lit(float(r.max))
    # A text of digits and points alone holds no token and needs no pattern.
    # Of the others, those with a token are settled before the pattern is tried.
    plain = F.coalesce(raw.try_cast("double") > limit, F.lit(True))
    other = ~nondetect_token(raw, tokens) & F.coalesce(
        F.nanvl(py_float(raw), F.lit(float("-inf"))) > limit, F.lit(True))
    return raw.isNotNull() & F.when(is_digits(raw), plain).otherwise(other)


def _read_number(text: str) -> float | None:
    """The stripped text as :func:`py_float` reads it."""
    if not _PY_FLOAT.fullmatch(text) or (text[1:].lower() == "nan" and text[1:] != "NaN"):
        return None
    return float(text)


def failure_message(r: Rule, value: str, tokens: Sequence[str] = PASS_TOKENS) -> str | None:
    """Failure message of one rule for one text, None when it passes (the
    verdict of :func:`rule_violated`)."""
    text = value.strip()
    if r.qualitative:
        return f"{r.param} = {text} (expected Negative)" if text.lower() in r.fail_values else None
    number = _read_number(text)
    if number is not None and not number > r.max:
        return None
    lowered = text.lower()
    if any(t in lowered for t in tokens):
        return None
    if number is None:
        return f"{r.param} = '{text}' (unreadable value)"
    return f"{r.param} = {number:.4f} (max allowed: {r.max_text or str(r.max)})"


def failure_reason(rules: Sequence[Rule], tokens: Sequence[str] = PASS_TOKENS) -> Column:
    """Messages of the failed rules in rule order, joined by ' | '.  Formed for
    whole Arrow batches: a text that a batch's column holds several times is
    judged once, and the messages are joined column by column."""
    rules, tokens = list(rules), list(tokens)

    @F.arrow_udf("string")
    def reason(*columns: pa.Array) -> pa.Array:
        said = []
        for r, column in zip(rules, columns, strict=True):
            coded = column.dictionary_encode()
            messages = [failure_message(r, v, tokens) for v in coded.dictionary.to_pylist()]
            parts = pa.array(["" if m is None else SEPARATOR + m for m in messages], pa.string())
            said.append(pc.fill_null(parts.take(coded.indices), ""))
        return pc.utf8_slice_codeunits(pc.binary_join_element_wise(*said, ""), len(SEPARATOR))

    return reason(*[F.col(r.param).cast("string") for r in rules])


def rule_evaluate(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, tokens: Sequence[str] = PASS_TOKENS,
                  status: str = "Pass_Fail", reason: str = "Failure_Reason") -> DataFrame:
    """Add ``Pass_Fail`` (FAIL if any rule fails) and ``Failure_Reason``
    (messages in rule order joined by ' | ').  No shuffle.  The outcome comes
    from the conditions alone, the first that fails settles it: where nobody
    selects the messages they are not formed, and behind a filter on the
    outcome only failing rows form them.

    The outcome is barred from being written into filters (a row number that
    is never negative makes it non-deterministic to the optimiser, though its
    value is fixed): a filter over the columns of fifteen rules gives a
    constraint per way to name them, twice as many with every renamed column,
    until the optimiser's memory ends."""
    used = [r for r in rules if r.param in df.columns]
    failed = reduce(or_, [rule_violated(df.columns, r, tokens) for r in used], F.lit(False))
    barred = failed & (F.monotonically_increasing_id() >= 0)
    judged = df.withColumn(status, F.when(barred, F.lit("FAIL")).otherwise(F.lit("PASS")))
    return judged.select(*df.columns, status, (failure_reason(used, tokens) if used else F.lit("")).alias(reason))


def status_summary(df: DataFrame, c: str = "Pass_Fail", label: str = "Result") -> DataFrame:
    """Count per outcome and its share of all rows (round 2, half-even)."""
    counts = df.groupBy(F.col(c).alias(label)).agg(F.count("*").alias("Count"))
    total = counts.select(F.sum("Count")).scalar()  # the same aggregation, read once
    return counts.select(label, "Count", pandas_round(F.col("Count") * 100.0 / total, 2).alias("Percentage"))


def fail_records(df: DataFrame, cols: Sequence[str], c: str = "Pass_Fail") -> DataFrame:
    return df.where(F.col(c) == "FAIL").select(*cols)


# ------------------------------------------------------- families / mismatch
def label_family(c, families: Mapping[str, Sequence[str]] = LABEL_FAMILIES) -> Column:
    """Family of a label; an unknown label is its own family
    (lower-cased, stripped)."""
    member_to_family = {}
    for fam, members in families.items():
        for m in members:
            member_to_family.setdefault(m, fam)
    x = col(c)
    return F.coalesce(F.try_element_at(_map_literal(member_to_family), x), F.lower(py_strip(x.cast("string"))))


def mismatch_classify(a, b, families: Mapping[str, Sequence[str]] = LABEL_FAMILIES) -> Column:
    x, y = col(a), col(b)
    return (F.when(x.isNull() | y.isNull(), F.lit("Cannot Determine"))
             .when(x == y, F.lit("Match"))
             .when(label_family(x, families) == label_family(y, families), F.lit("Minor Mismatch"))
             .otherwise(F.lit("Major Mismatch")))


def group_counts(df: DataFrame, keys: Sequence[str], drop_null_keys: bool = True,
                 name: str = "Count") -> DataFrame:
    """Rows per key combination, most frequent first (pandas groupby.size
    drops null keys by default; SQL GROUP BY keeps them)."""
    src = df.dropna(subset=list(keys)) if drop_null_keys else df
    order = [F.col(name).desc()] + [F.col(k).asc_nulls_first() for k in keys]
    return src.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(*order)


# ------------------------------------------------------------- linkage
def key_overlap(left: DataFrame, lk: str, right: DataFrame, rk: str) -> DataFrame:
    """Distinct non-null keys per side and their overlap, in one pass over
    the two distinct key sets (full outer join with side markers)."""
    lkeys = left.select(F.col(lk).alias("_k")).where(F.col("_k").isNotNull()).distinct().withColumn("_l", F.lit(1))
    rkeys = right.select(F.col(rk).alias("_k")).where(F.col("_k").isNotNull()).distinct().withColumn("_r", F.lit(1))
    both = lkeys.join(rkeys, "_k", "full_outer")
    return both.agg(
        F.count("_l").alias("left_keys"), F.count("_r").alias("right_keys"),
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("overlapping"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("only_right"))


def key_intersect(left: DataFrame, lk: str, right: DataFrame, rk: str) -> DataFrame:
    return left.select(F.col(lk).alias("key")).where("key IS NOT NULL").intersect(
        right.select(F.col(rk).alias("key")).where("key IS NOT NULL"))


def key_except(left: DataFrame, lk: str, right: DataFrame, rk: str) -> DataFrame:
    return left.select(F.col(lk).alias("key")).where("key IS NOT NULL").subtract(
        right.select(F.col(rk).alias("key")).where("key IS NOT NULL"))


def link_master(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None,
                suffixes: tuple[str, str] = ("_C1", "_T1"), null_safe: bool = False) -> DataFrame:
    """Inner join of two forms on a code; only colliding non-key columns get
    the suffixes.  Duplicate keys fan out (as a merge does).  SQL null
    semantics by default; ``null_safe`` matches NULL to NULL."""
    rk = right_key or key
    r = right.withColumnRenamed(rk, key) if rk != key else right
    clash = (set(left.columns) & set(r.columns)) - {key}
    lsel = [F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in r.columns]
    lx, rx = left.select(*lsel), r.select(*rsel).withColumnRenamed(key, "_rkey")
    cond = lx[key].eqNullSafe(rx["_rkey"]) if null_safe else lx[key] == rx["_rkey"]
    return lx.join(rx, cond, "inner").drop("_rkey")


def shelf_life(df: DataFrame, mfg: str, exp: str, ref_date: str = "2025-01-01",
               min_days: int = 90) -> DataFrame:
    """Parse day-first dates; life = expiry - manufacture, remaining =
    expiry - reference date; short flag remaining < min_days (NULL -> False)."""
    out = (df.withColumn("Mfg_Date", day_first_date(mfg))
             .withColumn("Expiry_Date", day_first_date(exp)))
    return (out.withColumn("Shelf_Life_Days", F.datediff("Expiry_Date", "Mfg_Date"))
               .withColumn("Remaining_Shelf_Life_Days", F.datediff("Expiry_Date", F.lit(ref_date).cast("date")))
               .withColumn("Short_Shelf_Life_Flag",
                           null_false(F.col("Remaining_Shelf_Life_Days") < F.lit(min_days))))


def group_stats(df: DataFrame, key: str, c: str, digits: int = 1) -> DataFrame:
    """mean/min/max/count (non-null) of ``c`` per key, rounded, mean desc;
    NULL keys dropped (pandas groupby)."""
    x = F.col(c).cast("double")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        pandas_round(F.avg(x), digits).alias("mean"), pandas_round(F.min(x), digits).alias("min"),
        pandas_round(F.max(x), digits).alias("max"), F.count(x).alias("count"))
    return out.orderBy(F.col("mean").desc_nulls_last(), F.col(key))


def outcome_rate_by(df: DataFrame, key: str, outcome: str = "Pass_Fail", value: str = "FAIL",
                    digits: int = 1) -> DataFrame:
    """Within-group share (%) of each outcome, keeping ``value``; groups with
    no such outcome do not appear.  Shares are computed on grouped rows."""
    counts = df.where(F.col(key).isNotNull() & F.col(outcome).isNotNull()).groupBy(key, outcome).agg(
        F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    share = counts.withColumn("Percentage", pandas_round(F.col("_n") * 100.0 / F.sum("_n").over(w), digits))
    return share.where(F.col(outcome) == value).select(key, outcome, "Percentage").orderBy(
        F.col("Percentage").desc(), F.col(key))
