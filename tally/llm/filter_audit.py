"""How filters interact: what every order of applying them removes.

Each row is read once and becomes a *mask*, one bit per filter that it fails.
A recursive common table expression enumerates the orders: it extends every
prefix by each unused letter, joins the possible mask cells and carries the
bits applied so far; the rows of one level are the metrics of that step, per
mask cell, for one row in the cell.  There are as many prefixes as partial
permutations and as many cells as masks (325 and 32 for five filters), so the
enumeration never depends on the data.  The rows are counted per (part, mask)
with partial aggregates; joining these counts on the mask gives the metrics
of every prefix, and every full order takes those of its prefixes.

A row fails the duplicate filter if a row with a smaller id has the same
text, wherever it lies.  Texts meet as SHA-256 digests: the rows of one text
are first combined per (text, part, verdicts), so that a text that a third of
all rows share is a few rows per part when the smallest id is looked up.

Defined results: a null text is an empty one; a null part is the empty string;
rows without an id come after all others in the order of ids, and none of
them before another; rows that repeat an id are rows each (they are no
duplicates of one another) and share the id's marks; a mark counts if any row
of the marks has it; an empty table has no parts and so no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .documents import number

#: White space between words, and a run of it.
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Masks are joined as a broadcast table: this many filters bound it.
MOST_FILTERS = 6


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that look at one text: few words, few different
    words, many capitals, symbols."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals * 100 > F.char_length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


#: Letter of the filter that a smaller id's equal text makes fail.
DUPLICATE = "E"


def facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One small row per input row: ``_id``, ``_digest``, ``part`` and
    ``_mask`` (the filters of the text alone).  One pass, no shuffle."""
    rows = docs.select(number(id_col, text_col).alias("_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("*", word_list(F.col("_text")).alias("_words"))
    mask = F.lit(0)
    for i, failed in enumerate(text_filters(F.col("_text"), F.col("_words")).values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return rows.select("_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"),
                       mask.cast("int").alias("_mask"))


def cells(found: DataFrame, marks: DataFrame, duplicate_bit: int, names: Sequence[str]) -> DataFrame:
    """Counts per (``part``, ``mask``): ``n`` and one count per mark.
    ``marks`` has one row per ``_id`` with a boolean per mark."""
    marked = found.join(marks, "_id", "left").select(
        *found.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in names])
    # Both groupings keep the copies of a text small before they meet: rows of
    # one id (the join's partitioning serves), then rows of one text and part.
    alike = ["_digest", "part", "_mask", *names]
    ids = marked.groupBy("_id", *alike).agg(F.count("*").alias("_n"))
    groups = ids.groupBy(*alike).agg(F.sum("_n").alias("_n"), F.min(F.struct("_id", "_n")).alias("_first"))
    least = F.min("_first._id").over(Window.partitionBy("_digest"))
    judged = groups.withColumn("_stay", F.when(F.col("_first._id") == least, F.col("_first._n")).otherwise(0))
    both = F.array(F.struct(F.col("_mask").alias("mask"), F.col("_stay").alias("n")),
                   F.struct((F.col("_mask") + duplicate_bit).alias("mask"), (F.col("_n") - F.col("_stay")).alias("n")))
    return (judged.select("part", *names, F.explode(both).alias("_cell"))
            .select("part", *names, "_cell.mask", "_cell.n").where("n > 0")
            .groupBy("part", "mask").agg(F.sum("n").alias("n"), *[
                F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in names]))


def prefixes(spark, letters: str) -> DataFrame:
    """Metrics of every prefix of every order, per mask, for one row of that
    mask: ``filter_prefix``, ``step``, ``bit`` and ``mask`` with the flags
    ``kept``, ``removed``, ``redundant`` and ``alone``."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters")
    values = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    # A level's rows are prefixes of that length times masks.
    return spark.sql(f"""
WITH RECURSIVE
letter(name, bit) AS (VALUES {values}),
cell AS (SELECT CAST(id AS INT) AS mask FROM range(0, {1 << len(letters)}, 1, 1)),
walk(filter_prefix, step, bit, before, applied, mask) AS (
  SELECT CAST('' AS STRING), 0, 0, 0, 0, mask FROM cell
  UNION ALL
  SELECT concat(w.filter_prefix, l.name), w.step + 1, l.bit, w.applied, w.applied | l.bit, w.mask
  FROM walk w JOIN letter l ON (w.applied & l.bit) = 0
  WHERE w.step < {len(letters)})
SELECT filter_prefix, step, bit, mask,
       (mask & applied) = 0 AS kept,
       (mask & bit) <> 0 AND (mask & before) = 0 AS removed,
       (mask & bit) <> 0 AND (mask & before) <> 0 AS redundant,
       mask = bit AS alone
FROM walk WHERE step > 0""")


def audit(counts: DataFrame, letters: str, marks: Mapping[str, str]) -> DataFrame:
    """One row per part, order and step.  ``counts`` comes from :func:`cells`;
    ``marks`` maps its mark columns to the names of the counts of marked rows
    that a step removes."""
    steps = cut_lineage(prefixes(counts.sparkSession, letters))  # read twice; bounded by MOST_FILTERS
    # Every part has every prefix, if only with zeros: a mask that no row of
    # the part has adds nothing, but some row joins every prefix.
    count = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(0)).cast("long")
    per_prefix = counts.join(F.broadcast(steps), "mask").groupBy("part", "filter_prefix", "step").agg(
        count("kept").alias("kept"), count("removed").alias("removed"), count("redundant").alias("redundant"),
        count("alone").alias("unique_fails"),
        *[count("removed", c).alias(name) for c, name in marks.items()])
    # The orders that begin with a prefix: the full ones, cut at each step.
    full = steps.where((F.col("step") == len(letters)) & (F.col("mask") == 0)).select(
        F.col("filter_prefix").alias("filter_order"))
    cuts = full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("_at")).select(
        "filter_order", F.expr("left(filter_order, _at)").alias("filter_prefix"))
    every = per_prefix.join(F.broadcast(cuts), "filter_prefix")
    # A prefix of k letters stands at the head of (all - k)! orders, so every
    # (part, filter) group below has factorial(all) rows, however large the data.
    own = Window.partitionBy("part", F.expr("right(filter_prefix, 1)"))
    return every.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                        *marks.values(), F.sum("removed").over(own).cast("long").alias("shapley"))




def audit_documents(docs: DataFrame, id_col: str, text_col: str, part_col: str, marks: DataFrame,
                    names: Mapping[str, str]) -> DataFrame:
    """The audit of the five filters over documents.  ``marks`` holds the id
    and boolean columns, the keys of ``names``, whose values name the counts
    of marked rows lost."""
    held = (marks.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
            .agg(*[F.max(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in names]))
    letters = "ABCD" + DUPLICATE
    counts = cells(facts(docs, id_col, text_col, part_col), held, 1 << letters.index(DUPLICATE), list(names))
    return audit(counts, letters, names)
