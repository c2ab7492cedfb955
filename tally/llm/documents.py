"""Documents as the near-duplicate operators read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents without an id have numbers from here, by their text's hash, so
#: that many of them do not meet under one key.
NO_ID = 1 << 62


def number(id_col: str, text_col: str) -> Column:
    """The id, or a number of its own for a document without one."""
    digest = F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(NO_ID - 1))
    return F.coalesce(F.col(id_col).cast("long"), digest + F.lit(NO_ID))


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``_id`` (never null) and ``_text``."""
    return df.select(number(id_col, text_col).alias("_id"), F.col(text_col).alias("_text"))


def given(number: Column) -> Column:
    """The id that was given, or null."""
    return F.when(number < F.lit(NO_ID), number)
