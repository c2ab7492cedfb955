"""Sources and sinks: typed reads, NA tokens, header normalisation, views,
and report writers.

Spreadsheets are converted upstream; tables arrive as parquet or csv
(Spark has no xlsx reader, and a per-file codec would funnel everything
through one task).  Reports are written one directory per named table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Text cells a spreadsheet reader treats as missing by default.
DEFAULT_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                     "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str | None = None,
               **options) -> DataFrame:
    """Load a named table.  An explicit schema avoids an inference pass;
    the format follows the extension unless given."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def null_tokens(df: DataFrame, tokens: Sequence[str] = DEFAULT_NA_TOKENS,
                cols: Sequence[str] | None = None) -> DataFrame:
    """Textual NA tokens become NULL in the given (default: all string)
    columns, as a spreadsheet reader does at load."""
    targets = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    toks = list(tokens)
    return df.select(*[F.when(F.col(f"`{c}`").isin(toks), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                       if c in targets else F.col(f"`{c}`") for c in df.columns])


def normalise_header(name: str) -> str:
    """NBSP -> space, collapse whitespace, trim, non-alphanumerics -> '_'."""
    s = name.replace("\xa0", " ")
    s = re.sub(r"\s+", " ", s).strip()
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_")
    return s or "col"


def normalise_headers(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename every column to an addressable name (explicit mapping first,
    then the normalisation rule); duplicates get a numeric suffix."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = (mapping or {}).get(c) or normalise_header(c)
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if k == 0 else f"{n}_{k}")
    return df.toDF(*out)


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_report(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite") -> dict:
    """Write each named result table to ``root/<name>``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        path = os.path.join(root, normalise_header(name))
        w = df.write.mode(mode)
        if fmt == "csv":
            w = w.option("header", "true")
        w.format(fmt).save(path)
        paths[name] = path
    return paths


def write_if_nonempty(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write only when the table has rows (``isEmpty`` reads one row)."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").format(fmt).save(path)
    return True


def write_enriched(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def table_profile(df: DataFrame) -> DataFrame:
    """Rows and columns of a table (one aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
