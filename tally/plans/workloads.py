"""The two workloads as pure functions of their input tables (lineage
replaces the notebooks' cell order):

* sample forms: ``collection_std`` (labels standardised), ``testing_eval``
  (rules + sampler/lab labels + mismatch class), ``master`` (linked);
* applications: ``enriched`` (derived columns), plus the payback frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import quality as q

# Method used by the catalog: the reference's gestalt ratio.
MATCH_METHOD = "gestalt"


def label_map(columns: list[DataFrame], method: str = MATCH_METHOD) -> DataFrame:
    """raw -> standard label for the distinct values of several one-column
    frames (column ``raw``), scored once."""
    vals = columns[0]
    for other in columns[1:]:
        vals = vals.union(other)
    vals = vals.where(F.col("raw").isNotNull()).distinct()
    return q.label_mapping_frame(vals, "raw", method=method, out="std")


def _apply(df: DataFrame, mapping: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Left-join the same mapping frame once per (raw column, output) pair;
    identical broadcast plans, so Spark reuses one exchange."""
    out = df
    outs = []
    for i, (raw, name) in enumerate(pairs):
        m = mapping.alias(f"m{i}")
        out = out.join(m, F.col(raw) == F.col(f"m{i}.raw"), "left")
        outs.append(F.col(f"m{i}.std").alias(name))
    return out.select(*[df[c] for c in df.columns], *outs)


def collection_std(collection: DataFrame, method: str = MATCH_METHOD, mapping: DataFrame | None = None) -> DataFrame:
    if mapping is None:
        return q.standardize_labels(collection, "oil_raw", "Oil_Type_Standardized", method=method)
    return _apply(collection, mapping, [("oil_raw", "Oil_Type_Standardized")])


def testing_eval(testing: DataFrame, method: str = MATCH_METHOD, mapping: DataFrame | None = None) -> DataFrame:
    """Rules, then both label columns standardised through ONE mapping
    built from the union of their distinct values, then the mismatch class."""
    if mapping is None:
        mapping = label_map([testing.select(F.col("oil_sampler").alias("raw")),
                             testing.select(F.col("oil_lab").alias("raw"))], method)
    out = _apply(q.rule_evaluate(testing), mapping,
                 [("oil_sampler", "Sampler_Oil_Std"), ("oil_lab", "Lab_Oil_Std")])
    out = out.withColumn("Mismatch_Type", q.mismatch_classify("Sampler_Oil_Std", "Lab_Oil_Std"))
    first = ["sample_code", "city_picked", "oil_sampler", "oil_lab"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def master(collection: DataFrame, testing: DataFrame, method: str = MATCH_METHOD) -> DataFrame:
    """Both forms standardised through one mapping of all three label
    columns (one scoring stage), then linked on the sample code."""
    mapping = label_map([collection.select(F.col("oil_raw").alias("raw")),
                         testing.select(F.col("oil_sampler").alias("raw")),
                         testing.select(F.col("oil_lab").alias("raw"))], method)
    return q.link_master(collection_std(collection, method, mapping), testing_eval(testing, method, mapping),
                         "sample_code")


def enriched(applications: DataFrame) -> DataFrame:
    return fe.enrich(applications)
