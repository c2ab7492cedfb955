"""Sources and sinks: header normalisation, NA tokens, typed reads, report
writers, empty-table gate, row counts."""

import os
import tempfile

from tally.sources import io


def test_normalise_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["City/District from which the sample was\xa0picked",
                                                "Q10. Lead [Parts Per Million (mg/kg or  mg/l)]",
                                                "Q16. Aflatoxin B1 [ µg/kg ]", "Q16. Aflatoxin B1 [ µg/kg]"])
    out = io.normalise_headers(df, {"Q10. Lead [Parts Per Million (mg/kg or  mg/l)]": "lead"})
    assert out.columns == ["City_District_from_which_the_sample_was_picked", "lead", "Q16_Aflatoxin_B1_g_kg",
                           "Q16_Aflatoxin_B1_g_kg_1"]


def test_null_tokens(spark):
    df = spark.createDataFrame([("N/A", 1), ("x", 2), ("", 3)], "s string, n int")
    assert [r.s for r in io.null_tokens(df).collect()] == [None, "x", None]


def test_read_write_report_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="tally-io-")
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    paths = io.write_report({"Summary Table": df, "Other": df.limit(1)}, root, fmt="csv")
    assert os.path.basename(paths["Summary Table"]) == "Summary_Table"
    back = io.read_table(spark, paths["Summary Table"], schema="k string, v double", fmt="csv")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1.5), ("b", None)]
    assert io.write_if_nonempty(df.where("k = 'zzz'"), os.path.join(root, "empty")) is False
    assert not os.path.exists(os.path.join(root, "empty"))
    assert io.write_if_nonempty(df, os.path.join(root, "full")) is True
    io.write_enriched(df, os.path.join(root, "enriched"), partition_by=["k"])
    assert io.read_table(spark, os.path.join(root, "enriched")).count() == 2


def test_profile_and_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    p = io.table_profile(df).first()
    assert (p.n_rows, p.n_columns) == (2, 2)
    rc = {r.table_name: r.n_rows for r in io.row_counts({"t1": df, "t2": df.limit(1)}).collect()}
    assert rc == {"t1": 2, "t2": 1}
    io.register_view(df, "tally_io_view")
    assert spark.sql("SELECT count(*) AS n FROM tally_io_view").first().n == 2
