"""The end-to-end suites write every named table, and the written tables
equal the corresponding registered queries."""

import os
import tempfile

from tally.plans import catalog
from tally.plans.suite import write_suite


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_write_suite(spark, tables):
    root = tempfile.mkdtemp(prefix="tally-suite-")
    paths = write_suite(tables, root)
    assert len(paths) >= 55
    for p in paths.values():
        assert os.path.isdir(p)
    read = lambda n: spark.read.parquet(paths[n])
    assert _rows(read("SQL_s1_state_conversion")) == _rows(catalog.QUERIES["s1_state_conversion"][0](tables))
    assert _rows(read("Q3_Summary")) == _rows(catalog.QUERIES["status_summary"][0](tables))
    assert _rows(read("B3_DISCOM_SLA")) == _rows(catalog.QUERIES["sla_compliance"][0](tables))
    assert _rows(read("D4_Payback_By_Category")) == _rows(catalog.QUERIES["payback_by_category"][0](tables))
    assert read("Q5_Master_Dataset").count() == catalog.QUERIES["link_master"][0](tables).count()
