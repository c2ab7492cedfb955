"""End-to-end report suites: every named output table of the two
workloads, written one directory per table.

Shared intermediates (standardised forms, rule results, the linked master
table, the enriched application table) feed many reports, so each is
written once as a table in the reliable checkpoint folder
(``session.cut_lineage``) and every report reads it, instead of redoing
the joins, the label scoring and the quantile passes per report.

    python -m tally.plans.suite --sf-dir /root/testdata/sf0.01 --out /path/to/reports
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggs as A
from ..operators import features as fe
from ..operators import quality as q
from ..operators import ranking as rk
from ..operators import stats as st
from ..session import build_session, cut_lineage
from ..sources.io import write_if_nonempty, write_report
from . import reports as R
from . import workloads as W
from .bindings import Tables


def sample_form_reports(tables: Tables) -> dict[str, DataFrame]:
    """Q1-Q5 of the sample-form workload."""
    col, tst = tables.collection(), tables.testing()
    mapping = cut_lineage(W.label_map([col.select(F.col("oil_raw").alias("raw")),
                                       tst.select(F.col("oil_sampler").alias("raw")),
                                       tst.select(F.col("oil_lab").alias("raw"))]))
    c1 = cut_lineage(W.collection_std(col, mapping=mapping))
    t1 = cut_lineage(W.testing_eval(tst, mapping=mapping))
    master = cut_lineage(q.shelf_life(q.link_master(c1, t1, "sample_code"), "mfg_raw", "expiry_raw"))
    oil_counts = A.value_counts(c1, "Oil_Type_Standardized", name="Sample_Count").withColumnRenamed(
        "Oil_Type_Standardized", "Oil_Type")
    mismatches = t1.where(F.col("Mismatch_Type").isin("Minor Mismatch", "Major Mismatch"))
    status = q.status_summary(t1)
    return {
        "Q1_Before_After_Mapping": q.label_mapping(c1, "oil_raw", "Oil_Type_Standardized"),
        "Q1_Full_C1_With_Standardized": c1.select("sample_code", "oil_raw", "Oil_Type_Standardized"),
        "Q2_Oil_Sample_Counts": oil_counts,
        "Q2_City_Distribution_Top5": A.top_n_then_breakdown(c1, "Oil_Type_Standardized", "city", 5),
        "Q3_T1_With_PassFail": t1.drop("Sampler_Oil_Std", "Lab_Oil_Std", "Mismatch_Type"),
        "Q3_FAIL_Records_Only": q.fail_records(t1, ["sample_code", "oil_sampler", "Pass_Fail", "Failure_Reason"]),
        "Q3_Summary": status,
        "Q4_All_Samples_Classified": t1.select("sample_code", "oil_sampler", "Sampler_Oil_Std", "oil_lab",
                                               "Lab_Oil_Std", "Mismatch_Type"),
        "Q4_Mismatch_Records": mismatches.select("sample_code", "Sampler_Oil_Std", "Lab_Oil_Std", "Mismatch_Type",
                                                 "city_picked"),
        "Q4_By_Oil_Type": q.group_counts(mismatches, ["Sampler_Oil_Std", "Mismatch_Type"]),
        "Q4_By_City": q.group_counts(mismatches, ["city_picked", "Mismatch_Type"]),
        "Q5_Key_Overlap": q.key_overlap(tables.collection(), "sample_code", tables.testing(), "sample_code"),
        "Q5_Master_Dataset": master,
        "Q5_Shelf_Life_Stats": st.describe_numeric(master, "Shelf_Life_Days", digits=1),
        "Q5_Short_Shelf_Life_Flags": A.value_counts(master, "Short_Shelf_Life_Flag", pct_name=None),
        "Q5_Insight_City_Fail_Rate": q.outcome_rate_by(master, "city"),
        "Q5_Insight_Shop_Fail_Rate": q.outcome_rate_by(master, "shop_type"),
        "Q5_Shelf_Life_By_Oil": q.group_stats(master, "Oil_Type_Standardized", "Shelf_Life_Days"),
        "Q5_Mismatch_And_Fail": master.where((F.col("Mismatch_Type") == "Major Mismatch")
                                             & (F.col("Pass_Fail") == "FAIL")).select(
            "sample_code", "Sampler_Oil_Std", "Lab_Oil_Std", "Pass_Fail", "Failure_Reason"),
    }


def monitoring_reports(tables: Tables) -> dict[str, DataFrame]:
    """Analysis tables (A1-D4), the eight SQL reports and the workbook
    sheets (E1-E6) of the application-monitoring workload."""
    apps = tables.applications()
    enriched = cut_lineage(W.enriched(apps))
    commissioned = F.col("Commission_Date").isNotNull()
    payback = A.payback_frame(enriched)
    codes = fe.assign_codes(enriched, "State")
    viol = A.violations(enriched, codes)
    pb_rows = enriched.where(F.col("Monthly_Bill_Savings_Rs").isNotNull()).withColumn(
        "Payback_Months", fe.payback_months()).withColumn("Payback_Category", fe.payback_category())
    out = {
        "A1_Missing_Profile": fe.missing_profile(apps),
        "A2_Pipeline_Days": st.describe_numeric(enriched.where(commissioned), "Total_Pipeline_Days", digits=1),
        "A3_IQR_Bounds": fe.iqr_bounds(apps, "Market_Cost_Rs"),
        "A4_Integrity": fe.integrity_check(enriched, {
            "cfa_cap_breach": (F.col("CFA_Sanctioned_Rs") > fe.SCHEME_CFA_MAX, None),
            "units_excess": (F.col("Units_Ratio") > fe.UNITS_RATIO_LIMIT, F.col("Actual_Monthly_Units"))}),
        "A5_Summary_Statistics": st.summary_stats(apps, ["TFC_Processing_Days", "CFA_Credit_Days_After_Commission",
                                                         "Monthly_Bill_Savings_Rs", "Satisfaction_Score"]),
        "B1_Market_Cost_Gap": st.describe_numeric(enriched, "Market_Cost_Gap_Pct", digits=2),
        "B2_Interest_Breach_By_State": A.breach_rate_by(enriched.where(F.col("Has_Loan") == True),  # noqa: E712
                                                        "State", "Actual_Interest_Rate_pct", A.INTEREST_MANDATE_PCT),
        "B3_DISCOM_SLA": A.sla_compliance(enriched),
        "B4_Savings_By_Size": A.mean_by(enriched, "System_Size_kW", "Monthly_Bill_Savings_Rs", "Avg_Savings"),
        "B4_Savings_By_Category": A.mean_by(enriched, "Beneficiary_Category", "Monthly_Bill_Savings_Rs",
                                            "Avg_Savings", order=A.CATEGORY_ORDER, digits=2),
        "B5_DISCOM_Incentive": A.utilisation_rate(enriched),
        "C1_Pipeline_Funnel": A.funnel(enriched),
        "C2_Pipeline_By_State": A.stage_days_by(enriched),
        "C3_ALMM_Compliance": A.compliance_vs_rating(enriched, where=commissioned),
        "C4_Grievance_Resolution": A.resolution_table(enriched.where(F.col("Has_Grievance") == True)),  # noqa: E712
        "C5_Regression_Coefficients": st.ols_standardised(
            enriched, ["System_Size_kW", "Monthly_Bill_Savings_Rs", "Vendor_Rating", "Grievance_Resolved",
                       "Total_Pipeline_Days"], "Satisfaction_Score", fill_zero=["Grievance_Resolved"]),
        "D1_Beneficiary_Share": A.share_vs_benchmark(enriched),
        "D2_Installs_By_State": A.concentration_table(enriched, where=commissioned),
        "D2_Gini": st.gini(A.concentration_table(enriched, where=commissioned), "Installations"),
        "D3_Performance_Heatmap": A.pivot_mean(enriched.where(F.col("Actual_Monthly_Units").isNotNull()),
                                               "State", "System_Size_kW", "Units_Ratio"),
        "D4_Payback_By_Category": A.payback_by_category(enriched),
        "D4_Payback_Box": st.box_stats(payback, "Payback_Months", ["Beneficiary_Category"]),
        "Enriched_Dataset": enriched,
        "E1_State_Summary": A.state_summary(enriched),
        "E2_CFA_Check": fe.cfa_error_check(enriched).select(
            "Application_ID", "State", "System_Size_kW", "Benchmark_Cost_per_kW", "Market_Cost_Rs",
            "CFA_Sanctioned_Rs", "Calculated_CFA", "CFA_Error", "CFA_Error_Flag"),
        "E2_CFA_Summary": fe.cfa_error_summary(fe.cfa_error_check(enriched)),
        "E3_Pipeline_Top10_States": A.topn_state_stage_means(enriched),
        "E3_Grievance_Distribution": A.value_counts(enriched.where(F.col("Has_Grievance") == True),  # noqa: E712
                                                    "Grievance_Type", pct_name=None),
        "E3_Monthly_Trend": A.monthly_trend(enriched),
        "E4_Vendor_Summary": A.vendor_summary(enriched),
        "E5_State_Ref": codes,
        "E5_Loan_Violations": viol,
        "E5_Violations_By_State": A.violations_by_state(enriched),
        "E6_Payback_Model": pb_rows.select("Application_ID", "State", "Beneficiary_Category", "System_Size_kW",
                                           "Market_Cost_Rs", "CFA_Sanctioned_Rs", "Monthly_Bill_Savings_Rs",
                                           F.bround("Payback_Months", 1).alias("Payback_Months"), "Payback_Category"),
        "E6_Payback_Pivot": A.payback_pivot(enriched),
    }
    for name, fn in R.REPORTS.items():
        out["SQL_" + name] = fn(enriched)
    out["SQL_top_stage_state"] = rk.arg_max(A.stage_days_by(enriched), "State", "Total")
    return out


def write_suite(tables: Tables, out_root: str, fmt: str = "parquet") -> dict[str, str]:
    """Build and write both suites; a table that is optional in the
    reference (the mismatch-and-fail sheet) is written only if non-empty."""
    paths = {}
    forms = sample_form_reports(tables)
    optional = {"Q5_Mismatch_And_Fail": forms.pop("Q5_Mismatch_And_Fail")}
    paths.update(write_report(forms, os.path.join(out_root, "sample_forms"), fmt))
    for name, df in optional.items():
        path = os.path.join(out_root, "sample_forms", name)
        if write_if_nonempty(df, path, fmt):
            paths[name] = path
    paths.update(write_report(monitoring_reports(tables), os.path.join(out_root, "monitoring"), fmt))
    return paths


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="Write every report table of both workloads.")
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet")
    args = ap.parse_args(argv)
    spark = build_session()
    paths = write_suite(Tables(spark, args.sf_dir), args.out, args.format)
    for name in sorted(paths):
        print(name, paths[name])


if __name__ == "__main__":
    main()
