"""Bindings of the driver's test tables to the three input tables the
workloads expect: ``applications`` (scheme monitoring), ``collection``
and ``testing`` (sample forms).

Each binding is ONE SQL text that runs unchanged in Spark SQL (ANSI on)
and in DuckDB, so the Spark job and the DuckDB oracle start from the same
rows.  Table references are ``{placeholders}``: Spark binds them to
DataFrames (``spark.sql(text, lineitem=df, ...)``), the oracle formats
them to the pre-registered view names.

At scale ``applications`` is a 5-way join over lineitem/orders/customer/
nation/part.  It is left to Catalyst: only referenced columns are read,
nation is broadcast by AQE at runtime (25 rows), and the large equi-joins
are sort-merge joins on their keys.  ``materialize`` writes the three
bound tables once so a report suite does not redo the join per report.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

APPLICATIONS_SQL = """
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, c_custkey, c_mktsegment, n_name,
         cast(o_orderdate AS date) AS app_date,
         cast((l_orderkey*7 + l_linenumber) % 10 AS int) AS depth,
         l_orderkey*7 + l_linenumber AS k, 1 + p_size % 5 AS kw,
         CASE WHEN n_regionkey = 0 THEN 55000e0 ELSE 50000e0 END AS bench
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {part} ON l_partkey = p_partkey),
lags AS (
  SELECT base.*,
         CASE WHEN depth >= 1 THEN cast(3 + k % 40 AS int) END AS d1,
         CASE WHEN depth >= 2 THEN cast(5 + l_quantity AS int) END AS d2,
         CASE WHEN depth >= 3 THEN cast(2 + l_partkey % 20 AS int) END AS d3,
         CASE WHEN depth >= 3 THEN cast(10 + l_suppkey % 90 AS int) END AS d4
  FROM base)
SELECT l_orderkey*10 + l_linenumber AS Application_ID, n_name AS State,
  concat('D', cast(c_custkey % 36 AS varchar(9))) AS DISCOM,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'BPL' WHEN 'AUTOMOBILE' THEN 'SC/ST' WHEN 'MACHINERY' THEN 'Women-headed'
       WHEN 'HOUSEHOLD' THEN 'OBC' ELSE 'General' END AS Beneficiary_Category,
  kw AS System_Size_kW, l_suppkey AS Vendor_ID,
  CASE WHEN depth >= 3 THEN 1 + (l_partkey % 9)*0.5e0 END AS Vendor_Rating,
  app_date AS Application_Date, app_date + d1 AS TFC_Date, app_date + (d1 + d2) AS Installation_Date,
  app_date + (d1 + d2 + d3) AS Commission_Date, app_date + (d1 + d2 + d3 + d4) AS CFA_Credit_Date,
  d1 AS TFC_Processing_Days, d2 AS Installation_Days_After_TFC, d3 AS Commission_Days_After_Install,
  d4 AS CFA_Credit_Days_After_Commission, bench AS Benchmark_Cost_per_kW,
  bench*kw*(0.8e0 + l_discount*8)*(CASE WHEN l_quantity = 50 THEN 3 ELSE 1 END) AS Market_Cost_Rs,
  least(0.6e0*bench*least(kw, 2) + 0.4e0*bench*greatest(kw - 2, 0), 78000e0)
    + CASE WHEN l_linenumber = 7 THEN 1000 ELSE 0 END AS CFA_Sanctioned_Rs,
  120e0*kw AS Expected_Monthly_Units,
  CASE WHEN depth >= 3 THEN 120e0*kw*(0.6e0 + l_tax*12.5e0) END AS Actual_Monthly_Units,
  CASE WHEN depth >= 3 THEN l_extendedprice/30e0 END AS Monthly_Bill_Savings_Rs,
  CASE WHEN depth >= 3 THEN 1 + (l_partkey + l_suppkey) % 5 END AS Satisfaction_Score,
  l_returnflag = 'A' AS Has_Loan,
  CASE WHEN l_returnflag = 'A' THEN l_linestatus = 'F' END AS Loan_Approved,
  CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS Loan_Amount_Rs,
  CASE WHEN l_returnflag = 'A' AND k % 11 <> 0 THEN 5.5e0 + (l_suppkey % 10)*0.5e0 END AS Actual_Interest_Rate_pct,
  CASE WHEN k % 5 <> 0 THEN l_extendedprice/10e0 END AS DISCOM_Incentive_Received_Rs,
  CASE WHEN k % 5 <> 0 THEN l_extendedprice/10e0*(0.5e0 + (c_custkey % 36)/72e0) END AS DISCOM_Incentive_Utilised_Rs,
  l_partkey % 4 <> 0 AS ALMM_Compliant, l_returnflag = 'R' AS Has_Grievance,
  CASE WHEN l_returnflag = 'R' THEN concat('G', cast(l_linenumber AS varchar(9))) END AS Grievance_Type,
  CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'F' END AS Grievance_Resolved,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN cast(5 + l_quantity AS int) END AS Grievance_TAT_Days
FROM lags
"""

# The canonical label vocabulary, in its original order
# (index = position).  The `collection`/`testing` bindings draw labels from it.
OIL_DIM_SQL = """
SELECT * FROM (VALUES (0,'Mustard Oil'),(1,'Sunflower Seed Oil'),(2,'Groundnut Oil'),(3,'Soybean Oil'),(4,'Rice Bran Oil'),
 (5,'Olive Oil'),(6,'Coconut Oil'),(7,'Multi-Source Edible Oil'),(8,'Palm Oil'),(9,'Cotton Seed Oil'),(10,'Sesame Oil'),
 (11,'Refined Vegetable Oil')) t(idx, name)
"""

COLLECTION_SQL = """
WITH oil_dim AS (""" + OIL_DIM_SQL + """)
SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS sample_code,
  n_name AS city, o_orderpriority AS shop_type,
  CASE o_orderkey % 9 WHEN 0 THEN upper(name) WHEN 1 THEN lower(replace(name, ' ', '')) WHEN 2 THEN concat('  ', name, ' ')
       WHEN 3 THEN concat(substr(name, 1, 1), substr(name, 3)) WHEN 4 THEN 'ghee blend' WHEN 5 THEN NULL
       WHEN 6 THEN substr(name, 1, length(name) - 4)
       WHEN 7 THEN CASE o_custkey % 6 WHEN 0 THEN 'Refined Vegetble Oil' WHEN 1 THEN 'refinedvegtoil' WHEN 2 THEN 'REFINED VEGETOIL'
         WHEN 3 THEN 'Palmm Oil' WHEN 4 THEN 'Groundnuts Oil' ELSE 'groundnutsoils' END
       ELSE name END AS oil_raw,
  concat(lpad(cast(day(o_orderdate) AS varchar(2)), 2, '0'), '/', lpad(cast(month(o_orderdate) AS varchar(2)), 2, '0'), '/',
         cast(year(o_orderdate) AS varchar(4))) AS mfg_raw,
  CASE WHEN o_custkey % 13 = 0 THEN 'not printed' ELSE
    concat('15/', lpad(cast(month(o_orderdate) AS varchar(2)), 2, '0'), '/', cast(year(o_orderdate) + 1 + o_custkey % 2 AS varchar(4)))
  END AS expiry_raw
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN oil_dim ON idx = o_custkey % 12
"""

TESTING_SQL = """
WITH oil_dim AS (""" + OIL_DIM_SQL + """)
SELECT l_orderkey AS sample_code, n_name AS city_picked, upper(s.name) AS oil_sampler,
  CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE lower(replace(b.name, ' ', '')) END AS oil_lab,
  CASE l_suppkey % 6 WHEN 0 THEN 'BLQ' WHEN 1 THEN '<0.05' WHEN 2 THEN NULL WHEN 3 THEN 'smudged'
       ELSE CASE l_orderkey % 40 WHEN 0 THEN '5.03125' WHEN 1 THEN '6.00005' WHEN 2 THEN 'inf' WHEN 3 THEN '1e30'
         WHEN 4 THEN '0.00005' WHEN 5 THEN concat(cast(l_partkey % 7 AS varchar(4)), '.', cast(l_suppkey AS varchar(9)), '5')
         ELSE cast(cast(l_quantity AS int) % 9 AS varchar(4)) END END AS lead,
  cast(cast(l_quantity AS int) % 5 AS varchar(4)) AS acid_value,
  CASE WHEN l_partkey % 10 = 0 THEN 'Positive' ELSE 'Negative' END AS argemone,
  cast(l_partkey % 8 AS varchar(4)) AS copper,
  CASE WHEN l_partkey % 9 = 0 THEN 'ND' ELSE cast(l_suppkey % 7 AS varchar(4)) END AS arsenic,
  concat(cast(l_partkey % 6 AS varchar(4)), '.5') AS tin,
  CASE WHEN l_suppkey % 11 = 0 THEN 'not detected' WHEN l_suppkey % 13 = 0 THEN '7e0' ELSE '0.1' END AS cadmium,
  CASE WHEN l_suppkey % 17 = 0 THEN '5.00006' ELSE ' 5 ' END AS mercury,
  concat('0.', cast(l_partkey % 90 AS varchar(4))) AS aflatoxin_b1,
  CASE WHEN l_partkey % 23 = 0 THEN '1_0' ELSE 'LOQ' END AS total_aflatoxins,
  cast(150 + l_partkey % 40 AS varchar(4)) AS saponification_value,
  cast(90 + l_suppkey % 35 AS varchar(4)) AS iodine_value,
  CASE WHEN l_partkey % 31 = 0 THEN '130.00005' ELSE '130' END AS unsaponifiable_matter,
  CASE WHEN l_partkey % 19 = 0 THEN ' POSITIVE ' ELSE 'Negative' END AS polybromide_test,
  CASE WHEN l_suppkey % 29 = 0 THEN 'positive' END AS mineral_oil
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey
JOIN oil_dim s ON s.idx = l_partkey % 12
JOIN oil_dim b ON b.idx = CASE WHEN l_suppkey % 4 = 0 THEN (l_partkey + 1) % 12 WHEN l_suppkey % 4 = 1 AND l_partkey % 12 = 7 THEN 11
  ELSE l_partkey % 12 END
"""

BINDINGS = {
    "applications": APPLICATIONS_SQL,
    "collection": COLLECTION_SQL,
    "testing": TESTING_SQL,
}


def _placeholders(sql: str) -> list[str]:
    return [t for t in BASE_TABLES if "{" + t + "}" in sql]


def duckdb_cte(names=("applications", "collection", "testing")) -> str:
    """``WITH`` clause defining the bound views over DuckDB's base views."""
    parts = []
    for n in names:
        body = BINDINGS[n].format(**{t: t for t in BASE_TABLES})
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = BINDINGS[name]
    args = {t: base_table(spark, sf_dir, t) for t in _placeholders(sql)}
    return spark.sql(sql, **args)


@dataclass
class Tables:
    """Provider of the three bound input tables.

    ``Tables(spark, sf_dir)`` derives them from the driver's parquet tables
    on every call (lazy; Catalyst prunes what a report does not read).
    ``Tables(spark, sf_dir, materialized=root)`` reads copies written by
    :func:`materialize` instead.
    """

    spark: SparkSession
    sf_dir: str
    materialized: str | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    def get(self, name: str) -> DataFrame:
        if self.materialized:
            return self.spark.read.parquet(os.path.join(self.materialized, name))
        return bind(self.spark, self.sf_dir, name)

    def applications(self) -> DataFrame:
        return self.get("applications")

    def collection(self) -> DataFrame:
        return self.get("collection")

    def testing(self) -> DataFrame:
        return self.get("testing")

    def base(self, name: str) -> DataFrame:
        return base_table(self.spark, self.sf_dir, name)


def materialize(spark: SparkSession, sf_dir: str, out_root: str, min_files: int | None = None) -> Tables:
    """Write the bound tables once as parquet under ``out_root`` (a shared
    folder on a cluster) and return a provider that reads them.

    ``min_files`` writes each table as that many round-robin files, so
    scans of a small table still get one task per core; leave it unset for
    large tables, which come out of the join in many partitions."""
    for name in BINDINGS:
        df = bind(spark, sf_dir, name)
        if min_files:
            df = df.repartition(min_files)
        df.write.mode("overwrite").parquet(os.path.join(out_root, name))
    return Tables(spark, sf_dir, materialized=out_root)
