"""Session construction and lineage helpers.

Library code never creates its own session; it takes the caller's.
``build_session`` exists for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes.  ANSI stays on (Spark 4
# default): division and casts are written with try_* so they never raise.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tally", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("TALLY_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it from
    ``spark.checkpoint.dir`` when the context has none yet.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is
    always used; without it a cluster session is refused, since executors
    could not see each other's files.  Only a single-process session
    (``local`` master: tests, bench) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - conf key absent
            configured = None
    if not configured:
        if not re.match(r"local(\[|$)", sc.master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tally-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the reliable checkpoint
    folder and read it back (never ``localCheckpoint``).  Unlike an RDD
    checkpoint, which computes the plan once to count and again to write,
    this computes it once.  The result survives executor loss, and columns
    derived from partition ids are frozen with the data; the shuffle files
    that led to it are removed at once.  The folder goes
    when the application ends, or earlier through :func:`drop_frozen`."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = root.rstrip("/") + "/tables/" + uuid.uuid4().hex
    with _shuffles_removed(spark):
        df.write.mode("errorifexists").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files when they end (else these
    stay until the driver collects garbage).  The session's own setting comes
    back afterwards; a Spark without it goes on as usual."""
    try:
        before = spark.conf.get(_CLEANUP)
    except Exception:  # noqa: BLE001 - unknown setting
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Queries run inside shuffle into ``n`` partitions at least (adaptive
    execution joins small ones); the session's own number comes back
    afterwards."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), n)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the application ends."""
    fs, place = _filesystem(spark, path)
    fs.deleteOnExit(place)


def drop_frozen(df: DataFrame) -> None:
    """Delete a table made by :func:`cut_lineage` that nothing reads any
    more (a loop's previous round)."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/tables/"
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/tables/" in folder and folder.rsplit("/", 2)[1] == "tables":
            fs, place = _filesystem(spark, root + folder.rsplit("/", 1)[1])
            fs.delete(place, True)
