"""Spark session helpers.

Every job in this package is a plain DataFrame plan; the session only pins the
settings the plans rely on (AQE, Arrow, UTC) and makes sure a *shared*
checkpoint directory is known: lineage is cut with tables written there.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "semdex", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, taking it from the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; we only
    invent one (under the system temp dir) in local mode, as tests do.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative plans")
    local = tempfile.mkdtemp(prefix="semdex-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def materialize(df):
    """Cut lineage at a stage boundary with a table written to the shared
    checkpoint folder.

    Used for results that several branches of a plan reuse (vocabulary,
    neighbour lists, candidates) and for every round of iterative plans. The
    plan below the boundary runs once; later stages read the Parquet files
    (a lost executor re-reads them instead of recomputing). A written table
    is preferred over ``Dataset.checkpoint``: its size statistics come from
    the files, whereas a checkpoint keeps the *estimated* size of the plan it
    replaced - and size-only estimates of joins multiply, so in an iterative
    loop they grow without bound and planning slows down round after round.
    """
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{uuid.uuid4().hex}"
    write_and_clean(df, path)
    return spark.read.parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_and_clean(df, path: str, mode: str = "error") -> None:
    """Write ``df`` as Parquet; the shuffle files of the write go with it, else they would stay until the
    driver happens to collect its garbage, and a plan of many steps would hold those of all steps."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


_cleaned: set[str] = set()


def tables_folder(spark: SparkSession) -> str:
    """Where this application writes intermediate tables; deleted when it ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/semdex-tables/{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def drop_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far; only for a session none of whose results is in use."""
    _delete(spark, tables_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:     # stopped before
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
