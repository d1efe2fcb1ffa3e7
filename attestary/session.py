"""Session settings, and the folder staged tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole texts travel in Arrow batches: fewer rows per batch keeps a batch in tens of MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
BATCHES = [key for key in SETTINGS if key.startswith("spark.sql.execution.arrow.max")]


def get_spark(app: str = "attestary", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> SparkSession:
    """A session made elsewhere hands texts to Python in batches of the same bounded size."""
    for key in BATCHES:
        spark.conf.set(key, SETTINGS[key])
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, below ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: there, driver and executors
    share one disk. On a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="attestary-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """A thin table used more than once, written to the shared folder, with its lineage cut.

    A lost executor then costs a re-read and not the plan behind it. What was shuffled on the way is
    removed as soon as the table is written, and not when the driver happens to collect its garbage.
    """
    path = shared_dir(df.sparkSession, purpose)
    conf = df.sparkSession.conf
    was = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if was is None else conf.set(SHUFFLES_GO, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Remove staged tables whose last reader has written its own result."""
    for df in tables:
        path = getattr(df, "staged_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
