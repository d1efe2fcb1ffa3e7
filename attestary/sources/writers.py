"""Writers: results, reports, run logs, chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

JOB_BUCKETS = 256


def append_runs(runs: DataFrame, path: str) -> None:
    """Append completed runs to the log, in the order of ``runs`` if that is sorted; failed ones are never logged."""
    (runs.where("status = 'completed'")
     .select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts"), "form_id",
             F.col("documents").cast("int").alias("documents"),
             F.bround("seconds", 1).alias("seconds"))
     .write.mode("append").json(path))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("form_id").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str, buckets: int = JOB_BUCKETS) -> None:
    """Chunks with their vectors, in a fixed number of job buckets.

    A folder per job would be as many folders as there are jobs. One giant job is spread over the
    tasks that hold its chunks; nothing is gathered to write it.
    """
    (chunks.withColumn("job_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
     .write.mode("append").partitionBy("job_bucket").parquet(path))


def read_chunks(spark: SparkSession, path: str, job_id: str | None = None,
                buckets: int = JOB_BUCKETS) -> DataFrame:
    """All chunks, or those of one job: only its bucket is listed and read."""
    chunks = spark.read.parquet(path)
    if job_id is None:
        return chunks
    bucket = F.pmod(F.xxhash64(F.lit(job_id)), F.lit(buckets)).cast("int")
    return chunks.where((F.col("job_bucket") == bucket) & (F.col("job_id") == job_id))
