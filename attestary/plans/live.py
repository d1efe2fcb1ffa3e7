"""Streaming plans: each must give what its batch counterpart gives on the same rows."""

from pyspark.sql import DataFrame, functions as F

from attestary.operators.pages import content_hash
from attestary.plans.registry import Source, plain, query
from attestary.plans.reporting import RUNS, STATUS, STATUS_EVENTS
from attestary.plans.texts import DOCS, chunk_sql
from attestary.session import shared_dir
from attestary.streaming import streams as X


def stream(s: Source, table: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of parts: a stream takes a single file only by a pattern."""
    schema = s.spark.read.parquet(f"{s.folder}/{table}.parquet").schema
    return s.spark.readStream.schema(schema).parquet(f"{s.folder}/{table}[.]parquet")


def shaped(s: Source, table: str, sql: str) -> DataFrame:
    return s.spark.sql(sql, **{table: stream(s, table)})


@query("stream_chunks", f"""
SELECT job_id, doc_no, row_number() OVER (PARTITION BY job_id, doc_no ORDER BY chunk_no) - 1 AS part, md5(text) AS digest FROM ({chunk_sql(plain(DOCS))}) c""")
def stream_chunks(s: Source) -> DataFrame:
    out = X.drain(X.stream_chunks(shaped(s, "documents", DOCS)))
    return out.select("job_id", "doc_no", F.col("part").cast("bigint").alias("part"), F.md5("text").alias("digest"))


@query("stream_dedupe", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_dedupe(s: Source) -> DataFrame:
    docs = stream(s, "documents").select(
        "doc_id", content_hash(F.col("text")).alias("content_hash"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("ts"))
    return X.drain(X.stream_dedupe(docs, "365 days")).select("content_hash")


@query("stream_new_contents", """
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY ALL""")
def stream_new_contents(s: Source) -> DataFrame:
    """Two runs with one store of known contents: the second gives what the first has not seen."""
    cache = shared_dir(s.spark, "known-contents")
    docs = stream(s, "documents").where("text IS NOT NULL").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    X.new_contents(docs.where("doc_id % 3 = 0"), cache)
    return X.new_contents(docs, cache).select("content_hash", "doc_id")


@query("stream_status", f"""
SELECT job_id, status, message, epoch_us(started) AS started_us, epoch_us(ended) AS ts_us FROM ({STATUS}) x
WHERE status NOT IN ('completed', 'failed') OR epoch_us(ended) // 1000000 + 3600 > epoch_us((SELECT max(ts) FROM events)) // 1000000 - 600""")
def stream_status(s: Source) -> DataFrame:
    events = shaped(s, "events", STATUS_EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    out = X.latest_status(X.drain(X.stream_status(events), "update"))
    return out.select("job_id", "status", "message", "started_us", "ts_us")


@query("stream_run_stats", f"""
WITH r AS (SELECT * FROM ({plain(RUNS)}) x WHERE seconds IS NOT NULL),
t AS (SELECT form_id, count(*) AS runs, round_even(avg(seconds), 1) AS average_seconds FROM r GROUP BY form_id),
p AS (SELECT form_id, round_even(avg(seconds), 1) AS recent_average_seconds FROM (SELECT * FROM r
  QUALIFY row_number() OVER (PARTITION BY form_id ORDER BY log_no DESC) <= 20) y GROUP BY form_id)
SELECT * FROM t JOIN p USING (form_id)""")
def stream_run_stats(s: Source) -> DataFrame:
    return X.run_figures(X.drain(X.stream_run_stats(shaped(s, "events", RUNS)), "update"))
