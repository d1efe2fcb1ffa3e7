"""Structured Streaming: chunks and vectors, seen contents, live job status, run figures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from attestary import fixed
from attestary.operators.chunking import chunk_documents, with_source_header
from attestary.operators.retrieval import embed
from attestary.session import shared_dir

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_rocksdb(spark) -> None:
    spark.conf.set(*STATE_STORE)


def to_table(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Run over everything available into a parquet table.

    Each micro-batch owns one folder and overwrites it, so a batch repeated after a failure
    leaves its rows once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return (stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", shared_dir(stream.sparkSession, "stream"))
            .trigger(availableNow=True).start())


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows a stream produces from all input available now, as a table."""
    path = shared_dir(stream.sparkSession, "stream-out")
    to_table(stream, path, mode).awaitTermination()
    return stream.sparkSession.read.schema(
        T.StructType(stream.schema.fields + [T.StructField("batch_id", T.LongType())])).parquet(path)


def stream_chunks(docs: DataFrame, encoder=None, dim: int = 256) -> DataFrame:
    """Documents to chunks with vectors, statelessly: a chunk is known by document and part."""
    return embed(chunk_documents(with_source_header(docs)), "text", encoder, dim)


def stream_dedupe(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival of each content; repeats within the watermark delay are dropped."""
    return (files.withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["content_hash"]))


def new_contents(files: DataFrame, cache: str, mode: str = "append") -> DataFrame:
    """``files`` whose ``content_hash`` no earlier run has handled, from all input available now; one row per content.

    ``cache`` is a folder of hashes that outlives the stream: every micro-batch meets it in an anti-join
    before anything dear is done, and adds its own hashes as one folder. A batch repeated after a failure
    is compared with the folders of all others and overwrites its own, so it gives the same rows once
    more and forgets nothing. Which of several files with one content goes on is the first by all columns.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex
    out = shared_dir(spark, "new-contents")
    hashes = T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("batch", T.StringType())])
    others = [c for c in files.columns if c != "content_hash"]

    def write(batch: DataFrame, batch_id: int) -> None:
        mine = f"{run}-{batch_id}"
        known = spark.read.schema(hashes).parquet(f"{cache}/seen").where(F.col("batch") != mine)
        first = batch.groupBy("content_hash").agg(F.min(F.struct(*others)).alias("_f")).select("_f.*", "content_hash")
        fresh = first.join(known, "content_hash", "left_anti").select(*files.columns)
        fresh.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        # what was written is read again, so hashes and rows are the same whatever is run twice
        spark.read.schema(files.schema).parquet(f"{out}/batch_id={batch_id}").select("content_hash") \
            .write.mode("overwrite").parquet(f"{cache}/seen/batch={mine}")
    # an empty part, so that the first batch finds a table
    spark.createDataFrame([], T.StructType(hashes.fields[:1])).write.mode("overwrite").parquet(f"{cache}/seen/batch=none")
    (files.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_dir(spark, "stream"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(T.StructType(files.schema.fields + [T.StructField("batch_id", T.LongType())])).parquet(out)


# --- live job status ------------------------------------------------------------------------

STATUS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("progress", T.IntegerType()),
    T.StructField("started_us", T.LongType()), T.StructField("ts_us", T.LongType()),
    T.StructField("event_no", T.LongType()), T.StructField("expired", T.BooleanType())])


class JobStatus(StatefulProcessor):
    """Latest state of one job; a finished job expires ``ttl`` seconds after its last event.

    Expiry follows event time, so a replay of the same events expires the same jobs.
    """

    def __init__(self, ttl: int = fixed.RETENTION_SECONDS):
        self.ttl_us = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", T.StructType(STATUS.fields[1:-1]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        known = self.latest.get() if self.latest.exists() else None
        started = known[3] if known else None
        for pdf in rows:
            # one pass per Arrow batch: only its newest event and its earliest time are kept
            first = int(pdf["ts_us"].min())
            started = first if started is None else min(started, first)
            top = pdf.sort_values(["ts_us", "event_no"]).iloc[-1]
            if known is None or (top["ts_us"], top["event_no"]) > (known[4], known[5]):
                known = (top["status"], top["message"], int(top["progress"]), started,
                         int(top["ts_us"]), int(top["event_no"]))
        known = (*known[:3], started, *known[4:])
        self.latest.update(known)
        if known[0] in ("completed", "failed"):
            self.handle.registerTimer((known[4] + self.ttl_us) // 1000)
        yield self._row(key, known, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.latest.get() if self.latest.exists() else None
        due = known and (known[4] + self.ttl_us) // 1000 <= expiredTimerInfo.getExpiryTimeInMs()
        # a later event has moved the deadline, or the job is active again
        if due and known[0] in ("completed", "failed"):
            self.latest.clear()
            yield self._row(key, known, True)

    def _row(self, key, known, expired: bool) -> pd.DataFrame:
        row = (key[0], *known, expired)
        return pd.DataFrame([row], columns=[f.name for f in STATUS.fields])

    def close(self) -> None:
        pass


def stream_status(events: DataFrame, ttl: int = fixed.RETENTION_SECONDS,
                  delay: str = "10 minutes") -> DataFrame:
    """Live status rows from ``events(job_id, event_no, ts, status, message, progress)``."""
    use_rocksdb(events.sparkSession)
    rows = (events.withWatermark("ts", delay)
            .withColumn("ts_us", F.unix_micros("ts")))
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobStatus(ttl), outputStructType=STATUS, outputMode="Update",
        timeMode="EventTime")


def latest_status(updates: DataFrame) -> DataFrame:
    """Current row per job out of the emitted updates, expired jobs gone."""
    newest = F.max_by(F.struct("status", "message", "progress", "started_us", "ts_us", "expired"),
                      F.struct("ts_us", "event_no", "expired", "batch_id"))
    return (updates.groupBy("job_id").agg(newest.alias("_l")).select("job_id", "_l.*")
            .where("NOT expired"))


# --- run figures ----------------------------------------------------------------------------

PARTIAL = T.StructType([
    T.StructField("form_id", T.StringType()), T.StructField("salt", T.IntegerType()),
    T.StructField("runs", T.LongType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("documents", T.LongType()),
    T.StructField("recent_no", T.ArrayType(T.LongType())),
    T.StructField("recent_s", T.ArrayType(T.DoubleType()))])


class RunFigures(StatefulProcessor):
    """Totals and the newest runs of one (form, salt)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", T.StructType(PARTIAL.fields[2:5]))
        self.recent = handle.getListState("recent", T.StructType([
            T.StructField("log_no", T.LongType()), T.StructField("seconds", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        n, seconds, documents = self.totals.get() if self.totals.exists() else (0, 0.0, 0)
        kept = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        for pdf in rows:
            timed = pdf[pdf["seconds"].notna()]
            n, seconds = n + len(timed), seconds + float(timed["seconds"].sum())
            documents += int(pdf["documents"].fillna(0).sum())
            kept += list(zip(timed["log_no"].astype(int).tolist(), timed["seconds"].tolist()))
            kept = sorted(kept)[-fixed.RECENT_RUNS:]
        self.totals.update((n, seconds, documents))
        self.recent.put(kept)
        yield pd.DataFrame([(key[0], int(key[1]), n, seconds, documents, [k for k, _ in kept],
                             [s for _, s in kept])], columns=[f.name for f in PARTIAL.fields])

    def close(self) -> None:
        pass


SALTS = 16


def stream_run_stats(runs: DataFrame) -> DataFrame:
    """Partial figures per (form, salt); the salt spreads a form that holds most runs."""
    use_rocksdb(runs.sparkSession)
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("log_no"), F.lit(SALTS)).cast("int"))
    return salted.groupBy("form_id", "salt").transformWithStateInPandas(
        statefulProcessor=RunFigures(), outputStructType=PARTIAL, outputMode="Update",
        timeMode="None")


def run_figures(updates: DataFrame) -> DataFrame:
    """Totals per form, and the mean of its newest runs over all salts."""
    last = F.row_number().over(W.partitionBy("form_id", "salt").orderBy(F.desc("batch_id")))
    now = updates.withColumn("_n", last).where("_n = 1")
    totals = now.groupBy("form_id").agg(F.sum("runs").alias("runs"),
                                        F.sum("seconds").alias("_s"))
    each = now.select("form_id", F.inline(F.arrays_zip("recent_no", "recent_s")))
    newest = F.row_number().over(W.partitionBy("form_id").orderBy(F.desc("recent_no")))
    recent = (each.withColumn("_n", newest).where(F.col("_n") <= fixed.RECENT_RUNS)
              .groupBy("form_id").agg(F.avg("recent_s").alias("_r")))
    return (totals.join(recent, "form_id", "left")
            .select("form_id", "runs", F.bround(F.col("_s") / F.col("runs"), 1)
                    .alias("average_seconds"),
                    F.bround("_r", 1).alias("recent_average_seconds")))
