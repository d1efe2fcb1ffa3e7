"""Operational reports over runs, job events and field results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestary import fixed
from attestary.functions.paths import section_of


def _summary(runs: DataFrame, recent: DataFrame, keys: list[str]) -> DataFrame:
    seconds = F.col("seconds")
    total = runs.groupBy(*keys).agg(
        F.count("seconds").alias("runs"), F.sum("seconds").alias("_sum"),
        F.sum(F.coalesce("documents", F.lit(0))).alias("_docs"),
        F.max_by("seconds", F.when(seconds.isNotNull(), F.col("log_no"))).alias("last_seconds"))
    mean = F.avg("seconds").alias("_recent")
    both = total.join(recent.groupBy(*keys).agg(mean), keys, "left") if keys \
        else total.withColumn("_recent", recent.agg(mean).scalar())
    some = F.col("runs") > 0
    return both.select(
        *(keys or [F.lit(None).cast("string").alias("form_id")]), "runs",
        F.when(some, F.bround(F.col("_sum") / F.col("runs"), 1)).alias("average_seconds"),
        F.bround("_recent", 1).alias("recent_average_seconds"),
        F.when(some, F.bround(F.try_divide(F.col("_sum"), F.col("_docs")), 1))
        .alias("average_seconds_per_document"),
        F.when(some, F.col("last_seconds")).alias("last_seconds"))


def run_summary(runs: DataFrame, window: int = fixed.RECENT_RUNS) -> DataFrame:
    """Duration figures per form, and over all forms (NULL ``form_id``).

    ``runs(log_no, form_id, documents, seconds)``, ``log_no`` the order of the log. The recent figures
    are each a top 20 of their own: one over the whole log, one per form.
    """
    timed = runs.where("seconds IS NOT NULL")
    newest = F.row_number().over(W.partitionBy("form_id").orderBy(F.desc("log_no")))
    per_form = timed.withColumn("_n", newest).where(F.col("_n") <= window)
    overall = timed.orderBy(F.desc("log_no")).limit(window)
    return _summary(runs, per_form, ["form_id"]).unionByName(_summary(runs, overall, []))


STAGES = ["ocr_embed", "synthesis", "extraction", "injection"]


def stage_timings(events: DataFrame) -> DataFrame:
    """Seconds per stage and in total, from ``events(job_id, ts, stage, edge)`` start and end marks."""
    us = F.unix_micros("ts")

    def seconds(cond: Column) -> Column:
        span = (F.max(F.when(cond & (F.col("edge") == "end"), us))
                - F.min(F.when(cond & (F.col("edge") == "start"), us)))
        return F.bround(span / 1_000_000, 1)
    return events.groupBy("job_id").agg(
        *[seconds(F.col("stage") == s).alias(s) for s in STAGES],
        seconds(F.lit(True)).alias("total"))


def job_summary(jobs: DataFrame, files: DataFrame, chunks: DataFrame, synthesis: DataFrame,
                outcomes: DataFrame, timings: DataFrame) -> DataFrame:
    """One line per job out of the aggregates of the other tables."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("job_id").agg(F.count(F.lit(1)).alias(name))
    entries = synthesis.groupBy("job_id").agg(
        F.count_if(F.col("part") == "diagnostics").alias("diagnostics"),
        F.count_if(F.col("part") == "incapacites_travail").alias("incapacities"))
    out = jobs
    for df in (count(files, "files"), count(chunks, "chunks"), entries, outcomes, timings):
        out = out.join(df, "job_id", "left")
    return out.na.fill(0, ["files", "chunks", "diagnostics", "incapacities"])


def queue_estimate(jobs: DataFrame, summary: DataFrame) -> DataFrame:
    """Waiting jobs with the recent average in whole minutes."""
    recent = summary.where("form_id IS NULL").select("recent_average_seconds").scalar()
    return (jobs.where("status = 'pending'")
            .withColumn("wait_minutes", F.rint(recent / 60).cast("bigint")))


def field_view(fields: DataFrame, results: DataFrame) -> DataFrame:
    """Every field of a job's form with its result, NULLs where there is none."""
    return (fields.withColumn("section", section_of(F.col("field_id")))
            .join(results, ["job_id", "field_id"], "left"))


DEBUG_COLUMNS = ["job_id", "field_id", "value", "source_quote", "quote_verified", "rerank_score",
                 "grounding", "source_document", "source_page", "error"]


def debug_view(results: DataFrame) -> DataFrame:
    return results.select(*DEBUG_COLUMNS)


def section_view(view: DataFrame) -> DataFrame:
    """Fields and filled fields per section, sections in numeric order per job."""
    section = F.coalesce(F.nullif("section", F.lit("")), F.lit("Autres"))
    return (view.groupBy("job_id", section.alias("section"))
            .agg(F.count(F.lit(1)).alias("fields"),
                 F.count_if(F.coalesce(F.length("value") > 0, F.lit(False))).alias("filled"))
            .withColumn("section_no", F.col("section").try_cast("int")))


def grounding_distribution(view: DataFrame) -> DataFrame:
    """Count and percent of the filled fields per verdict, in fixed order, of each job."""
    filled = view.where(F.length("value") > 0)
    counts = filled.groupBy("job_id", "grounding").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("job_id"))
    place = F.array_position(F.array(*[F.lit(v) for v in fixed.VERDICTS]), F.col("grounding"))
    return (counts.withColumn("percent", F.rint(100 * F.col("n") / total).cast("bigint"))
            .withColumn("place", F.when(place > 0, place).otherwise(len(fixed.VERDICTS) + 1)))


def doubtful(view: DataFrame) -> DataFrame:
    return view.where((F.length("value") > 0) & (F.col("grounding") == "unverified"))


def verified_samples(view: DataFrame, n: int = fixed.VERIFIED_SAMPLES) -> DataFrame:
    """Up to ``n`` verified fields with an excerpt per job, in form order."""
    w = W.partitionBy("job_id").orderBy("ord")
    return (view.where((F.col("grounding") == "verified") & (F.length("value") > 0)
                       & (F.length("source_excerpt") > 0))
            .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"))


def job_status(events: DataFrame, now: Column) -> DataFrame:
    """Latest state per job: ``events(job_id, event_no, ts, status, message, progress)``."""
    latest = F.max_by(F.struct("status", "message", "progress", "ts"), F.struct("ts", "event_no"))
    us = F.unix_micros
    started, ended = us("started_at"), us("_l.ts")
    done = F.col("_l.status").isin("completed", "failed")
    return (events.groupBy("job_id").agg(latest.alias("_l"), F.min("ts").alias("started_at"))
            .select("job_id", "_l.status", "_l.message", "_l.progress",
                    F.bround((us(now) - started) / 1_000_000, 1).alias("elapsed_s"),
                    F.when(done, F.bround((ended - started) / 1_000_000, 1)).alias("duration_s")))
