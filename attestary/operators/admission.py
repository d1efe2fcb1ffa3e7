"""Filters and admission rules: which files, jobs, forms, fields and messages go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestary import fixed
from attestary.functions.paths import safe_filename
from attestary.functions.text import strip


def file_verdict(files: DataFrame) -> DataFrame:
    """``files(job_id, file_no, name, size, head)`` with the first rule each file breaks."""
    safe = safe_filename(F.col("name"), F.col("file_no"))
    reason = (F.when(F.col("size") > fixed.MAX_FILE_BYTES, "too_large")
              .when(F.col("head") != "%PDF", "not_pdf")
              .when(safe == "..", "bad_name"))
    return files.withColumn("safe_name", safe).withColumn("reason", reason)


def screen_uploads(files: DataFrame) -> DataFrame:
    """One row per job; the lowest-numbered bad file rejects the whole job."""
    first_bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("file_no", "reason")))
    return (file_verdict(files).groupBy("job_id").agg(first_bad.alias("bad"))
            .select("job_id", F.col("bad").isNull().alias("accepted"),
                    F.col("bad.reason").alias("reason")))


def dedupe_files(files: DataFrame) -> DataFrame:
    """First file of each name in a job, names not yet made safe."""
    w = W.partitionBy("job_id", "name").orderBy("file_no")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def admit_jobs(requests: DataFrame, jobs: DataFrame, forms: DataFrame,
               max_active: int = fixed.MAX_ACTIVE_JOBS) -> DataFrame:
    """Unknown form, then too many active jobs, then too many files."""
    active = (jobs.where(F.col("status").isin("pending", "processing"))
              .agg(F.count(F.lit(1)).alias("n")))
    known = forms.select("form_id").distinct().withColumn("known", F.lit(True))
    reason = (F.when(F.col("known").isNull(), "unknown_form")
              .when(active.scalar() >= max_active, "saturated")
              .when(F.col("n_files") > fixed.MAX_FILES, "too_many_files"))
    return (requests.join(known, "form_id", "left").withColumn("reason", reason)
            .withColumn("admitted", F.col("reason").isNull()).drop("known"))


def expired_jobs(jobs: DataFrame, now: Column, ttl: int = fixed.RETENTION_SECONDS) -> DataFrame:
    age = F.unix_micros(now) - F.unix_micros("completed_at")
    return jobs.where(F.col("status").isin("completed", "failed") & (age > ttl * 1_000_000))


def publishable_forms(templates: DataFrame, blanks: DataFrame,
                      show_drafts: bool = False) -> DataFrame:
    """``templates(form_id, reviewed)`` that are reviewed and have a blank form."""
    kept = templates if show_drafts else templates.where("reviewed")
    return kept.select("form_id").distinct().join(blanks, "form_id", "left_semi")


def extractable_fields(fields: DataFrame) -> DataFrame:
    def unset(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""
    return fields.where((strip(F.coalesce("question", F.lit(""))) != "")
                        & unset("preset") & unset("computed"))


def chat_history(messages: DataFrame) -> DataFrame:
    """User and assistant turns with text, and whether the request keeps the size limits.

    The turn limit counts the history as sent, before the filter.
    """
    size = messages.groupBy("conv_id").agg(
        (F.count(F.lit(1)) - 1).alias("_turns"), F.max_by(F.length("text"), "turn").alias("_chars"))
    within = (F.col("_turns") <= fixed.MAX_CHAT_TURNS) & (F.col("_chars") <= fixed.MAX_CHAT_CHARS)
    return (messages.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0))
            .join(size, "conv_id").withColumn("within_limits", within)
            .drop("_turns", "_chars"))


def nonblank_docs(docs: DataFrame, col: str = "markdown") -> DataFrame:
    return docs.where(strip(F.col(col)) != "")


def fillable_nodes(nodes: DataFrame, widgets: DataFrame,
                   technical: list[str] = fixed.TECHNICAL_NAMES) -> DataFrame:
    """Every node with ``state`` skipped, unmatched or fillable, and its widget name.

    ``nodes(form_id, canon, name, ui, readonly, ...)``, ``widgets(form_id, canon, widget)``.
    """
    skipped = (F.col("ui").isin(fixed.UNFILLABLE_UI) | F.col("readonly")
               | F.col("name").isin(technical))
    state = (F.when(skipped, "skipped").when(F.col("widget").isNull(), "unmatched")
             .otherwise("fillable"))
    return nodes.join(widgets, ["form_id", "canon"], "left").withColumn("state", state)


def coverage_gate(states: DataFrame, minimum: float = fixed.MIN_COVERAGE) -> DataFrame:
    n_fill = F.count_if(F.col("state") == "fillable")
    n_miss = F.count_if(F.col("state") == "unmatched")
    return (states.groupBy("form_id").agg(n_fill.alias("fillable"), n_miss.alias("unmatched"))
            .withColumn("accepted", (F.col("fillable") > 0) &
                        (F.col("fillable") / (F.col("fillable") + F.col("unmatched")) >= minimum)))
