"""Readers: templates, dossiers, uploads, expected values, run logs, catalogue lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from attestary.functions.text import WS, strip
from attestary.sources import schemas

_FILE = "_metadata.file_name"


def _form_id() -> Column:
    stem = F.regexp_replace(F.col(_FILE), r"\.json$", "")
    return F.replace(stem, F.lit("Form_"), F.lit(""))


def _template_files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("multiLine", True).option("pathGlobFilter", "Form_*.json")
            .option("columnNameOfCorruptRecord", "_corrupt").schema(schemas.TEMPLATE).json(path)
            .withColumn("form_id", _form_id()).where("_corrupt IS NULL AND fields IS NOT NULL"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """One row per field of every readable template; separators are left out."""
    files = _template_files(spark, path)
    return (files.select("form_id", F.coalesce("_reviewed", F.lit(True)).alias("reviewed"),
                         F.posexplode("fields").alias("ord", "f"))
            .where("f.id IS NOT NULL")
            .select("form_id", "reviewed", "ord", F.col("f.id").alias("field_id"), "f.name",
                    "f.label", "f.question", "f.required", "f.xml_path", "f.acroform_name",
                    "f.type", "f.options", "f.option_values", "f.preset", "f.computed"))


def read_canton_tables(spark: SparkSession, path: str) -> DataFrame:
    """``(form_id, canton, name, value)`` of the templates that carry a recipient per canton."""
    return (_template_files(spark, path)
            .select("form_id", F.explode("_recipient_by_canton").alias("canton", "t"))
            .select("form_id", "canton", F.explode("t").alias("name", "value")))


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    """``<job>/NN_name.md`` files, one text per row, ordered by NN."""
    name = r"([0-9]+)_[^/]*\.md$"
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
            .text(path, wholetext=True)
            .select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("job_id"),
                    F.regexp_extract(_FILE, name, 1).try_cast("bigint").alias("doc_no"),
                    F.col(_FILE).alias("filename"), F.col("value").alias("markdown"))
            .where("doc_no IS NOT NULL"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """``<job>/file`` bytes, numbered by name within the job.

    Names are numbered first and meet the contents afterwards: no bytes are sorted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    job, name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    n = F.row_number().over(W.partitionBy("job_id").orderBy("name")) - 1
    numbered = (files.select("path", job.alias("job_id"), name.alias("name"))
                .withColumn("file_no", n))
    contents = files.select("path", F.substring("content", 1, 4).cast("string").alias("head"),
                            F.col("length").alias("size"), "content")
    return (numbered.join(contents, "path")
            .select("job_id", "name", "head", "size", "content", "file_no"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("multiLine", True).schema(schemas.GROUND_TRUTH).json(path)
            .select(F.col("_meta.form_id").alias("form_id"),
                    F.explode("fields").alias("field_id", "t"))
            .select("form_id", "field_id", "t.expected",
                    F.coalesce("t.tolerance", F.lit("exact")).alias("tolerance"),
                    F.coalesce("t.category", F.lit("")).alias("category"), "t.keywords"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run log with ``log_no``, the order of its lines; blank and truncated lines are dropped, a missing
    log is empty.

    Appends count in the order they were made, and the files of one append, which share its identifier, by
    their part number, whichever was finished first. Within a file a line's number is where its block
    begins plus its place in the block, as no line is shorter than a byte.
    """
    try:
        rows = spark.read.schema(schemas.RUNS).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.RUNS + ", log_no bigint")
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("_t"),
                       F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                       F.monotonically_increasing_id().alias("_r"))
    rows = rows.where("ts IS NOT NULL OR form_id IS NOT NULL OR seconds IS NOT NULL")
    # one row per file of the log
    append = F.coalesce(F.nullif(F.regexp_extract("_f", r"part-\d+-([0-9a-f-]{36})", 1), F.lit("")), F.col("_f"))
    files = rows.select("_t", "_f").distinct().withColumn("_a", F.min("_t").over(W.partitionBy(append)))
    files = files.select("_f", F.row_number().over(W.orderBy("_a", append, "_f")).alias("_n"))
    place = F.col("_b") + F.col("_r") - F.min("_r").over(W.partitionBy("_f", "_b"))
    return (rows.withColumn("_p", place).join(files, "_f")
            .withColumn("log_no", F.col("_n") * F.lit(2 ** 40) + F.col("_p"))
            .drop("_t", "_f", "_b", "_r", "_n", "_p"))


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``code, form_id`` entries, rejected lines)."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"))
    lines = lines.where("line <> '' AND NOT startswith(line, '#')")
    parts = F.split("line", WS + "+", -1)
    entries = (lines.where(F.size(parts) == 2)
               .select(parts[0].alias("code"), parts[1].alias("form_id")))
    return entries, lines.where(F.size(parts) != 2)
