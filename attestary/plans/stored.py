"""Sources and sinks: the tables written by a writer and read back."""

from pyspark.sql import DataFrame, functions as F

from attestary.operators import reports as R, templates as D
from attestary.operators.numbering import number_rows
from attestary.plans.registry import Source, plain, query
from attestary.plans.reporting import RUNS as REPORTED, SUMMARY
from attestary.session import shared_dir
from attestary.sources import readers, writers

CHUNKS = "SELECT source AS job_id, doc_id AS chunk_no, text FROM {documents}"


@query("stored_chunks", f"SELECT job_id, chunk_no, md5(text) AS digest FROM ({plain(CHUNKS)}) c")
def stored_chunks(s: Source) -> DataFrame:
    path = shared_dir(s.spark, "chunks")
    writers.write_chunks(s.shape(CHUNKS), path)
    return writers.read_chunks(s.spark, path).select("job_id", "chunk_no", F.md5("text").alias("digest"))


@query("stored_job_chunks", f"""
SELECT chunk_no, md5(text) AS digest FROM ({plain(CHUNKS)}) c WHERE job_id = (SELECT max(source) FROM documents)""")
def stored_job_chunks(s: Source) -> DataFrame:
    """One job's chunks: its bucket alone is read."""
    path = shared_dir(s.spark, "chunks")
    writers.write_chunks(s.shape(CHUNKS), path)
    job = s.table("documents").agg(F.max("source")).first()[0]
    return writers.read_chunks(s.spark, path, job).select("chunk_no", F.md5("text").alias("digest"))


RUNS = """SELECT event_id, ts, event_type AS form_id, user_id % 4 AS documents, value AS seconds,
  CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM {events}"""


def run_log(s: Source) -> DataFrame:
    """Two appends, each sorted: the earlier half of the events, then the later one."""
    path = shared_dir(s.spark, "runs")
    runs = s.shape(RUNS)
    for later in (False, True):
        writers.append_runs(runs.where((F.col("event_id") % 2 == 1) == F.lit(later)).orderBy("event_id"), path)
    return readers.read_runs(s.spark, path)


LOGGED = f"""
l AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS ts, form_id, documents, round_even(seconds, 1) AS seconds,
  row_number() OVER (ORDER BY event_id % 2, event_id) AS log_no FROM ({plain(RUNS)}) r WHERE status = 'completed')"""


@query("stored_runs", f"WITH {LOGGED} SELECT ts, form_id, documents, seconds, log_no AS line FROM l")
def stored_runs(s: Source) -> DataFrame:
    """Every line of the log with its place in it."""
    log = number_rows(run_log(s).withColumn("_all", F.lit(0)), ["_all"], "log_no", "line")
    return log.select("ts", "form_id", "documents", "seconds", (F.col("line") + 1).alias("line"))


@query("stored_run_summary", f"{SUMMARY.replace(f'r AS ({plain(REPORTED)})', LOGGED.strip() + ', r AS (SELECT * FROM l)')} SELECT * FROM o")
def stored_run_summary(s: Source) -> DataFrame:
    """All figures, those of the last runs included: the log keeps its order."""
    return R.run_summary(run_log(s))


RESULTS = "SELECT o_orderstatus AS form_id, o_custkey AS job_id, o_orderkey AS field_id, o_orderpriority AS value FROM {orders}"


@query("stored_results", plain(RESULTS))
def stored_results(s: Source) -> DataFrame:
    path = shared_dir(s.spark, "results")
    writers.write_results(s.shape(RESULTS), path)
    return s.spark.read.parquet(path).select("form_id", "job_id", "field_id", "value")


REPORT = "SELECT p_brand AS form_id, p_partkey AS ord, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS question, CAST(NULL AS STRING) AS computed FROM {part}"


@query("stored_report", f"""
SELECT form_id, count(*) AS fields, count(*) FILTER (WHERE question <> '') AS written FROM ({plain(REPORT)}) f GROUP BY ROLLUP (form_id)""")
def stored_report(s: Source) -> DataFrame:
    path = shared_dir(s.spark, "report")
    writers.write_report(D.catalog_report(s.shape(REPORT)), path)
    return s.spark.read.json(path, "form_id string, fields bigint, written bigint").select("form_id", "fields", "written")


LISTED = """SELECT CASE p_size % 6 WHEN 0 THEN '# a remark' WHEN 1 THEN '  ' WHEN 2 THEN concat(p_brand, ' with a remark') WHEN 3 THEN 'alone'
  ELSE concat(' ', CAST(p_partkey AS STRING), chr(9), ' ', replace(p_name, ' ', '_'), ' ') END AS line FROM {part}"""


def _catalog(s: Source) -> tuple[DataFrame, DataFrame]:
    path = shared_dir(s.spark, "catalog")
    s.shape(LISTED).write.text(path)
    return readers.read_catalog(s.spark, path)


@query("stored_catalog", "SELECT CAST(p_partkey AS VARCHAR) AS code, replace(p_name, ' ', '_') AS form_id FROM part WHERE p_size % 6 > 3")
def stored_catalog(s: Source) -> DataFrame:
    """The entries of a catalogue list; remarks and blank lines are none."""
    return _catalog(s)[0]


@query("rejected_catalog_lines", f"SELECT line FROM ({plain(LISTED)}) l WHERE line LIKE '%with a remark' OR line = 'alone'")
def rejected_catalog_lines(s: Source) -> DataFrame:
    return _catalog(s)[1]


TRUTH = """SELECT p_brand AS form_id, concat(CAST(p_partkey % 7 AS STRING), '.', CAST(p_partkey AS STRING)) AS field_id, p_name AS expected,
  CASE p_size % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'date' END AS tolerance, CASE WHEN p_size > 20 THEN p_type END AS category,
  split_part(p_name, ' ', 1) AS word FROM {part}"""


@query("stored_ground_truth", f"""
SELECT form_id, field_id, expected, coalesce(tolerance, 'exact') AS tolerance, coalesce(category, '') AS category,
  CASE WHEN tolerance = 'contains' THEN word ELSE '' END AS keywords FROM ({plain(TRUTH)}) t""")
def stored_ground_truth(s: Source) -> DataFrame:
    """One file of expected values per form, written as JSON and read back as rows."""
    path = shared_dir(s.spark, "truth")
    keywords = F.when(F.col("tolerance") == "contains", F.array("word")).otherwise(F.array().cast("array<string>"))
    entry = F.struct("expected", "tolerance", "category", keywords.alias("keywords"))
    forms = s.shape(TRUTH).groupBy("form_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", entry))).alias("fields"))
    text = F.to_json(F.struct(F.struct("form_id").alias("_meta"), "fields"))
    forms.select(F.col("form_id").alias("form"), text.alias("value")).repartition("form").write.partitionBy("form").text(path)
    return readers.read_ground_truth(s.spark, path).withColumn("keywords", F.array_join("keywords", " "))
