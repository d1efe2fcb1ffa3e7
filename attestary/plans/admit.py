"""Admission and filter plans."""

from pyspark.sql import DataFrame, functions as F

from attestary.operators import admission as A
from attestary.plans.registry import Source, plain, query

UPLOADS = """
SELECT split_part(url, '/', 3) AS job_id, page_id AS file_no,
       concat(CASE WHEN url LIKE '%#top' THEN '/..' ELSE '' END) AS tail, url,
       CASE WHEN url LIKE 'https%' THEN '%PDF' ELSE substr(html, 1, 4) END AS head,
       CAST(length(html) AS BIGINT) * 4000 AS size
FROM {pages}"""
NAMED = f"SELECT job_id, file_no, concat(url, tail) AS name, head, size FROM ({UPLOADS}) u"

SAFE = """CASE WHEN name LIKE '%/..' THEN '..' ELSE
  list_extract(list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.')), -1) END"""
REASON = f"""CASE WHEN size > 52428800 THEN 'too_large' WHEN head <> '%PDF' THEN 'not_pdf'
  WHEN {SAFE} = '..' THEN 'bad_name' END"""


@query("upload_screen", f"""
WITH f AS (SELECT *, {REASON} AS reason FROM ({plain(NAMED)}) x)
SELECT job_id, count(reason) = 0 AS accepted,
       arg_min(reason, file_no) FILTER (WHERE reason IS NOT NULL) AS reason
FROM f GROUP BY job_id""")
def upload_screen(s: Source) -> DataFrame:
    return A.screen_uploads(s.shape(NAMED))


@query("upload_names", f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY job_id, name ORDER BY file_no) AS n
           FROM ({plain(NAMED)}) x)
SELECT job_id, file_no, {SAFE} AS safe_name, {REASON} AS reason FROM f WHERE n = 1""")
def upload_names(s: Source) -> DataFrame:
    files = A.file_verdict(A.dedupe_files(s.shape(NAMED)))
    return files.select("job_id", "file_no", "safe_name", "reason")


REQUESTS = "SELECT event_id AS job_id, event_type AS form_id, CAST(floor(value) AS BIGINT) AS n_files FROM {events}"
KNOWN = "SELECT DISTINCT event_type AS form_id FROM {events} WHERE event_type <> 'error'"
JOBS = """
SELECT user_id AS job_id, max(ts) AS completed_at,
       CASE max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END)
         WHEN 0 THEN 'pending' WHEN 1 THEN 'processing'
         ELSE CASE WHEN count(*) > 66 THEN 'completed' ELSE 'failed' END END AS status
FROM {events} GROUP BY user_id"""


@query("job_admission", f"""
WITH a AS (SELECT count(*) AS n FROM ({plain(JOBS)}) j WHERE status IN ('pending', 'processing')),
r AS (SELECT r.*, CASE WHEN k.form_id IS NULL THEN 'unknown_form'
        WHEN (SELECT n FROM a) >= 20 THEN 'saturated'
        WHEN n_files > 200 THEN 'too_many_files' END AS reason
      FROM ({plain(REQUESTS)}) r LEFT JOIN ({plain(KNOWN)}) k ON r.form_id = k.form_id)
SELECT job_id, form_id, n_files, reason, reason IS NULL AS admitted FROM r""")
def job_admission(s: Source) -> DataFrame:
    return A.admit_jobs(s.shape(REQUESTS), s.shape(JOBS), s.shape(KNOWN))


@query("expired_jobs", f"""
WITH j AS ({plain(JOBS)})
SELECT job_id, status FROM j WHERE status IN ('completed', 'failed')
  AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(completed_at) > 3600000000""")
def expired_jobs(s: Source) -> DataFrame:
    jobs = s.shape(JOBS).withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    now = s.table("events").agg(F.max("ts").cast("timestamp")).scalar()
    return A.expired_jobs(jobs, now).select("job_id", "status")


TEMPLATES = "SELECT p_partkey AS form_id, p_size > 10 AS reviewed FROM {part}"
BLANKS = "SELECT l_partkey AS form_id FROM {lineitem} WHERE l_returnflag = 'R'"


@query("publishable_forms", f"""
SELECT DISTINCT form_id FROM ({plain(TEMPLATES)}) t
WHERE reviewed AND form_id IN (SELECT form_id FROM ({plain(BLANKS)}) b)""")
def publishable_forms(s: Source) -> DataFrame:
    return A.publishable_forms(s.shape(TEMPLATES), s.shape(BLANKS))


FIELDS = """
SELECT p_type AS form_id, p_partkey AS field_id,
       CASE WHEN p_size < 5 THEN '  ' WHEN p_size < 8 THEN NULL ELSE p_name END AS question,
       CASE WHEN p_brand = 'Brand#3' THEN 'fixed' END AS preset,
       CASE WHEN p_brand = 'Brand#4' THEN '' WHEN p_brand = 'Brand#5' THEN 'sum' END AS computed
FROM {part}"""


@query("extractable_fields", f"""
SELECT form_id, field_id, question FROM ({plain(FIELDS)}) f
WHERE trim(coalesce(question, '')) <> '' AND coalesce(preset, '') = '' AND coalesce(computed, '') = ''""")
def extractable_fields(s: Source) -> DataFrame:
    return A.extractable_fields(s.shape(FIELDS)).select("form_id", "field_id", "question")


@query("chat_history", """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) - 1 <= 40
             AND length(last_value(text) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) <= 2000 AS within_limits
           FROM conversations)
SELECT conv_id, turn, role, length(text) AS chars, within_limits FROM c
WHERE role IN ('user', 'assistant') AND text <> ''""")
def chat_history(s: Source) -> DataFrame:
    kept = A.chat_history(s.table("conversations"))
    return kept.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"),
                       "within_limits")


NODES = """
SELECT p_brand AS form_id, p_partkey AS canon,
       CASE WHEN p_size = 7 THEN 'pageNumber' ELSE p_name END AS name,
       CASE WHEN p_size IN (3, 4) THEN 'signature' ELSE 'textEdit' END AS ui,
       p_type = 'PROMO' AS readonly
FROM {part}"""
WIDGETS = """
SELECT p_brand AS form_id, p_partkey AS canon, p_name AS widget FROM {part}
WHERE p_type IN ('SMALL', 'LARGE', 'MEDIUM') AND p_size > 12"""
STATES = f"""
SELECT n.form_id, n.canon, CASE WHEN ui = 'signature' OR readonly OR name = 'pageNumber' THEN 'skipped'
  WHEN widget IS NULL THEN 'unmatched' ELSE 'fillable' END AS state
FROM ({plain(NODES)}) n LEFT JOIN ({plain(WIDGETS)}) w ON n.form_id = w.form_id AND n.canon = w.canon"""


@query("fillable_nodes", STATES)
def fillable_nodes(s: Source) -> DataFrame:
    return A.fillable_nodes(s.shape(NODES), s.shape(WIDGETS)).select("form_id", "canon", "state")


@query("coverage_gate", f"""
WITH g AS (SELECT form_id, count(*) FILTER (WHERE state = 'fillable') AS fillable,
             count(*) FILTER (WHERE state = 'unmatched') AS unmatched FROM ({STATES}) x GROUP BY form_id)
SELECT *, fillable > 0 AND fillable / (fillable + unmatched) >= 0.5 AS accepted FROM g""")
def coverage_gate(s: Source) -> DataFrame:
    return A.coverage_gate(A.fillable_nodes(s.shape(NODES), s.shape(WIDGETS)))
