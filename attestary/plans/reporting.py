"""Report plans: users are jobs, event types forms or stages, values seconds."""

from pyspark.sql import DataFrame, functions as F

from attestary.operators import reports as R
from attestary.plans.registry import Source, plain, query

RUNS = """
SELECT event_id AS log_no, event_type AS form_id, user_id % 4 AS documents, CASE WHEN value > 480 THEN NULL ELSE value END AS seconds FROM {events}"""
SUMMARY = f"""
WITH r AS ({plain(RUNS)}),
p AS (SELECT form_id, avg(seconds) AS rec FROM (SELECT * FROM r WHERE seconds IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY form_id ORDER BY log_no DESC) <= 20) x GROUP BY form_id
  UNION ALL SELECT NULL, avg(seconds) FROM (SELECT * FROM r WHERE seconds IS NOT NULL ORDER BY log_no DESC LIMIT 20) y),
t AS (SELECT form_id, count(seconds) AS runs, sum(seconds) AS s, sum(documents) AS d, arg_max(seconds, log_no) FILTER (WHERE seconds IS NOT NULL) AS last FROM r GROUP BY form_id
  UNION ALL SELECT NULL, count(seconds), sum(seconds), sum(documents), arg_max(seconds, log_no) FILTER (WHERE seconds IS NOT NULL) FROM r),
o AS (SELECT t.form_id, runs, round_even(s / runs, 1) AS average_seconds, round_even(rec, 1) AS recent_average_seconds,
  round_even(s / nullif(d, 0), 1) AS average_seconds_per_document, last AS last_seconds FROM t JOIN p ON t.form_id IS NOT DISTINCT FROM p.form_id)"""


@query("run_summary", f"{SUMMARY} SELECT * FROM o")
def run_summary(s: Source) -> DataFrame:
    return R.run_summary(s.shape(RUNS))


JOBS = """SELECT user_id AS job_id, CASE max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) WHEN 2 THEN
  CASE WHEN count(*) < 66 THEN 'pending' ELSE 'processing' END ELSE 'completed' END AS status FROM {events} GROUP BY user_id"""


@query("queue_estimate", f"""
{SUMMARY} SELECT job_id, status, (SELECT CAST(round_even(recent_average_seconds / 60, 0) AS BIGINT) FROM o WHERE form_id IS NULL) AS wait_minutes
FROM ({plain(JOBS)}) j WHERE status = 'pending'""")
def queue_estimate(s: Source) -> DataFrame:
    return R.queue_estimate(s.shape(JOBS), R.run_summary(s.shape(RUNS)))


EVENTS = """
SELECT user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'ocr_embed' WHEN 'click' THEN 'synthesis' WHEN 'purchase' THEN 'extraction' WHEN 'signup' THEN 'injection' ELSE 'note' END AS stage,
  CASE WHEN value < 250 THEN 'start' ELSE 'end' END AS edge FROM {events}"""


def span(cond: str) -> str:
    return f"""round_even((epoch_us(max(ts) FILTER (WHERE {cond} AND edge = 'end')) - epoch_us(min(ts) FILTER (WHERE {cond} AND edge = 'start'))) / 1000000, 1)"""


TIMINGS = f"SELECT job_id, {', '.join(span(chr(115) + 'tage = ' + repr(x)) + ' AS ' + x for x in R.STAGES)}, {span('true')} AS total FROM ({plain(EVENTS)}) e GROUP BY job_id"


def events(s: Source) -> DataFrame:
    return s.shape(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stage_timings", TIMINGS)
def stage_timings(s: Source) -> DataFrame:
    return R.stage_timings(events(s))


JOB_FORMS = "SELECT DISTINCT user_id AS job_id, user_id % 7 AS form_no FROM {events}"
FILES = "SELECT user_id AS job_id, event_id FROM {events} WHERE event_type = 'view'"
CHUNKS = "SELECT o_custkey AS job_id, o_orderkey FROM {orders}"
ENTRIES = "SELECT o_custkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'diagnostics' WHEN o_orderstatus = 'O' THEN 'incapacites_travail' ELSE 'x' END AS part FROM {orders}"
OUTCOMES = """SELECT c_custkey AS job_id, CAST(c_nationkey AS BIGINT) AS ok, CAST(c_nationkey % 3 AS BIGINT) AS errors FROM {customer}"""


@query("job_summary", f"""
SELECT j.job_id, form_no, coalesce(f.n, 0) AS files, coalesce(c.n, 0) AS chunks, coalesce(d, 0) AS diagnostics, coalesce(i, 0) AS incapacities, ok, errors, total
FROM ({plain(JOB_FORMS)}) j LEFT JOIN (SELECT job_id, count(*) AS n FROM ({plain(FILES)}) a GROUP BY 1) f ON j.job_id = f.job_id
LEFT JOIN (SELECT job_id, count(*) AS n FROM ({plain(CHUNKS)}) a GROUP BY 1) c ON j.job_id = c.job_id
LEFT JOIN (SELECT job_id, count(*) FILTER (WHERE part = 'diagnostics') AS d, count(*) FILTER (WHERE part LIKE 'inc%') AS i FROM ({plain(ENTRIES)}) a GROUP BY 1) e ON j.job_id = e.job_id
LEFT JOIN ({plain(OUTCOMES)}) o ON j.job_id = o.job_id LEFT JOIN ({TIMINGS}) t ON j.job_id = t.job_id""")
def job_summary(s: Source) -> DataFrame:
    out = R.job_summary(s.shape(JOB_FORMS), s.shape(FILES), s.shape(CHUNKS), s.shape(ENTRIES),
                        s.shape(OUTCOMES), R.stage_timings(events(s)).select("job_id", "total"))
    return out


VIEW_FIELDS = "SELECT source AS job_id, concat(CAST(doc_id % 12 AS STRING), '.', CAST(doc_id AS STRING)) AS field_id, lang AS label FROM {documents}"
VIEW_RESULTS = """SELECT source AS job_id, concat(CAST(doc_id % 12 AS STRING), '.', CAST(doc_id AS STRING)) AS field_id,
  CASE WHEN quality = 1 THEN 'v' ELSE '' END AS value, toxic FROM {labels} JOIN {documents} USING (doc_id)"""
VIEW = f"SELECT f.*, split_part(f.field_id, '.', 1) AS section, value, CAST(toxic AS BIGINT) AS toxic FROM ({plain(VIEW_FIELDS)}) f LEFT JOIN ({plain(VIEW_RESULTS)}) r ON f.job_id = r.job_id AND f.field_id = r.field_id"


def view(s: Source) -> DataFrame:
    return R.field_view(s.shape(VIEW_FIELDS), s.shape(VIEW_RESULTS))


@query("field_view", VIEW)
def field_view(s: Source) -> DataFrame:
    return view(s).withColumn("toxic", F.col("toxic").cast("bigint"))


@query("section_view", f"""
SELECT job_id, section, count(*) AS fields, count(*) FILTER (WHERE value <> '') AS filled, CAST(section AS BIGINT) AS section_no FROM ({VIEW}) v GROUP BY job_id, section""")
def section_view(s: Source) -> DataFrame:
    return R.section_view(view(s)).withColumn("section_no", F.col("section_no").cast("bigint"))


STATUS_EVENTS = """
SELECT CAST(user_id AS STRING) AS job_id, event_id AS event_no, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
  WHEN 'signup' THEN 'failed' ELSE 'processing' END AS status, props AS message, CAST(floor(value / 5) AS INT) AS progress FROM {events}"""
STATUS = f"""
SELECT job_id, arg_max(status, struct_pack(a := ts, b := event_no)) AS status, arg_max(message, struct_pack(a := ts, b := event_no)) AS message, arg_max(progress, struct_pack(a := ts, b := event_no)) AS progress, min(ts) AS started, max(ts) AS ended
FROM ({plain(STATUS_EVENTS)}) e GROUP BY job_id"""


def status_events(s: Source) -> DataFrame:
    return s.shape(STATUS_EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


@query("job_status", f"""
SELECT job_id, status, message, progress, round_even((epoch_us((SELECT max(ts) FROM events)) - epoch_us(started)) / 1000000, 1) AS elapsed_s,
  CASE WHEN status IN ('completed', 'failed') THEN round_even((epoch_us(ended) - epoch_us(started)) / 1000000, 1) END AS duration_s FROM ({STATUS}) x""")
def job_status(s: Source) -> DataFrame:
    now = s.table("events").agg(F.max("ts").cast("timestamp")).scalar()
    return R.job_status(status_events(s), now)
