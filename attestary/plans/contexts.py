"""Batch, synthesis, prompt, chat and response plans."""

from pyspark.sql import DataFrame, functions as F

from attestary.functions.text import strip
from attestary.operators import admission as A, context as B, responses as J
from attestary.plans.registry import Source, plain, query
from attestary.plans.texts import DOCS
from attestary.session import shared_dir, stage

FIELDS = """
SELECT p_brand AS form_id, p_partkey AS ord, concat(CAST((p_partkey * 7) % 11 AS STRING), '.', CAST(p_partkey AS STRING)) AS field_id,
  concat('Quel est ', p_name, ' ?') AS question, CASE WHEN p_size % 3 = 0 THEN 'choice' ELSE 'str' END AS type, p_type AS opt
FROM {part}"""
BATCHES = f"""
WITH f AS (SELECT *, split_part(field_id, '.', 1) AS section FROM ({plain(FIELDS)}) x),
g AS (SELECT *, min(ord) OVER (PARTITION BY form_id, section) AS first,
  (row_number() OVER (PARTITION BY form_id, section ORDER BY ord) - 1) // 7 AS cut FROM f),
b AS (SELECT *, dense_rank() OVER (PARTITION BY form_id ORDER BY first, cut) - 1 AS batch_no FROM g)"""


@query("batches", f"{BATCHES} SELECT form_id, field_id, section, batch_no FROM b")
def batches(s: Source) -> DataFrame:
    return B.batch_fields(s.shape(FIELDS)).select("form_id", "field_id", "section", "batch_no")


SYNTHESIS = """
SELECT c_custkey AS job_id, CAST(c_custkey % 12 AS STRING) AS section,
  concat('{{"patient": {{"nom":"', c_name, '"}}, "canton_traitement": "', CASE WHEN c_nationkey < 5 THEN '' ELSE 'VD' END,
    '", "diagnostics": ', CASE WHEN c_acctbal < 3000 THEN '[]' ELSE '[{{"code":"M54"}}]' END, ', "pronostic": ',
    CASE WHEN c_acctbal < 5000 THEN 'null' ELSE '"bon"' END, '}}') AS synthesis
FROM {customer}"""
PARTS = """CASE section WHEN '1' THEN ['canton_traitement', 'patient'] WHEN '2' THEN ['patient', 'medecins']
  WHEN '3' THEN ['incapacites_travail', 'dates_cles'] WHEN '4' THEN ['diagnostics', 'traitements'] WHEN '5' THEN ['incapacites_travail', 'pronostic']
  WHEN '6' THEN ['incapacites_travail', 'traitements'] WHEN '7' THEN ['medecins'] WHEN '8' THEN ['diagnostics', 'traitements']
  WHEN '9' THEN ['medecins'] WHEN '10' THEN ['pronostic'] ELSE ['canton_traitement', 'diagnostics', 'patient', 'pronostic'] END"""


@query("synthesis_slice", f"""
WITH s AS (SELECT *, unnest({PARTS}) AS k, generate_subscripts({PARTS}, 1) AS pos FROM ({plain(SYNTHESIS)}) x),
v AS (SELECT job_id, section, k, pos, CAST(json_extract(synthesis, '$.' || k) AS VARCHAR) AS v FROM s),
g AS (SELECT job_id, '{{' || string_agg('"' || k || '": ' || v, ', ' ORDER BY pos) || '}}' AS part FROM v
  WHERE v NOT IN ('null', '""', '[]', '{{}}') GROUP BY job_id)
SELECT x.job_id, section, part FROM ({plain(SYNTHESIS)}) x LEFT JOIN g ON x.job_id = g.job_id""".replace("{{", "{").replace("}}", "}"))
def synthesis_slice(s: Source) -> DataFrame:
    return s.shape(SYNTHESIS).select("job_id", "section", B.synthesis_slice(
        F.col("synthesis"), F.col("section")).alias("part"))


CONTEXTS = """
SELECT concat('Brand#', CAST(n_nationkey AS STRING)) AS job_id, CAST(n_nationkey % 5 AS BIGINT) AS batch_no,
  CASE WHEN n_regionkey = 1 THEN NULL ELSE concat('extrait ', n_name) END AS context,
  CASE WHEN n_regionkey = 2 THEN NULL ELSE '[1]' END AS synthesis FROM {nation}"""


@query("prompts", f"""
{BATCHES}, l AS (SELECT form_id AS job_id, batch_no, string_agg('• [' || field_id || '] ' || question || CASE WHEN type = 'choice'
    THEN ' (réponds exactement par l''une de ces valeurs : ' || opt || ' | autre)' ELSE '' END, chr(10) ORDER BY ord) AS lines,
  string_agg('  "' || field_id || '": {{' || chr(10) || '    "value": "...",' || chr(10) || '    "source_quote": "..."' || chr(10) || '  }}', ',' || chr(10) ORDER BY ord) AS slots
  FROM b GROUP BY ALL),
p AS (SELECT l.job_id, l.batch_no, concat_ws(chr(10) || chr(10), 'SYNTHÈSE MÉDICALE (source principale) :' || chr(10) || synthesis,
    'EXTRAITS DE DOCUMENTS (source secondaire) :' || chr(10) || context, 'CHAMPS À EXTRAIRE :' || chr(10) || lines,
    'RÉPONDS UNIQUEMENT avec ce JSON (tous les IDs sont obligatoires) :' || chr(10) || '{{' || chr(10) || slots || chr(10) || '}}') AS prompt
  FROM l LEFT JOIN ({plain(CONTEXTS)}) c ON l.job_id = c.job_id AND l.batch_no = c.batch_no)
SELECT job_id, batch_no, md5(prompt) AS prompt, length(prompt) // 4 AS tokens FROM p""".replace("{{", "{").replace("}}", "}"))
def prompts(s: Source) -> DataFrame:
    fields = B.batch_fields(s.shape(FIELDS)).withColumn("options", F.array(F.col("opt"), F.lit("autre"))) \
        .withColumnRenamed("form_id", "job_id")
    return B.build_prompts(fields, s.shape(CONTEXTS)).select(
        "job_id", "batch_no", F.md5("prompt").alias("prompt"), "tokens")


PLAN = f"""
SELECT job_id, count(*) AS documents, CAST(sum(length('--- DOCUMENT : ' || filename || ' ---' || chr(10) || chr(10)) + length(markdown))
  + (count(*) - 1) * 64 AS BIGINT) AS chars FROM ({plain(DOCS)}) d WHERE trim(markdown) <> '' GROUP BY job_id"""
STRATEGY = f"SELECT *, chars // 4 AS tokens, CASE WHEN chars // 4 <= 28000 THEN 'direct' ELSE 'hierarchical' END AS strategy FROM ({PLAN}) p"


@query("synthesis_plan", STRATEGY)
def synthesis_plan(s: Source) -> DataFrame:
    return B.synthesis_plan(s.shape(DOCS))


@query("synthesis_prompts", f"""
WITH d AS (SELECT d.*, strategy FROM ({plain(DOCS)}) d JOIN ({STRATEGY}) s ON d.job_id = s.job_id WHERE trim(markdown) <> '')
SELECT job_id, NULL AS doc_no, md5(string_agg('--- DOCUMENT : ' || filename || ' ---' || chr(10) || chr(10) || markdown,
  chr(10) || chr(10) || repeat('=', 60) || chr(10) || chr(10) ORDER BY doc_no)) AS prompt FROM d WHERE strategy = 'direct' GROUP BY job_id
UNION ALL SELECT job_id, doc_no, md5('DOCUMENT : ' || filename || chr(10) || chr(10) || 'CONTENU :' || chr(10) || markdown) FROM d WHERE strategy <> 'direct'""")
def synthesis_prompts(s: Source) -> DataFrame:
    docs = s.shape(DOCS)
    out = B.synthesis_prompts(docs, B.synthesis_plan(docs))
    return out.select("job_id", "doc_no", F.md5("prompt").alias("prompt"))


SUMMARIES = """
SELECT source AS job_id, doc_id AS doc_no, concat('doc', CAST(doc_id AS STRING)) AS filename,
  CASE WHEN lang = 'de' THEN NULL ELSE concat('{{"diagnostics": ["', lang, '", "d', CAST(n_chars AS STRING), '"], "traitements": [',
    CASE WHEN n_chars > 1000 THEN '"repos"' ELSE '' END, '], "pronostic": ', CASE WHEN lang = 'fr' THEN 'null' ELSE concat('"p', CAST(doc_id % 3 AS STRING), '"') END, ', "patient": {{"nom": "', source, '"}}, "dates_cles": {{"d": ', CAST(doc_id AS STRING), '}}}}') END AS summary
FROM {documents}"""


@query("merge_summaries", f"""
WITH s AS (SELECT * FROM ({plain(SUMMARIES)}) x WHERE summary IS NOT NULL),
l AS (SELECT job_id, doc_no, filename, p AS part, unnest(CAST(json_extract(summary, '$.' || p) AS VARCHAR[])) AS entry,
    generate_subscripts(CAST(json_extract(summary, '$.' || p) AS VARCHAR[]), 1) - 1 AS entry_no FROM s, (VALUES ('diagnostics'), ('traitements')) v(p))
SELECT job_id, part, doc_no, filename AS document_source, entry_no, entry FROM l
UNION ALL SELECT job_id, 'pronostic', doc_no, filename, 0, json_extract_string(summary, '$.pronostic') FROM s
WHERE json_extract_string(summary, '$.pronostic') IS NOT NULL
UNION ALL SELECT job_id, p, doc_no, filename, 0, CAST(json_extract(summary, '$.' || p) AS VARCHAR) FROM s, (VALUES ('patient'), ('dates_cles')) v(p)""")
def merge_summaries(s: Source) -> DataFrame:
    out = B.merge_summaries(s.shape(SUMMARIES))
    return out.withColumn("entry_no", F.col("entry_no").cast("bigint"))


# Whole sources are jobs, beside small ones: some with a single summary, one with failures only.
SUMMED = """SELECT source AS job_id, doc_id AS doc_no, concat('doc', CAST(doc_id AS STRING)) AS filename,
  CASE WHEN lang <> 'de' THEN concat('{{"diagnostics": ["', lang, '", "x"], "patient": {{"n": ', CAST(doc_id AS STRING), '}}, "pronostic": "p"}}') END AS summary
FROM {documents} UNION ALL SELECT CASE WHEN lang = 'de' THEN lang ELSE concat(source, ':', CAST(doc_id % 40 AS STRING)) END, doc_id, concat('doc', CAST(doc_id AS STRING)),
  CASE WHEN lang <> 'de' THEN concat('{{"diagnostics": ["', lang, '", "x"], "patient": {{"n": ', CAST(doc_id AS STRING), '}}, "pronostic": "p"}}') END FROM {documents}"""
PIECE = 3000


@query("synthesis", rf"""
WITH s AS ({plain(SUMMED)}), n AS (SELECT job_id, count(summary) AS n, min(summary) AS sole FROM s GROUP BY ALL),
e AS (SELECT s.job_id, doc_no, filename, unnest(['diagnostics', 'diagnostics', 'patient', 'pronostic']) AS part, unnest([0, 1, 0, 0]) AS entry_no,
  unnest(['"' || json_extract_string(summary, '$.diagnostics[0]') || '"', '"x"', CAST(summary->'patient' AS VARCHAR), '"p"']) AS entry
  FROM s JOIN n ON s.job_id = n.job_id WHERE summary IS NOT NULL AND n > 1),
p AS (SELECT job_id, part, row_number() OVER (PARTITION BY job_id ORDER BY part) AS k FROM (SELECT DISTINCT job_id, part FROM e) x),
t AS (SELECT job_id, part, 0 AS kind, 0 AS doc_no, 0 AS entry_no, CASE k WHEN 1 THEN '{{' ELSE '], ' END || '"' || part || '": [' AS text FROM p
  UNION ALL SELECT job_id, part, 1, doc_no, entry_no, CASE row_number() OVER (PARTITION BY job_id, part ORDER BY doc_no, entry_no) WHEN 1 THEN '' ELSE ', ' END
    || '{{"document_source": "' || filename || '", "valeur": ' || entry || '}}' FROM e
  UNION ALL SELECT DISTINCT job_id, 'z', 2, 0, 0, ']}}' FROM p),
o AS (SELECT job_id, text, coalesce(sum(length(text)) OVER (PARTITION BY job_id ORDER BY part, kind, doc_no, entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM t),
m AS (SELECT job_id, CAST(spot // {PIECE} AS BIGINT) AS piece_no, string_agg(text, '' ORDER BY spot, text) AS text FROM o GROUP BY ALL
  UNION ALL SELECT job_id, 0, sole FROM n WHERE n = 1)
SELECT job_id, piece_no, length(text) AS chars, md5(text) AS digest FROM m""".replace("{{", "{").replace("}}", "}"))
def synthesis(s: Source) -> DataFrame:
    """The synthesis of every job in order, in pieces of bounded size."""
    return B.synthesis_pieces(s.shape(SUMMED), PIECE).select(
        "job_id", "piece_no", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


REQUESTS = """
SELECT conv_id, concat('Question ', CAST(conv_id AS STRING), ' ?') AS question, CASE WHEN conv_id % 3 = 0 THEN '[1]' END AS synthesis,
  CASE WHEN conv_id % 2 = 0 THEN '[1.1] Nom : X' ELSE '' END AS fields_context, CAST(NULL AS STRING) AS context
FROM (SELECT DISTINCT conv_id FROM {conversations}) c"""


@query("chat_messages", f"""
WITH r AS (SELECT conv_id, question, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), 'SYNTHÈSE MÉDICALE STRUCTURÉE :' || chr(10) || synthesis,
    CASE WHEN fields_context <> '' THEN 'VALEURS PRÉ-REMPLIES DANS LE FORMULAIRE :' || chr(10) || fields_context END) AS g FROM ({plain(REQUESTS)}) x),
m AS (SELECT conv_id, -3 AS k, 'system' AS role, '{B.CHAT_SYSTEM.replace("'", "''")}' AS content FROM r
  UNION ALL SELECT conv_id, -2, 'user', 'Voici le dossier médical du patient :' || chr(10) || chr(10) || g FROM r WHERE g <> ''
  UNION ALL SELECT conv_id, -1, 'assistant', '{B.CHAT_READY.replace("'", "''")}' FROM r WHERE g <> ''
  UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''
  UNION ALL SELECT conv_id, 9007199254740992, 'user', question FROM r)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS seq, role, md5(content) AS content FROM m""")
def chat_messages(s: Source) -> DataFrame:
    out = B.chat_messages(s.shape(REQUESTS), A.chat_history(s.table("conversations")))
    return out.withColumn("content", F.md5("content"))


LINES = """SELECT s_nationkey AS job_id, CAST(s_suppkey AS STRING) AS field_id, s_suppkey AS ord,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS label, CASE WHEN s_acctbal > 5000 THEN 'oui' ELSE '' END AS value FROM {supplier}"""


@query("field_lines", f"""
SELECT job_id, string_agg('[' || field_id || '] ' || coalesce(label, field_id) || ' : ' || value, chr(10) ORDER BY ord) AS fields_context
FROM ({plain(LINES)}) x WHERE value <> '' GROUP BY job_id""")
def field_lines(s: Source) -> DataFrame:
    return B.field_lines(s.shape(LINES))


# --- responses ------------------------------------------------------------------------------

RAW = """
SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN concat('Voici : ', props, ' merci')
  WHEN 'error' THEN substr(props, 1, 4) WHEN 'signup' THEN concat('Texte ```json ', props, ' ``` fin') ELSE concat('}} rien {{', event_type) END AS raw
FROM {events}"""


@query("json_texts", rf"""
WITH r AS (SELECT *, regexp_extract(raw, '(?s)\{{.*\}}') AS cut FROM ({plain(RAW)}) x)
SELECT event_id, CASE WHEN cut <> '' AND json_valid(cut) THEN cut END AS salvaged,
  CASE WHEN contains(raw, '```') THEN trim(regexp_extract(raw, '```json (.*) ```', 1)) ELSE raw END AS unfenced FROM r""".replace("{{", "{").replace("}}", "}"))
def json_texts(s: Source) -> DataFrame:
    raw = F.col("raw")
    return s.shape(RAW).select("event_id", J.json_salvage(raw).alias("salvaged"),
                               strip(J.json_unfence(raw)).alias("unfenced"))


ANSWERS = """
SELECT user_id AS job_id, event_id AS batch_no, CASE WHEN value < 50 THEN '{{"a.1": {{"value": ' WHEN value < 100 THEN props
  ELSE concat('{{"a.1": {{"value": "', event_type, '", "source_quote": "', CAST(user_id AS STRING), '"}}, "a.2": "x", "a.3": {{"value": ""}}}}') END AS raw
FROM {events}"""
REQUESTED = """SELECT user_id AS job_id, event_id AS batch_no, f AS field_id FROM {events} LATERAL VIEW explode(array('a.1', 'a.2', 'a.3', 'a.4')) t AS f"""
RESPONSES = f"""
WITH q AS (SELECT a.*, f.f AS field_id, json_valid(raw) AS good FROM ({plain(ANSWERS)}) a, (VALUES ('a.1'), ('a.2'), ('a.3'), ('a.4')) f(f)),
e AS (SELECT *, CASE WHEN good THEN json_extract(raw, '$."' || field_id || '"') END AS e FROM q),
o AS (SELECT job_id, batch_no, field_id, CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.value') END AS value,
  CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.source_quote') END AS source_quote,
  CASE WHEN NOT good THEN 'extraction_failed' WHEN coalesce(json_type(e), '') <> 'OBJECT' THEN 'field_missing_in_response' END AS error FROM e)"""


def answers(s: Source) -> DataFrame:
    return J.explode_responses(s.shape(REQUESTED), s.shape(ANSWERS))


@query("responses", f"{RESPONSES} SELECT * FROM o")
def responses(s: Source) -> DataFrame:
    return answers(s)


@query("outcome_counts", f"""
{RESPONSES} SELECT job_id, count(*) AS fields, count(*) FILTER (WHERE error IS NULL AND coalesce(value, '') <> '') AS ok,
  count(error) AS errors, count(*) FILTER (WHERE error IS NULL AND coalesce(value, '') = '') AS empty FROM o GROUP BY job_id""")
def outcome_counts(s: Source) -> DataFrame:
    return J.outcome_counts(answers(s))


@query("infer", "SELECT item_id, CASE WHEN text LIKE 'T%' THEN NULL ELSE CAST(length(text) AS VARCHAR) END AS raw FROM benchmark")
def infer(s: Source) -> DataFrame:
    def answer(prompt: str) -> str:
        if prompt.startswith("T"):
            raise RuntimeError("no answer")
        return str(len(prompt))
    prompts = s.table("benchmark").select("item_id", F.col("text").alias("prompt"))
    return J.infer(prompts, answer, pause=0.0).select("item_id", "raw")


@query("infer_resumed", "SELECT item_id, CASE WHEN item_id % 5 = 4 THEN NULL WHEN item_id % 2 = 0 THEN 'first' ELSE 'second' END AS raw FROM benchmark")
def infer_resumed(s: Source) -> DataFrame:
    """Two runs with one journal: the second asks what the first has not answered, and keeps what it has."""
    journal = shared_dir(s.spark, "journal")
    prompts = s.table("benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(" "), "text").alias("prompt"))

    def run(says: str, which: int | None):
        def answer(prompt: str) -> str:
            item = int(prompt.split(" ", 1)[0])
            if item % 5 == 4 or (which is not None and item % 2 != which):
                raise RuntimeError("no answer")
            return says
        return stage(J.infer(prompts, answer, tries=1, pause=0.0, journal=journal), "answers")
    run("first", 0)
    return run("second", None).select("item_id", "raw")
