"""A chat about dossiers: each question with what its dossier says, what the form holds, and what was said before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestary import fixed
from attestary.operators import admission as A, context as B, retrieval as R
from attestary.plans.registry import Source, plain, query
from attestary.plans.retrieve import chunk_table, words_sql
from attestary.plans.texts import NORM
from attestary.session import stage


def chat_requests(questions: DataFrame, chunks: DataFrame, filled: DataFrame | None = None, synthesis: DataFrame | None = None,
                  encoder=None, k: int = fixed.CHAT_KNN_K, keep: int = fixed.CHAT_RERANK_K) -> DataFrame:
    """``conv_id, question, synthesis, fields_context, context`` for :func:`context.chat_messages`.

    ``questions(conv_id, job_id, question)``; ``chunks`` with vectors, as a filled form leaves them;
    ``filled(job_id, field_id, ord, label, value)``; ``synthesis(job_id, synthesis)``. The best passages
    of the question's own dossier are its context; a part that is not there is NULL.
    """
    asked = questions.select("job_id", F.col("conv_id").alias("field_id"), "question")
    vectors = stage(R.embed(asked, "question", encoder).select(
        "job_id", "field_id", "embedding", R.distinct_words(F.col("question")).alias("_q")), "chat-questions")
    near = stage(R.knn(vectors.select("job_id", "field_id", "embedding"), chunks, k), "chat-near")
    best = stage(R.rerank(R.overlap_candidates(near, vectors.select("job_id", "field_id", "_q"), chunks), F.col("rerank_score"), keep), "chat-best")
    found = R.retrieve_context(best, chunks).select("job_id", F.col("field_id").alias("conv_id"), "context")
    out = questions
    for part, name in ((B.field_lines(filled) if filled is not None else None, "fields_context"),
                       (synthesis, "synthesis")):
        out = out.withColumn(name, F.lit(None).cast("string")) if part is None else out.join(part.select("job_id", name), "job_id", "left")
    # contexts come last: they are long, and move once
    return out.join(found, ["job_id", "conv_id"], "left").select("conv_id", "question", "synthesis", "fields_context", "context")


# A conversation is about the dossier of the document of its number; its last question is asked now, what came before is its history.
ASKED = """
SELECT q.conv_id, d.source AS job_id, q.asked, q.question FROM (
  SELECT conv_id, max(turn) AS asked, max_by(text, turn) AS question FROM {conversations} WHERE role = 'user' AND text <> '' GROUP BY conv_id) q
JOIN {documents} d ON d.doc_id = q.conv_id"""
FILLED = """
SELECT source AS job_id, lang AS field_id, min(doc_id) AS ord, CASE WHEN lang <> 'en' THEN 'Documents' END AS label,
  CASE WHEN count(*) > 5 THEN CAST(count(*) AS STRING) ELSE '' END AS value FROM {documents} GROUP BY source, lang"""
SUMMED = "SELECT source AS job_id, CASE WHEN count(*) % 2 = 0 THEN concat('[', CAST(count(*) AS STRING), ']') END AS synthesis FROM {documents} GROUP BY source"
BREAK = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("dossier_chat", f"""
WITH q AS ({plain(ASKED)}),
cw AS ({words_sql('documents', 'source, doc_id', 'text')}), qw AS ({words_sql('q', 'conv_id', 'question')}),
cn AS (SELECT source, doc_id, sqrt(sum(c * c)) AS n FROM cw GROUP BY ALL), qn AS (SELECT conv_id, sqrt(sum(c * c)) AS n FROM qw GROUP BY ALL),
dots AS (SELECT q.conv_id, cw.doc_id, sum(cw.c * qw.c) AS dot FROM q JOIN qw USING (conv_id) JOIN cw ON cw.source = q.job_id AND cw.bucket = qw.bucket GROUP BY ALL),
pairs AS (SELECT q.conv_id, q.question, cn.doc_id, round(coalesce(dot, 0) / (qn.n * cn.n), 9) AS score
  FROM q JOIN qn USING (conv_id) JOIN cn ON cn.source = q.job_id LEFT JOIN dots ON dots.conv_id = q.conv_id AND dots.doc_id = cn.doc_id),
near AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id) AS r FROM pairs QUALIFY r <= 15),
ov AS (SELECT near.conv_id, r, d.text, len(list_intersect(list_distinct(string_split({NORM.format('question')}, ' ')), string_split({NORM.format('d.text')}, ' ')))
    / len(list_distinct(string_split({NORM.format('question')}, ' '))) AS s FROM near JOIN documents d ON d.doc_id = near.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, r) AS rank FROM ov QUALIFY rank <= 6),
x AS (SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM top GROUP BY ALL),
l AS (SELECT job_id, string_agg('[' || field_id || '] ' || coalesce(label, field_id) || ' : ' || value, chr(10) ORDER BY ord) AS fields_context
  FROM ({plain(FILLED)}) f WHERE value <> '' GROUP BY ALL),
g AS (SELECT q.*, concat_ws({BREAK}, {', '.join(f"CASE WHEN {c} <> '' THEN {_quoted(h)} || {c} END" for c, h in B.CHAT_HEADS)}) AS given
  FROM q LEFT JOIN x ON x.conv_id = q.conv_id LEFT JOIN l ON l.job_id = q.job_id LEFT JOIN ({plain(SUMMED)}) s ON s.job_id = q.job_id),
m AS (SELECT conv_id, -3 AS k, 'system' AS role, {_quoted(B.CHAT_SYSTEM)} AS content FROM g
  UNION ALL SELECT conv_id, -2, 'user', {_quoted(B.CHAT_OPEN)} || given FROM g WHERE given <> ''
  UNION ALL SELECT conv_id, -1, 'assistant', {_quoted(B.CHAT_READY)} FROM g WHERE given <> ''
  UNION ALL SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN g ON g.conv_id = c.conv_id AND c.turn < g.asked
    WHERE c.role IN ('user', 'assistant') AND c.text <> ''
  UNION ALL SELECT conv_id, 9007199254740992, 'user', question FROM g)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS seq, role, md5(content) AS content FROM m""")
def dossier_chat(s: Source) -> DataFrame:
    """Every conversation answered from its dossier: best passages, filled fields, synthesis, history and question in one table."""
    asked = stage(s.shape(ASKED), "chat-asked")
    jobs = stage(asked.select("job_id").distinct(), "chat-jobs")  # written so that its size is known before texts are moved
    chunks = R.embed(chunk_table(s).join(jobs, "job_id", "left_semi"), "text")
    requests = chat_requests(asked.select("conv_id", "job_id", "question"), chunks, s.shape(FILLED), s.shape(SUMMED))
    before = s.table("conversations").join(asked.select("conv_id", "asked"), "conv_id").where("turn < asked").drop("asked")
    return B.chat_messages(requests, A.chat_history(before)).withColumn("content", F.md5("content"))
