"""Retrieval plans: vectors, nearest chunks, reranking, contexts."""

from pyspark.sql import DataFrame, functions as F

from attestary.operators import context as B, retrieval as R
from attestary.plans.registry import Source, plain, query
from attestary.plans.texts import NORM
from attestary.session import stage


def words_sql(table: str, key: str, text: str) -> str:
    return f"""SELECT {key}, bucket, count(*) AS c FROM (
  SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 256 AS bucket FROM (
    SELECT {key}, unnest(string_split({NORM.format(text)}, ' ')) AS w FROM {table}) a WHERE w <> '') b GROUP BY ALL"""


@query("embed", f"""
WITH c AS ({words_sql('documents', 'doc_id', 'text')})
SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def embed(s: Source) -> DataFrame:
    """The buckets of every text that hold a word, with their values."""
    e = R.embed(s.table("documents").select("doc_id", "text"), "text")
    return (e.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value > 0")
            .select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value")))


@query("embed_tfidf")
def embed_tfidf(s: Source) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    docs = s.table("documents").select("doc_id", "text")
    e = R.tfidf_encoder(docs, "text", 1024).transform(docs)
    v = vector_to_array("embedding")
    return e.select("doc_id", F.size(F.filter(v, lambda x: x > 0)).alias("terms"))


# The earliest vector of each label is a question; the form of every dossier asks all of them.
QUESTIONS = """
SELECT job_id, field_id, embedding FROM (SELECT DISTINCT label AS job_id, label % 2 AS form_id FROM {embeddings}) j
JOIN (SELECT label AS field_id, embedding, 0 AS form_id FROM {first} UNION ALL SELECT label, embedding, 1 FROM {first}) q USING (form_id)""".replace(
    "{first}", "(SELECT label, min_by(embedding, vec_id) AS embedding FROM {embeddings} GROUP BY label) f")
VECTORS = "SELECT label AS job_id, vec_id AS chunk_no, embedding FROM {embeddings}"
KNN = f"""
SELECT q.job_id, q.field_id, c.chunk_no,
  round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
FROM ({plain(QUESTIONS)}) q JOIN ({plain(VECTORS)}) c ON q.job_id = c.job_id"""


@query("knn", f"""
SELECT job_id, field_id, chunk_no, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, field_id ORDER BY score DESC, chunk_no) AS rank FROM ({KNN}) k) r
WHERE rank <= 30""")
def knn(s: Source) -> DataFrame:
    out = R.knn(s.shape(QUESTIONS), s.shape(VECTORS))
    return out.select("job_id", "field_id", "chunk_no", F.round("score", 4).alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


LSH_DIM = 64


def lsh_sql() -> str:
    """The same planes as values: vectors on the same side of all planes of a band may be neighbours."""
    planes = R.sign_planes(LSH_DIM)
    sides = [[f"list_dot_product(v, {planes[:, i].tolist()}::DOUBLE[]) > 0" for i in range(b, b + R.LSH_BITS)]
             for b in range(0, planes.shape[1], R.LSH_BITS)]
    bands = ", ".join("[" + ", ".join(band) + "]" for band in sides)
    return f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT *, [{bands}] AS s FROM v),
q AS (SELECT j.job_id, f.* FROM (SELECT DISTINCT label AS job_id FROM s) j
  JOIN (SELECT label AS field_id, v AS qv, s AS qs FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) f ON true),
p AS (SELECT job_id, field_id, vec_id AS chunk_no, round(list_dot_product(qv, v), 9) AS score FROM q JOIN s ON s.label = q.job_id
  WHERE len(list_filter(range(1, len(s) + 1), lambda i: qs[i] = s[i])) > 0)
SELECT job_id, field_id, chunk_no, round(score, 4) AS score, row_number() OVER (PARTITION BY job_id, field_id ORDER BY score DESC, chunk_no) AS rank
FROM p QUALIFY rank <= 30"""


@query("knn_lsh", lsh_sql())
def knn_lsh(s: Source) -> DataFrame:
    """Approximate; its share of the exact neighbours is checked in the tests."""
    out = R.knn_lsh(s.shape(QUESTIONS), s.shape(VECTORS), dim=LSH_DIM)
    return out.select("job_id", "field_id", "chunk_no", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# --- texts: documents are the chunks of their source, benchmark items the questions -----------

FIELDS = """
SELECT 'benchmark' AS form_id, item_id AS ord, text AS question,
  concat(CAST(CAST(floor(item_id / 10) AS BIGINT) + 1 AS STRING), '.', CAST(item_id % 10 + 1 AS STRING)) AS field_id
FROM {benchmark}"""
ASKED = f"""
SELECT job_id, field_id, ord, question FROM (SELECT DISTINCT source AS job_id, length(source) % 2 AS form FROM {{documents}}) j
JOIN (SELECT *, 0 AS form FROM ({FIELDS}) g UNION ALL SELECT *, 1 AS form FROM ({FIELDS}) h) f USING (form)"""


def chunk_table(s: Source) -> DataFrame:
    return s.table("documents").select(F.col("source").alias("job_id"),
                                       F.col("doc_id").alias("chunk_no"), "text")


def ranked(s: Source, k: int, keep: int) -> DataFrame:
    chunks = chunk_table(s)
    fields = R.embed(s.shape(FIELDS), "question").withColumn("_q", R.distinct_words(F.col("question")))
    asked = s.shape(ASKED).select("job_id", "field_id").join(
        fields.select("field_id", "embedding"), "field_id")
    near = stage(R.knn(asked, R.embed(chunks, "text"), k), "near")
    return R.rerank(R.overlap_candidates(near, fields, chunks), F.col("rerank_score"), keep)


def ranked_sql(k: int, keep: int) -> str:
    return f"""
cw AS ({words_sql('documents', 'source, doc_id', 'text')}), qw AS ({words_sql('benchmark', 'item_id', 'text')}),
cn AS (SELECT source, doc_id, sqrt(sum(c * c)) AS n FROM cw GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qw GROUP BY ALL),
dots AS (SELECT source, item_id, doc_id, sum(cw.c * qw.c) AS dot FROM cw JOIN qw USING (bucket) GROUP BY ALL),
pairs AS (SELECT cn.source, qn.item_id, cn.doc_id, round(coalesce(dot, 0) / (qn.n * cn.n), 9) AS score
  FROM cn JOIN qn ON true LEFT JOIN dots USING (source, item_id, doc_id)),
near AS (SELECT *, row_number() OVER (PARTITION BY source, item_id ORDER BY score DESC, doc_id) AS r FROM pairs QUALIFY r <= {k}),
ov AS (SELECT near.*, d.text, len(list_intersect(list_distinct(string_split({NORM.format('b.text')}, ' ')), string_split({NORM.format('d.text')}, ' ')))
    / len(list_distinct(string_split({NORM.format('b.text')}, ' '))) AS rerank_score
  FROM near JOIN documents d USING (source, doc_id) JOIN benchmark b USING (item_id)),
top AS (SELECT source AS job_id, item_id, (item_id // 10 + 1) || '.' || (item_id % 10 + 1) AS field_id, doc_id AS chunk_no, text, rerank_score,
    row_number() OVER (PARTITION BY source, item_id ORDER BY rerank_score DESC, r) AS rank FROM ov QUALIFY rank <= {keep})"""


@query("rerank", f"""
WITH {ranked_sql(30, 12)} SELECT job_id, field_id, chunk_no, rank, round(rerank_score, 6) AS rerank_score FROM top""")
def rerank(s: Source) -> DataFrame:
    return ranked(s, 30, 12).select("job_id", "field_id", "chunk_no",
                                    F.col("rank").cast("bigint").alias("rank"),
                                    F.round("rerank_score", 6).alias("rerank_score"))


@query("best_score", f"""
WITH {ranked_sql(30, 12)} SELECT job_id, field_id, round_even(max(rerank_score), 4) AS score FROM top GROUP BY ALL""")
def best_score(s: Source) -> DataFrame:
    return R.best_score(s.shape(ASKED), ranked(s, 30, 12))


@query("retrieve_context", f"""
WITH {ranked_sql(15, 6)} SELECT job_id, field_id, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context
FROM top GROUP BY ALL""")
def retrieve_context(s: Source) -> DataFrame:
    out = R.retrieve_context(ranked(s, 15, 6), chunk_table(s))
    return out.select("job_id", "field_id", F.md5("context").alias("context"))


BATCHES = """SELECT *, (SELECT count(*) FROM (SELECT DISTINCT item_id // 10 AS s, (item_id % 10) // 7 AS c FROM benchmark) z
  WHERE (z.s, z.c) < (item_id // 10, (item_id % 10) // 7)) AS batch_no FROM top"""


@query("batch_context", f"""
WITH {ranked_sql(30, 12)}, b AS ({BATCHES}),
f AS (SELECT job_id, batch_no, text, min(struct_pack(o := item_id, r := rank)) AS pos FROM b GROUP BY ALL),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY job_id, batch_no ORDER BY pos) <= 24)
SELECT job_id, batch_no, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY pos)) AS context, count(*) AS n_chunks FROM k GROUP BY ALL""")
def batch_context(s: Source) -> DataFrame:
    batches = B.batch_fields(s.shape(FIELDS)).select("form_id", "field_id", "batch_no", "field_ord")
    jobs = s.table("documents").select(F.col("source").alias("job_id"),
                                       F.lit("benchmark").alias("form_id")).distinct()
    best = stage(ranked(s, 30, 12), "ranked")  # read for the digests and for the order
    out = R.batch_context(best, jobs.join(batches, "form_id").drop("form_id"), chunk_table(s))
    return out.select("job_id", "batch_no", F.md5("context").alias("context"), "n_chunks")


CACHED = f"SELECT form_id, question FROM ({FIELDS}) f WHERE length(question) > 150"


@query("question_cache", f"""
SELECT DISTINCT sha256(form_id || ':' || question) AS signature FROM ({plain(FIELDS)}) f
WHERE sha256(form_id || ':' || question) NOT IN (SELECT sha256(form_id || ':' || question) FROM ({plain(CACHED)}) c)""")
def question_cache(s: Source) -> DataFrame:
    cache = R.question_signature(R.embed(s.shape(CACHED), "question"))
    return R.question_embeddings(s.shape(FIELDS), cache)[1].select("signature")
