"""Retrieval: unit vectors, exact and approximate nearest chunks per field, reranking."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from attestary import fixed
from attestary.functions.text import norm
from attestary.session import stage

CHUNK_BLOCK = 4096
QUESTION_BLOCK = 1024
SCORED = 128  # questions of a block that are scored at a time
SCORE_DIGITS = 9
PAIRS = 2 ** 27  # of question and chunk that one part of a job scores
SALTS = 64  # parts of a job at most
REMEMBERED = 100_000  # words whose bucket a task remembers; others are hashed each time
LSH_BANDS, LSH_BITS, LSH_SEED = 16, 3, 7


# --- vectors --------------------------------------------------------------------------------

class WordBuckets(dict):
    """Bucket of each word met so far, from the first eight hex digits of its MD5: a word is hashed once."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        bucket = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        if len(self) < REMEMBERED:
            self[word] = bucket
        return bucket


def _unit_counts(dim: int):
    @pandas_udf(T.ArrayType(T.DoubleType()))
    def counts(normals: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = WordBuckets(dim)

        def one(text):
            words = text.split(" ") if text else []
            c = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=dim).astype(np.float64)
            n = np.sqrt(c @ c)
            return c / n if n else c
        for part in normals:
            yield part.map(one, na_action="ignore")
    return counts


def embed(df: DataFrame, col: str, encoder: Callable[[list[str]], np.ndarray] | None = None,
          dim: int = 256) -> DataFrame:
    """Adds ``embedding``, a unit vector of the text in ``col``.

    The default encoder counts hashed words. A model is passed as a callable from a list of
    texts to a matrix; it is called on batches of ``EMBED_BATCH`` inside each task.
    """
    if encoder is None:
        return df.withColumn("embedding", _unit_counts(dim)(norm(F.col(col))))
    size = fixed.EMBED_BATCH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at:at + size].copy()
                m = np.asarray(encoder(part[col].tolist()), np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                part["embedding"] = list(m / np.where(n == 0, 1, n))
                yield part
    schema = T.StructType(df.schema.fields
                          + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def tfidf_encoder(docs: DataFrame, col: str, dim: int = 4096):
    """Hashed TF-IDF fitted on a corpus; ``.transform(df)`` adds ``embedding``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    stages = [RegexTokenizer(inputCol=col, outputCol="_w", pattern=r"[^\p{L}\p{N}]+"),
              HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim),
              IDF(inputCol="_tf", outputCol="_idf"),
              Normalizer(inputCol="_idf", outputCol="embedding")]
    return Pipeline(stages=stages).fit(docs)


def question_signature(fields: DataFrame) -> DataFrame:
    """One signature per form and wording of a question."""
    return fields.withColumn("signature", F.sha2(F.concat_ws(":", "form_id", "question"), 256))


def question_embeddings(fields: DataFrame, cache: DataFrame, encoder=None,
                        dim: int = 256) -> tuple[DataFrame, DataFrame]:
    """(vectors of all questions, the cache entries to append); only new wordings are embedded."""
    signed = question_signature(fields)
    new = (signed.select("signature", "question").distinct()
           .join(cache.select("signature"), "signature", "left_anti"))
    fresh = embed(new, "question", encoder, dim).select("signature", "embedding")
    known = cache.select("signature", "embedding").unionByName(fresh)
    return signed.join(known, "signature"), fresh


# --- nearest chunks -------------------------------------------------------------------------

def _matrix(vectors: pa.Array) -> np.ndarray:
    """One row per vector; there are no nulls, and all are of one length."""
    if not len(vectors):
        return np.zeros((0, 0))
    lengths = np.diff(vectors.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of several lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), lengths[0])


class _Nearest:
    """Best chunks so far of some questions; their vectors are kept packed and unpacked for each block of chunks."""

    def __init__(self, fields: pa.Array, vectors: np.ndarray, k: int):
        self.fields, self.shape, self.k = fields, vectors.shape, k
        self.packed = zlib.compress(np.ascontiguousarray(vectors), 1)
        self.scores = np.full((len(fields), k), -np.inf)
        self.numbers = np.zeros((len(fields), k), np.int64)

    def meet(self, chunks: np.ndarray, numbers: np.ndarray) -> None:
        """Chunks come in the order of their numbers, so in a tie those that are held stay."""
        vectors = np.frombuffer(zlib.decompress(self.packed)).reshape(self.shape)
        for at in range(0, len(vectors), SCORED):
            s = np.round(vectors[at:at + SCORED] @ chunks.T, SCORE_DIGITS)
            held, of = self.scores[at:at + SCORED], self.numbers[at:at + SCORED]
            better = s > held[:, -1:]
            if s.shape[1] > self.k and np.isneginf(held[:, -1]).any():  # else few are better
                better &= s >= np.partition(s, -self.k, axis=1)[:, -self.k, None]
            row, col = np.nonzero(better)
            if not len(row):
                continue
            rows = np.concatenate([np.repeat(np.arange(len(s)), self.k), row])
            scores = np.concatenate([held.ravel(), s[row, col]])
            found = np.concatenate([of.ravel(), numbers[col]])
            # stable: what is held comes first, then by number
            order = np.lexsort((-scores, rows))
            starts = np.concatenate([[0], np.cumsum(np.bincount(rows))[:-1]])
            best = order[starts[:, None] + np.arange(self.k)]
            held[:], of[:] = scores[best], found[best]

    def rows(self, job: pa.Scalar, schema: pa.Schema) -> pa.RecordBatch:
        row, col = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([
            pa.repeat(job, len(row)).cast(schema.field(0).type), self.fields.take(pa.array(row)).cast(schema.field(1).type),
            pa.array(self.numbers[row, col]), pa.array(self.scores[row, col])], schema=schema)


def knn(questions: DataFrame, chunks: DataFrame, k: int = fixed.KNN_K) -> DataFrame:
    """Exact top ``k`` chunks per field of the same job, by cosine of unit vectors.

    ``questions(job_id, field_id, embedding)``, ``chunks(job_id, chunk_no, embedding)``. The chunks of a
    job are dealt to parts, as many as the pairs of the job ask for and ``SALTS`` at most. Every chunk moves once, the
    questions of the job once per part; a part holds its questions, packed, and lets its chunks pass in
    blocks, one matrix product each. It hands on at most ``k`` rows per question. So a job of any size is
    spread over many executors, what moves grows as the tables do, and no pair of question and chunk is ever a row.
    Without a vector, chunks are not found and questions find none.
    """
    spark = chunks.sparkSession
    chunks = chunks.where("chunk_no IS NOT NULL")
    pairs = F.col("_nc").cast("double") * F.col("_nq")
    # one row per job, written so that its size is known before rows with vectors are moved
    jobs = stage(chunks.groupBy("job_id").agg(F.count(F.lit(1)).alias("_nc"))
                 .join(questions.groupBy("job_id").agg(F.count(F.lit(1)).alias("_nq")), "job_id")
                 .select("job_id", F.least(F.lit(SALTS), F.ceil(pairs / PAIRS)).cast("int").alias("_salts")), "knn-jobs")
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    kinds = {f.name: f.dataType for f in questions.schema.fields}
    asked = (questions.join(jobs, "job_id")
             .select("job_id", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"),
                     F.lit(None).cast("bigint").alias("chunk_no"), "field_id", vector))
    held = (chunks.join(jobs, "job_id")
            .select("job_id", F.pmod(F.xxhash64("chunk_no"), F.col("_salts")).cast("int").alias("_salt"),
                    F.col("chunk_no").cast("bigint").alias("chunk_no"), F.lit(None).cast(kinds["field_id"]).alias("field_id"), vector))
    schema = T.StructType([
        T.StructField("job_id", kinds["job_id"]), T.StructField("field_id", kinds["field_id"]),
        T.StructField("chunk_no", T.LongType()), T.StructField("score", T.DoubleType())])
    out, block = to_arrow_schema(schema), CHUNK_BLOCK
    gather = QUESTION_BLOCK

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asking, passing, waiting, fields = None, [], [], [], []

        def ask():
            if waiting:
                asking.append(_Nearest(pa.concat_arrays(fields), np.concatenate(waiting), k))
                waiting.clear(), fields.clear()

        def meet():
            if passing:
                vectors, numbers = (np.concatenate([x[i] for x in passing]) for i in (0, 1))
                passing.clear()
                for a in asking:
                    a.meet(vectors, numbers)

        def end():
            ask(), meet()
            found = [a.rows(part[0], out) for a in asking]
            asking.clear()
            return found
        for batch in batches:
            batch = batch.filter(batch.column("embedding").is_valid())
            n = batch.num_rows
            job, salt = batch.column("job_id"), batch.column("_salt")
            numbers = batch.column("chunk_no")
            edge = np.zeros(n, bool)
            if n > 1:
                for c in (job, salt, numbers.is_null()):
                    edge[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            edge[:1] = True
            cuts = np.append(np.flatnonzero(edge), n)
            for i, j in zip(cuts[:-1], cuts[1:]):
                i, j = int(i), int(j)
                if part is None or part[1] != salt[i].as_py() or part[0] != job[i]:
                    if part is not None:
                        yield from end()
                    part = job[i], salt[i].as_py()
                vectors = _matrix(batch.column("embedding").slice(i, j - i))
                if not numbers[i].is_valid:  # questions come first
                    waiting.append(vectors), fields.append(batch.column("field_id").slice(i, j - i))
                    if sum(map(len, waiting)) >= gather:
                        ask()
                    continue
                ask()
                no = numbers.slice(i, j - i).to_numpy()
                while len(vectors):
                    room = block - sum(len(x[0]) for x in passing)
                    passing.append((vectors[:room], no[:room]))
                    vectors, no = vectors[room:], no[room:]
                    if room <= len(passing[-1][0]):
                        meet()
        if part is not None:
            yield from end()
    # by number, as it is work that fills partitions and not what they read; no more than there are parts to deal
    groups = jobs.agg(F.sum("_salts").alias("n")).first()["n"] or 1
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * groups)
    dealt = asked.unionByName(held).repartition(parts, "job_id", "_salt")
    scored = dealt.sortWithinPartitions("job_id", "_salt", F.asc_nulls_first("chunk_no")).mapInArrow(score, schema)
    return rank_top(scored, [F.desc("score"), F.asc("chunk_no")], k)


def rank_top(scored: DataFrame, order: list[Column], k: int,
             by: tuple[str, ...] = ("job_id", "field_id")) -> DataFrame:
    """Adds ``rank`` from 1 and keeps the best ``k`` per group."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def sign_planes(dim: int, bands: int = LSH_BANDS, bits: int = LSH_BITS, seed: int = LSH_SEED) -> np.ndarray:
    """One column per plane, those of a band side by side."""
    return np.random.default_rng(seed).standard_normal((dim, bands * bits))


def _sign_bands(dim: int, bands: int, bits: int, seed: int):
    planes = sign_planes(dim, bands, bits, seed)

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def signature(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        m = np.stack(vectors.to_numpy()).astype(np.float64) @ planes > 0
        weights = (1 << np.arange(bits)).astype(np.int32)
        return pd.Series(list(m.reshape(len(vectors), bands, bits).astype(np.int32) @ weights))
    return signature


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def knn_lsh(questions: DataFrame, chunks: DataFrame, dim: int, k: int = fixed.KNN_K,
            bands: int = LSH_BANDS, bits: int = LSH_BITS, seed: int = LSH_SEED) -> DataFrame:
    """Approximate top ``k``: only chunks that share a band of sign bits with the question.

    A pair sharing several bands is scored once, at the first of them.
    """
    sign = _sign_bands(dim, bands, bits, seed)
    q = questions.select("job_id", "field_id", F.col("embedding").alias("_q"),
                         sign("embedding").alias("_qs"))
    c = chunks.select("job_id", "chunk_no", F.col("embedding").alias("_c"),
                      sign("embedding").alias("_cs"))
    q = q.select("*", F.posexplode("_qs").alias("band", "bucket"))
    c = c.select("*", F.posexplode("_cs").alias("band", "bucket"))
    shared = F.array_position(F.zip_with("_qs", "_cs", lambda a, b: a == b), True) - 1
    scored = (q.join(c, ["job_id", "band", "bucket"]).where(shared == F.col("band"))
              .select("job_id", "field_id", "chunk_no",
                      F.round(dot(F.col("_q"), F.col("_c")), SCORE_DIGITS).alias("score")))
    return rank_top(scored, [F.desc("score"), F.asc("chunk_no")], k)


# --- reranking ------------------------------------------------------------------------------

def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.split(norm(text), " ", -1))


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text holds; both as word arrays.

    Words are cut once per question and once per chunk, before the two meet.
    """
    return F.size(F.array_intersect(question, text)) / F.size(question)


@pandas_udf(T.ArrayType(T.DoubleType()))
def _overlaps(normals: pd.Series, asked: pd.Series) -> pd.Series:
    """Per text, the share of each question's distinct words that it holds; its words are cut once for all."""
    out = []
    for text, questions in zip(normals, asked):
        held = set(text.split(" ")) if text is not None else None
        out.append([None if held is None or q["_q"] is None else sum(w in held for w in q["_q"]) / len(q["_q"]) for q in questions])
    return pd.Series(out, dtype=object)


def overlap_candidates(near: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``near(job_id, field_id, chunk_no, rank)`` with ``rerank_score``, the lexical overlap of question and chunk.

    ``questions`` has the distinct words ``_q`` of each ``field_id`` (and of each ``job_id``, if it has that
    column). The questions of a chunk come to it, at most one per field of its form, and their scores go
    back: a text is read and cut into words once, and is never copied for a pair.
    """
    key = [c for c in ("job_id", "form_id", "field_id") if c in questions.columns and c in near.columns]
    others = [c for c in near.columns if c not in ("job_id", "chunk_no")]
    asked = (near.join(questions.select(*key, "_q"), key).groupBy("job_id", "chunk_no")
             .agg(F.collect_list(F.struct(*others, "_q")).alias("_asked")))
    met = chunks.select("job_id", "chunk_no", "text").join(asked, ["job_id", "chunk_no"])
    scored = F.arrays_zip("_asked", _overlaps(norm(F.col("text")), F.col("_asked")).alias("_s"))
    rows = F.transform(scored, lambda x: F.struct(*[x["_asked"][c].alias(c) for c in others], x["_s"].alias("rerank_score")))
    return met.select("job_id", "chunk_no", F.inline(rows))


def rerank(candidates: DataFrame, score: Column, k: int = fixed.RERANK_K) -> DataFrame:
    """Best ``k`` candidates by a pair score, ties in the order they were retrieved.

    What the score is computed from is left behind: only ids and ranks are sorted.
    """
    scored = candidates.select("job_id", "field_id", "chunk_no", F.col("rank").alias("_was"),
                               score.alias("rerank_score"))
    return rank_top(scored, [F.desc("rerank_score"), F.asc("_was")], k).drop("_was")


def best_score(fields: DataFrame, ranked: DataFrame) -> DataFrame:
    """Best rerank score per field, 0 for fields with no candidate, 4 decimals."""
    best = ranked.groupBy("job_id", "field_id").agg(F.max("rerank_score").alias("score"))
    return (fields.select("job_id", "field_id").join(best, ["job_id", "field_id"], "left")
            .withColumn("score", F.bround(F.coalesce("score", F.lit(0.0)), 4)))


def _joined(rows: Column, separator: str = fixed.CHUNK_SEPARATOR) -> Column:
    """Texts of ``struct(order, text)`` rows in order; the rows are a bounded top k."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["text"]),
                        separator)


def retrieve_context(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context of an ad-hoc question: the texts of its reranked chunks, joined."""
    return (ranked.join(chunks.select("job_id", "chunk_no", "text"), ["job_id", "chunk_no"])
            .groupBy("job_id", "field_id")
            .agg(_joined(F.struct(F.col("rank").alias("o"), "text")).alias("context")))


def batch_context(ranked: DataFrame, batches: DataFrame, chunks: DataFrame,
                  k: int = fixed.CONTEXT_K) -> DataFrame:
    """Merged context per batch: fields in batch order, chunks in rank order, first occurrence of
    a text kept, first ``k``.

    ``batches(job_id, field_id, batch_no, field_ord)``. Texts are told apart by their SHA-256 and join
    only the kept chunks. A batch has a handful of fields and each of them a handful of chunks,
    so its group is small whatever the size of the job.
    """
    held = ranked.select("job_id", "chunk_no").distinct()
    digests = (chunks.join(held, ["job_id", "chunk_no"], "left_semi")
               .select("job_id", "chunk_no", F.sha2("text", 256).alias("digest")))
    at = F.struct("field_ord", "rank", "chunk_no")
    first = (ranked.join(batches, ["job_id", "field_id"])
             .join(digests, ["job_id", "chunk_no"])
             .groupBy("job_id", "batch_no", "digest").agg(F.min(at).alias("at")))
    kept = F.row_number().over(W.partitionBy("job_id", "batch_no").orderBy("at"))
    return (first.withColumn("_n", kept).where(F.col("_n") <= k)
            .select("job_id", "batch_no", "at", F.col("at.chunk_no").alias("chunk_no"))
            .join(chunks.select("job_id", "chunk_no", "text"), ["job_id", "chunk_no"])
            .groupBy("job_id", "batch_no")
            .agg(_joined(F.struct("at", "text")).alias("context"),
                 F.count(F.lit(1)).alias("n_chunks")))
