"""The whole way from documents to filled targets, for all jobs of a table at once.

Each step is one of the operators; this module only puts them in order. Tables that several
steps read (chunks with vectors, ranked candidates, answers) are staged once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from attestary import fixed
from attestary.operators import admission, chunking, context, fill, grounding, responses, retrieval
from attestary.session import stage


@dataclass
class Dossiers:
    """Input tables.

    ``jobs(job_id, form_id)``, ``docs(job_id, doc_no, filename, markdown)``, ``fields`` as read from the
    templates, ``synthesis(job_id, synthesis)`` with JSON texts or NULL, ``cantons(form_id, canton, name,
    value)`` where forms have a recipient per canton.
    """

    jobs: DataFrame
    docs: DataFrame
    fields: DataFrame
    synthesis: DataFrame | None = None
    cantons: DataFrame | None = None
    _job_fields: DataFrame | None = None

    def job_fields(self) -> DataFrame:
        """The fields each job asks, batched and numbered once for all steps."""
        if self._job_fields is None:
            batched = stage(context.batch_fields(admission.extractable_fields(self.fields)), "fields")
            self._job_fields = self.jobs.join(batched, "form_id")
        return self._job_fields


def chunk_table(docs: DataFrame, encoder=None) -> DataFrame:
    """Numbered chunks with vectors: what a re-run starts from."""
    chunks = chunking.number_chunks(chunking.chunk_documents(chunking.with_source_header(docs)))
    return retrieval.embed(chunks, "text", encoder)


def rank_chunks(d: Dossiers, chunks: DataFrame, encoder=None, k: int = fixed.KNN_K,
                keep: int = fixed.RERANK_K, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Best chunks per job and field; ``scorer`` takes the word arrays of question and chunk."""
    asked = admission.extractable_fields(d.fields).select("form_id", "field_id", "question")
    vectors = retrieval.embed(asked, "question", encoder) \
        .withColumn("_q", retrieval.distinct_words(F.col("question")))
    near = stage(retrieval.knn(d.jobs.join(vectors.select("form_id", "field_id", "embedding"), "form_id"),
                               chunks, k), "near")
    if scorer is None:
        rows = retrieval.overlap_candidates(near.join(d.jobs, "job_id"), vectors, chunks)
        return retrieval.rerank(rows, F.col("rerank_score"), keep)
    held = near.select("job_id", "chunk_no").distinct()
    texts = chunks.join(held, ["job_id", "chunk_no"], "left_semi").select("job_id", "chunk_no", retrieval.distinct_words(F.col("text")).alias("_t"))
    pairs = (near.join(texts, ["job_id", "chunk_no"]).join(d.jobs, "job_id")
             .join(vectors.select("form_id", "field_id", "_q"), ["form_id", "field_id"]))
    return retrieval.rerank(pairs, scorer(F.col("_q"), F.col("_t")), keep)


def prompt_table(d: Dossiers, chunks: DataFrame, ranked: DataFrame) -> DataFrame:
    """One extraction prompt per job and batch of fields."""
    fields = d.job_fields()
    merged = retrieval.batch_context(
        ranked, fields.select("job_id", "field_id", "batch_no", "field_ord"), chunks)
    sections = fields.groupBy("job_id", "batch_no").agg(F.min("section").alias("section"))
    parts = sections.join(merged, ["job_id", "batch_no"], "left")
    if d.synthesis is not None:
        parts = parts.join(d.synthesis, "job_id", "left").withColumn(
            "synthesis", context.synthesis_slice(F.col("synthesis"), F.col("section")))
    else:
        parts = parts.withColumn("synthesis", F.lit(None).cast("string"))
    return context.build_prompts(fields, parts)


def read_answers(d: Dossiers, answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """Field results with score, verdict and anchor out of ``answers(job_id, batch_no, raw)``."""
    fields = d.job_fields().select("job_id", "form_id", "field_id", "batch_no", "field_ord")
    results = responses.explode_responses(fields.drop("form_id", "field_ord"), answers)
    scores = retrieval.best_score(fields, ranked)
    derived = context.derived_docs(d.synthesis) if d.synthesis is not None else None
    index = grounding.source_index(d.docs, derived)
    return (grounding.annotate(results, scores, index)
            .join(fields.select("job_id", "form_id", "field_id", F.col("field_ord").alias("ord")),
                  ["job_id", "field_id"]))


def target_values(d: Dossiers, results: DataFrame, rerun: bool = False) -> DataFrame:
    """Value per form target; a re-run writes the extracted values alone."""
    values = fill.field_values(results.select("job_id", "form_id", "field_id", "value"), d.fields)
    if rerun:
        return fill.resolve_targets(values)
    computed = d.jobs.join(fill.computed_values(d.fields), "form_id")
    canton = None
    if d.cantons is not None:
        names = d.fields.select("form_id", "name", "ord", "xml_path", "acroform_name")
        canton = fill.canton_recipient(results, d.fields, d.cantons).join(names, ["form_id", "name"])
    return fill.resolve_targets(values, computed, canton)


def synthesise(d: Dossiers, answer: Callable[[str], str], **calls) -> DataFrame:
    """``(job_id, synthesis)`` of every job: planned, asked for whole or document by document, and merged.

    Answers without valid JSON are failures; a job without any good answer has a NULL synthesis.
    """
    prompts = context.synthesis_prompts(d.docs, context.synthesis_plan(d.docs))
    said = stage(responses.infer(prompts, answer, **calls).select(
        "job_id", "doc_no", responses.json_salvage(F.col("raw")).alias("summary")), "summaries")
    names = d.docs.select("job_id", F.col("doc_no").cast("bigint").alias("doc_no"), "filename")
    return context.merged_synthesis(d.jobs, said.join(names, ["job_id", "doc_no"], "left"))


def fill_forms(d: Dossiers, answer: Callable[[str], str], encoder=None, chunks: DataFrame | None = None,
               summarise: Callable[[str], str] | None = None, **calls) -> tuple[DataFrame, DataFrame]:
    """(results, targets). Pass the kept ``chunks`` of an earlier run to repeat from there.

    With ``summarise``, dossiers given without a synthesis get one first. ``calls`` go to
    :func:`responses.infer`: tries, pause, tasks.
    """
    if d.synthesis is None and summarise is not None:
        d = replace(d, synthesis=stage(synthesise(d, summarise, **calls), "synthesis"))
    rerun = chunks is not None
    chunks = chunks if rerun else stage(chunk_table(d.docs, encoder), "chunks")
    ranked = stage(rank_chunks(d, chunks, encoder), "ranked")
    # staged before anything reads it twice: a model is asked once per prompt
    answers = stage(responses.infer(prompt_table(d, chunks, ranked), answer, **calls)
                    .select("job_id", "batch_no", "raw"), "answers")
    results = stage(read_answers(d, answers, ranked), "results")
    return results, target_values(d, results, rerun)
