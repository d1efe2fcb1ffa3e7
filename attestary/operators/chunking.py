"""Chunks: heading sections, word windows, dense numbers that survive a giant dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestary import fixed
from attestary.functions.text import strip, words
from attestary.operators.numbering import running_offsets
from attestary.session import stage


def with_source_header(docs: DataFrame) -> DataFrame:
    return docs.withColumn("markdown", F.concat(
        F.lit("\n\n--- SOURCE: "), F.col("filename"), F.lit(" ---\n\n"), F.col("markdown")))


def heading_sections(text: Column) -> Column:
    """Parts starting at level 1 to 3 headings, stripped, empty ones dropped."""
    parts = F.transform(F.split(text, r"(?=\n#{1,3} )", -1), strip)
    return F.filter(parts, lambda p: p != "")


def word_windows(section: Column, size: int = fixed.CHUNK_WORDS,
                 step: int = fixed.CHUNK_STEP) -> Column:
    """Overlapping windows of a long section; a short one is kept verbatim."""
    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))
        return F.when(F.size(w) > size, F.transform(
            starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))) \
            .otherwise(F.array(section))
    # the one-element array binds the split words, so they are split once per section; a section
    # too short to hold more than ``size`` words is not split at all
    return F.when(F.length(section) < 2 * size, F.array(section)) \
        .otherwise(F.element_at(F.transform(F.array(words(section)), cut), 1))


def chunk_texts(text: Column) -> Column:
    return F.flatten(F.transform(heading_sections(text), lambda s: word_windows(s)))


def chunk_documents(docs: DataFrame, col: str = "markdown") -> DataFrame:
    """``(job_id, doc_no, part, text)``, ``part`` counting within the document."""
    # the outer form: an inner one has Spark test the size of the array, which cuts the text again
    return (docs.select("job_id", "doc_no", chunk_texts(F.col(col)).alias("_c"))
            .select("job_id", "doc_no", F.posexplode_outer("_c").alias("part", "text"))
            .where("part IS NOT NULL"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_no``: 0, 1, 2 … per job, in document and part order.

    The chunks are staged, so documents are cut once; the count reads their numbers alone.
    """
    chunks = stage(chunks, "chunk-texts")
    counts = chunks.groupBy("job_id", "doc_no").agg(F.count(F.lit(1)).alias("n"))
    return (chunks.join(running_offsets(counts, "job_id", "doc_no", "n"), ["job_id", "doc_no"])
            .withColumn("chunk_no", (F.col("offset") + F.col("part")).cast("bigint"))
            .drop("offset"))


def chunk_id(job_id: Column, chunk_no: Column) -> Column:
    return F.concat_ws("_", job_id, chunk_no.cast("string"))


def embedding_batches(chunks: DataFrame, size: int = fixed.EMBED_BATCH) -> DataFrame:
    return chunks.withColumn("embed_batch", F.floor(F.col("chunk_no") / size).cast("bigint"))
