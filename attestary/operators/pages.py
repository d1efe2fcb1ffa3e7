"""Text layer: page cleaning, routing, assembly, content cache, page lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestary import fixed
from attestary.functions.text import clean_text, page_marks, strip


def page_usable(text: Column) -> Column:
    """Long enough, and few replacement characters."""
    broken = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return ((F.length(strip(text)) >= fixed.MIN_PAGE_CHARS)
            & (F.try_divide(broken, F.length(text)) <= fixed.MAX_REPLACEMENT_SHARE))


def text_layer_ratio(pages: DataFrame) -> DataFrame:
    """Usable share per document; a document without pages is a row with NULL ``page_no``."""
    usable = F.count_if(F.col("page_no").isNotNull()
                        & F.coalesce(page_usable(clean_text(F.col("text"))), F.lit(False)))
    n = F.count("page_no")
    return (pages.groupBy("job_id", "doc_no").agg(n.alias("pages"), usable.alias("usable"))
            .withColumn("ratio", F.when(F.col("pages") == 0, 0.0)
                        .otherwise(F.col("usable") / F.col("pages"))))


def route_documents(ratios: DataFrame, force_ocr: bool = False) -> DataFrame:
    native = (F.col("pages") > 0) & (F.col("ratio") >= fixed.MIN_USABLE_SHARE) & F.lit(not force_ocr)
    return ratios.withColumn("mode", F.when(native, "text_layer").otherwise("ocr"))


def assemble_document(pages: DataFrame) -> DataFrame:
    """Cleaned pages in order under ``## Page N`` headings: one text per document."""
    page = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"),
                    clean_text(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", page.alias("page"))))
    return pages.groupBy("job_id", "doc_no").agg(
        F.array_join(F.transform(ordered, lambda p: p["page"]), "\n\n").alias("markdown"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached text, distinct contents still to be read).

    A content repeated a million times is one row before it meets the cache.
    """
    keyed = files.withColumn("content_hash", content_hash(F.col("content")))
    hits = keyed.drop("content").join(cache, "content_hash")
    misses = (keyed.select("content_hash", "job_id", "doc_no").groupBy("content_hash")
              .agg(F.min(F.struct("job_id", "doc_no")).alias("first"),
                   F.count(F.lit(1)).alias("copies"))
              .join(cache.select("content_hash"), "content_hash", "left_anti")
              .select("content_hash", "first.job_id", "first.doc_no", "copies"))
    return hits, misses


def cache_evict(cache: DataFrame, size: int = fixed.CACHE_SIZE) -> DataFrame:
    """The newest ``size`` entries: first in, first out."""
    return cache.orderBy(F.desc("cached_at"), "content_hash").limit(size)


def page_starts(docs: DataFrame, key: Sequence[str] = ("job_id", "doc_no")) -> DataFrame:
    """The ``key`` of a document with ``start, page``, one row per page heading."""
    return docs.select(*key, page_marks(F.col("markdown")).alias("_t")).select(*key, F.inline("_t"))


def page_of(starts: DataFrame, hits: DataFrame, key: Sequence[str] = ("job_id", "doc_no")) -> DataFrame:
    """Page of each hit (``key``, ``offset``, ...): the last heading at or before it.

    Headings and hits are merged and swept once per document, so no heading meets every hit.
    """
    extra = [c for c in hits.columns if c not in (*key, "offset")]
    marks = starts.select(
        *key, F.col("start").alias("offset"), F.lit(0).alias("_hit"),
        F.col("page").alias("_page"), *[F.lit(None).cast(hits.schema[c].dataType).alias(c)
                                        for c in extra])
    asked = hits.select(*key, "offset", F.lit(1).alias("_hit"),
                        F.lit(None).cast("int").alias("_page"), *extra)
    w = (W.partitionBy(*key).orderBy("offset", "_hit")
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (marks.unionByName(asked)
            .withColumn("page", F.last("_page", ignorenulls=True).over(w))
            .where("_hit = 1").drop("_hit", "_page"))
