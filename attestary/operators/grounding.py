"""Provenance: find values and quotes in the documents of their own job.

Containment has no join key of its own, and a job may hold a third of all documents, so
testing every needle against every document of its job is not an option. Instead both sides are
cut into *anchors*, hashes that any document containing the needle must share with it:

* word and word-pair hashes, for needles matched at word boundaries;
* the minimal 5-character grams of 7 consecutive positions of the text without spaces, for needles
  matched inside words: every 11 characters hold such a window whole, whatever surrounds it.

For each anchor only its first document is kept, which collapses a hot anchor before the
shuffle. The latest of these firsts over all anchors of a needle is a lower bound for the document
sought; if the needle is there, it is the answer. The few needles for which it is not go on to
all documents that share their rarest anchor. Every candidate is checked on the text itself, so
hash collisions cost time and never a wrong answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from attestary import fixed
from attestary.functions.text import excerpt, flatten_text, fold_with_origin, has_whole, norm, squash, strip
from attestary.functions.values import date_variants
from attestary.operators.pages import page_of, page_starts
from attestary.session import shared_dir, stage

GRAM, WINDOW = 5, 7
GRAM_FROM = GRAM + WINDOW - 1
DOC = ["job_id", "derived", "doc_no"]
# the filter of sought anchors: a block of 64 bits per word, four bits per anchor, one array of words per job group
FILTER_GROUPS, FILTER_WORDS, FILTER_BITS = 16, 1 << 14, 4
# of the needles that share a document, about this many parts go to Python apart
PARTS = 16


# --- anchors --------------------------------------------------------------------------------

_PRIME = 0x9E3779B97F4A7C15


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0 to n - 1, modulo 2^64."""
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


class _Hashes:
    """Hashes of the words, word pairs and minimal grams of texts in normal form, a text at a time in a few array steps."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word: a sum of characters by powers, moved from the word's place to 0."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(codes)
        if n >= len(self.up):
            self.up, self.down = (_powers(base, 2 * n + 1024) for base in (_PRIME, pow(_PRIME, -1, 1 << 64)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=sums[1:])
        blanks = np.flatnonzero(codes == np.uint64(32))
        starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [n]])
        return _spread((sums[ends] - sums[starts]) * self.down[starts])

    @staticmethod
    def pairs(words: np.ndarray) -> np.ndarray:
        return _spread(words[:-1] * np.uint64(31) + words[1:])

    @staticmethod
    def grams(text: str) -> np.ndarray:
        """Minimal gram hashes over all windows of a text without its spaces."""
        codes = np.frombuffer(text.replace(" ", "").encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(codes) - GRAM + 1
        if n < WINDOW:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(GRAM):
            h = h * np.uint64(1_000_003) + codes[i:i + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        low = h[:n - WINDOW + 1].copy()
        for i in range(1, WINDOW):
            np.minimum(low, h[i:n - WINDOW + 1 + i], out=low)
        return low


def sought_anchors(filters: np.ndarray):
    """Distinct hashes of all words, word pairs and minimal grams of a text in normal form that pass the filter of its
    group; ``filters``: a row of ``anchor_filter`` words for each group."""
    @pandas_udf(T.ArrayType(T.LongType()))
    def run(normals: pd.Series, groups: pd.Series) -> pd.Series:
        hashes, out = _Hashes(), []
        for text, group in zip(normals, groups):
            words = hashes.words(text)
            a = np.concatenate([words, hashes.pairs(words), hashes.grams(text)])
            held = filters[group][((a >> np.uint64(30)) & np.uint64(FILTER_WORDS - 1)).astype(np.int64)]
            passing = np.ones(len(a), bool)
            for i in range(FILTER_BITS):
                passing &= (held >> ((a >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
            out.append(np.unique(a[passing]).view(np.int64))
        return pd.Series(out, dtype=object)
    return run


@pandas_udf(T.ArrayType(T.LongType()))
def needle_anchors(needles: pd.Series, wholes: pd.Series) -> pd.Series:
    """Those of its hashes that any document with the needle must share."""
    hashes = _Hashes()

    def one(needle, whole):
        if not isinstance(needle, str):
            return None
        n = len(needle.replace(" ", ""))
        if n >= fixed.SQUASHED_FROM or (not whole and n >= GRAM_FROM):
            return np.unique(hashes.grams(needle)).view(np.int64)
        # inside-word matching says nothing about the first and last word
        sure = hashes.words(needle)[slice(None) if whole else slice(1, -1)]
        return np.unique(hashes.pairs(sure) if len(sure) > 1 else sure).view(np.int64)
    return pd.Series([one(x, w) for x, w in zip(needles, wholes)], dtype=object)


def matches(normal: Column, needle: Column, whole: Column) -> Column:
    """Exact test of one needle against one document, both in normal form."""
    plain = F.when(whole, has_whole(normal, needle)).otherwise(F.contains(normal, needle))
    squashed = F.contains(squash(normal), squash(needle))
    return F.when(F.length(squash(needle)) >= fixed.SQUASHED_FROM, squashed).otherwise(plain)


# --- the index and the search ---------------------------------------------------------------

def source_index(docs: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """``(job_id, derived, doc_no, filename, markdown)``; derived texts come after all documents.

    Normal forms are made where they are needed. To keep them, and to search the same documents again,
    write the index with :func:`store_index`.
    """
    def rows(df: DataFrame, flag: bool) -> DataFrame:
        name = F.coalesce(F.nullif("filename", F.lit("")), F.lit("document"))
        return (df.where(F.length("markdown") > 0)
                .select("job_id", F.lit(flag).alias("derived"), F.col("doc_no").cast("bigint").alias("doc_no"),
                        name.alias("filename"), "markdown"))
    found = rows(docs, False)
    return found if derived is None else found.unionByName(rows(derived, True))


def store_index(index: DataFrame, table: str | None = None, buckets: int | None = None) -> DataFrame:
    """The index as a table bucketed by document, with normal forms; an existing ``table`` is appended to.

    Whatever meets a document later joins by its bucket, so texts are shuffled once, here, and never
    again. ``buckets`` (the session's shuffle partitions) must be the same for all appends. Without a
    name the table is one of this session, in the shared folder.
    """
    spark = index.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select(*DOC, "filename", "markdown", norm(F.col("markdown")).alias("normal")).repartition(n, *DOC)
    writer = rows.write.format("parquet").mode("append").bucketBy(n, *DOC).sortBy(*DOC)
    if table is None:
        path = shared_dir(spark, "source-index")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return spark.table(table)


def _whole(needle: Column, asked: Column) -> Column:
    return asked | (F.length(needle) < fixed.WHOLE_WORD_BELOW)


def _ord() -> Column:
    """Documents in order: derived texts last."""
    return F.struct("derived", "doc_no")


def _normal(index: DataFrame) -> Column:
    return F.col("normal") if "normal" in index.columns else norm(F.col("markdown"))


def _normals_of(index: DataFrame, candidates: DataFrame) -> DataFrame:
    """Normal forms of the documents that hold a candidate, and of no others."""
    held = candidates.select("job_id", "ord.derived", "ord.doc_no").distinct()
    return index.join(held, DOC, "left_semi").select(*DOC, _normal(index).alias("normal"))


def _checked(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """``candidates`` with the normal form of their document; documents stay where their bucket is."""
    return (candidates.withColumns({"derived": F.col("ord.derived"), "doc_no": F.col("ord.doc_no")})
            .join(_normals_of(index, candidates), DOC))


@pandas_udf(T.ArrayType(T.BooleanType()))
def _held(normals: pd.Series, needles: pd.Series) -> pd.Series:
    """Which of its needles a text holds, as :func:`matches`; the text loses its spaces once for all of them."""
    out = []
    for normal, wanted in zip(normals, needles):
        padded, tight = f" {normal} ", normal.replace(" ", "")

        def one(needle: str, whole: bool) -> bool:
            short = needle.replace(" ", "")
            if len(short) >= fixed.SQUASHED_FROM:
                return short in tight
            return f" {needle} " in padded if whole else needle in normal
        out.append([one(n["needle"], n["whole"]) for n in wanted])
    return pd.Series(out, dtype=object)


def _holders(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """The ``candidates(job_id, needle, whole, ord)`` whose document holds the needle.

    Needles come to their document in at most ``PARTS`` groups, so no text is tested once per needle row.
    """
    part = F.pmod(F.xxhash64("needle"), F.lit(PARTS))
    wanted = (candidates.groupBy("job_id", F.col("ord.derived").alias("derived"), F.col("ord.doc_no").alias("doc_no"), part.alias("_part"))
              .agg(F.collect_set(F.struct("needle", "whole")).alias("_n")))
    tested = _normals_of(index, candidates).join(wanted, DOC).withColumn("_ok", _held("normal", "_n"))
    kept = F.filter(F.arrays_zip("_n", "_ok"), lambda x: x["_ok"])
    return (tested.select("job_id", _ord().alias("ord"), F.explode(kept).alias("_k"))
            .select("job_id", F.col("_k._n.needle").alias("needle"), F.col("_k._n.whole").alias("whole"), "ord"))


def _job_group() -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(FILTER_GROUPS)).cast("int")


def _block(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, 30).bitwiseAND(FILTER_WORDS - 1).cast("int")


def _bits(anchor: Column) -> Column:
    """The bits an anchor has in its block."""
    out = None
    for i in range(FILTER_BITS):
        at = F.shiftrightunsigned(anchor, 6 * i).bitwiseAND(63).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def anchor_filter(terms: DataFrame) -> DataFrame:
    """``grp, words``: a blocked Bloom filter of the anchors sought in each group of jobs.

    At most ``FILTER_GROUPS`` rows of ``FILTER_WORDS`` numbers, however many anchors there are; where
    they are too many for it, more anchors pass to the exact join behind it.
    """
    blocks = (terms.groupBy(_job_group().alias("grp"), _block(F.col("anchor")).alias("at"))
              .agg(F.bit_or(_bits(F.col("anchor"))).alias("bits")))
    each = F.transform(F.sequence(F.lit(0), F.lit(FILTER_WORDS - 1)), lambda i: F.struct(i.alias("at"), F.lit(0).cast("bigint").alias("bits")))
    empty = blocks.select("grp").distinct().select("grp", F.inline(each))
    dense = empty.unionByName(blocks).groupBy("grp", "at").agg(F.bit_or("bits").alias("bits"))
    return dense.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("words"))


def _postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``(job_id, anchor, ord)`` of the sought anchors.

    Each document's anchors pass the filter of its job group before they become rows, so what goes on
    to the exact join is what is sought, and little else.
    """
    filters = np.zeros((FILTER_GROUPS, FILTER_WORDS), np.uint64)
    for r in anchor_filter(terms).collect():  # FILTER_GROUPS rows of FILTER_WORDS numbers
        filters[r.grp] = np.array(r.words, np.int64).view(np.uint64)
    normals = index.select(*DOC, _job_group().alias("grp"), _normal(index).alias("normal")).where("normal IS NOT NULL")
    found = normals.select("job_id", _ord().alias("ord"), F.explode(sought_anchors(filters)("normal", "grp")).alias("anchor"))
    return found.join(terms.select("job_id", "anchor").distinct(), ["job_id", "anchor"], "left_semi")


def find(needles: DataFrame, index: DataFrame) -> DataFrame:
    """First document of its job that holds each needle.

    ``needles(job_id, needle, whole)`` in normal form; returns them with ``ord``, one row per
    distinct needle that is found.
    """
    key = ["job_id", "needle", "whole"]
    # a needle has dozens of anchors, so they carry its digest and not its text
    digest = F.unhex(F.md5(F.concat("needle", F.when(F.col("whole"), "|w").otherwise("|s"))))
    asked = stage(
        needles.where(F.length("needle") > 0)
        .select("job_id", "needle", _whole(F.col("needle"), F.col("whole")).alias("whole"))
        .distinct().withColumn("nid", digest), "needles")
    terms = stage(asked.withColumn("_a", needle_anchors(F.col("needle"), F.col("whole")))
                  .select("job_id", "nid", F.size("_a").alias("n"), F.explode("_a").alias("anchor")),
                  "needle-anchors")
    # only sought anchors go on from the documents: thin enough to keep for both passes
    postings = stage(_postings(index, terms), "postings")

    # aggregated before it meets the needles: map-side, a hot anchor is one row per task
    firsts = postings.groupBy("job_id", "anchor").agg(
        F.min("ord").alias("first"), F.count(F.lit(1)).alias("df"))
    bounds = stage(
        terms.join(firsts, ["job_id", "anchor"])
        .groupBy("job_id", "nid")
        .agg(F.max("first").alias("ord"), F.count(F.lit(1)).alias("found"), F.max("n").alias("n"),
             F.min(F.struct("df", "anchor"))["anchor"].alias("anchor"))
        .where("found = n").select("job_id", "nid", "ord", "anchor"), "needle-bounds")
    ok = matches(F.col("normal"), F.col("needle"), F.col("whole"))
    checked = stage(_checked(bounds.join(asked, ["job_id", "nid"]), index)
                    .select(*key, "ord", "anchor", ok.alias("ok")), "needle-checks")
    found = checked.where("ok").select(*key, "ord")

    # needles whose bound failed: later documents that hold their rarest anchor
    open_ = checked.where("NOT ok").select(*key, "anchor", F.col("ord").alias("bound"))
    later = stage(postings.join(open_, ["job_id", "anchor"]).where(F.col("ord") > F.col("bound"))
                  .select(*key, "ord"), "needle-candidates")
    rest = _holders(later, index).groupBy(*key).agg(F.min("ord").alias("ord"))
    return found.unionByName(rest)


# --- where in the document ------------------------------------------------------------------

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
_NEVER = (None, None)


class _Places:
    """Where needles stand in one text: its normal form and the offset of each of its characters."""

    def __init__(self, text: str):
        self.normal, self.origin = fold_with_origin(text)
        self.padded, self.tight = f" {self.normal} ", self.normal.replace(" ", "")
        codes = np.frombuffer(self.normal.encode("utf-32-le"), dtype="<u4")
        self.solid = np.flatnonzero(codes != ord(" "))

    def of(self, needle: str, whole: bool) -> tuple:
        at = self.padded.find(f" {needle} ") if whole else self.normal.find(needle)
        first, last = at, at + len(needle) - 1
        if at < 0:
            short = needle.replace(" ", "")
            at = self.tight.find(short)
            if at < 0 or not short:
                return _NEVER
            first, last = self.solid[at], self.solid[at + len(short) - 1]
        return int(self.origin[first]), int(self.origin[last]) + 1


@pandas_udf(_SPANS)
def _spans(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Offsets of every needle of a text; the text is folded once for all of them."""
    out = []
    for text, wanted in zip(texts, needles):
        places = _Places(text)
        out.append([places.of(n["needle"], n["whole"]) for n in wanted])
    return pd.Series(out, dtype=object)


def locate(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Adds document, page, excerpt, match and offset to ``hits(job_id, ord, needle, whole, …)``.

    Needles come to their document, not the document to each needle: a text is read once per part
    of its needles. The page is the last heading at or before the hit: page starts and hits of a
    document are merged in order and swept once.
    """
    key = [*DOC, "needle", "whole"]
    flat = hits.withColumns({"derived": F.col("ord.derived"), "doc_no": F.col("ord.doc_no")})
    part = F.pmod(F.xxhash64("needle"), F.lit(PARTS))
    wanted = (flat.groupBy(*DOC, part.alias("_part")).agg(F.collect_set(F.struct("needle", "whole")).alias("_n")))
    text = F.col("markdown")
    found = F.transform(F.arrays_zip("_n", "_at"), lambda x: F.struct(
        x["_n"]["needle"].alias("needle"), x["_n"]["whole"].alias("whole"),
        excerpt(text, x["_at"]["start"], x["_at"]["stop"]).alias("source_excerpt"),
        flatten_text(F.substring(text, x["_at"]["start"] + 1, x["_at"]["stop"] - x["_at"]["start"])).alias("source_match"),
        x["_at"]["start"].alias("offset")))
    placed = (index.join(wanted, DOC).withColumn("_at", _spans(text, F.col("_n")))
              .select(*DOC, F.col("filename").alias("source_document"), F.inline(found)))
    placed = stage(placed, "places")
    starts = page_starts(index.join(placed.select(*DOC).distinct(), DOC, "left_semi"), DOC)
    paged = page_of(starts, placed, DOC).withColumnsRenamed({"page": "source_page", "offset": "source_offset"})
    return flat.join(paged, key).drop("derived", "doc_no")


# --- quotes and values ----------------------------------------------------------------------

QUOTE, SEGMENT, VALUE = 0, 1, 2


def asked_needles(results: DataFrame) -> DataFrame:
    """Everything to look for: the quote, its segments, each spelling of the value.

    ``results(job_id, field_id, value, source_quote)``; one row per needle with its ``kind`` and
    its rank within the kind (smaller is tried first).
    """
    value = strip(F.coalesce("value", F.lit("")))
    quote = strip(F.coalesce("source_quote", F.lit("")))
    segments = F.split(quote, r"[;.][\s\x1c-\x1f\x85\p{Z}]+|\n+", -1)
    spellings = F.concat(F.array(value), date_variants(value))

    def tag(kind: int, texts: Column) -> Column:
        return F.transform(texts, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), x.alias("raw")))
    rows = F.concat(tag(QUOTE, F.array(quote)), tag(SEGMENT, segments), tag(VALUE, spellings))
    n = F.length("needle")
    least = F.when(F.col("kind") == VALUE, fixed.MIN_VALUE_CHARS).otherwise(fixed.MIN_QUOTE_CHARS)
    # the quote is folded once, before its segments become rows
    return (results.select("job_id", "field_id", norm(quote).alias("quote_norm"), rows.alias("rows"))
            .select("job_id", "field_id", "quote_norm", F.explode("rows").alias("r"))
            .select("job_id", "field_id", "quote_norm", "r.kind", "r.at", norm(F.col("r.raw")).alias("needle"))
            .withColumn("kept", n >= least)
            # the first spelling says whether the value can be checked at all
            .where(F.col("kept") | ((F.col("kind") == VALUE) & (F.col("at") == 0)))
            .withColumn("rank", F.when(F.col("kind") == SEGMENT, F.struct((-n).alias("a"), "at"))
                        .otherwise(F.struct(F.lit(0).alias("a"), "at")))
            .withColumn("whole", _whole(F.col("needle"), F.col("kind") == VALUE))
            .withColumn("in_quote", F.coalesce(
                F.col("kept") & (F.col("kind") == VALUE) & has_whole(F.col("quote_norm"), F.col("needle")), F.lit(False)))
            .drop("at", "quote_norm"))


def _found(results: DataFrame, index: DataFrame) -> DataFrame:
    """Per result: quote hit, best segment hit, best value hit, and what was asked."""
    asks = stage(asked_needles(results), "asked")
    hits = find(asks.where("kept").select("job_id", "needle", "whole"), index)
    joined = asks.join(hits, ["job_id", "needle", "whole"], "left")

    def best(kind: int) -> Column:
        hit = F.when((F.col("kind") == kind) & F.col("ord").isNotNull() & F.col("kept"),
                     F.struct("rank", "ord", "needle", "whole"))
        return F.min(hit)
    return joined.groupBy("job_id", "field_id").agg(
        best(QUOTE).alias("quote"), best(SEGMENT).alias("segment"), best(VALUE).alias("value"),
        F.max((F.col("kind") == VALUE) & F.col("kept")).alias("checkable"),
        F.max("in_quote").alias("in_quote"))


def locate_quote(results: DataFrame, index: DataFrame) -> DataFrame:
    """First document holding the quote whole, else its longest segment (``partial``)."""
    asked = results.withColumn("value", F.lit(None).cast("string"))
    hit = F.coalesce("quote", "segment")
    return (_found(asked, index).where(hit.isNotNull())
            .select("job_id", "field_id", hit["ord"]["doc_no"].alias("doc_no"),
                    F.col("quote").isNull().alias("partial"), hit["needle"].alias("needle")))


def ground(results: DataFrame, index: DataFrame, anchors: bool = True) -> DataFrame:
    """Verdict per result, and where the evidence is.

    ``anchors=False`` leaves out page, excerpt and match, which need the original texts.
    """
    f = _found(results, index)
    quote_hit = F.coalesce("quote", "segment")
    in_whole_quote = F.col("quote").isNotNull() & F.col("in_quote")
    by_value = F.col("checkable") & ~in_whole_quote & F.col("value").isNotNull()
    anchor = F.when(by_value, F.col("value")).otherwise(quote_hit)

    def grade(strong: str) -> Column:
        return F.when(anchor["ord"]["derived"], "inferred").otherwise(strong)
    verdict = (F.when(~F.col("checkable"),
                      F.when(quote_hit.isNotNull(), "not_checkable").otherwise("unverified"))
               .when(in_whole_quote, grade("verified"))
               .when(F.col("value").isNotNull(), grade("attested"))
               .when(quote_hit.isNotNull(), "inferred")
               .otherwise("unverified"))
    judged = f.select("job_id", "field_id", verdict.alias("grounding"),
                      quote_hit.isNotNull().alias("quote_verified"),
                      anchor["ord"].alias("ord"), anchor["needle"].alias("needle"),
                      anchor["whole"].alias("whole"))
    if not anchors:
        return judged
    judged = stage(judged, "verdicts")
    placed = locate(judged.where("ord IS NOT NULL"), index).drop("ord", "needle", "whole")
    return (judged.drop("ord", "needle", "whole")
            .join(placed.drop("grounding", "quote_verified"), ["job_id", "field_id"], "left"))


def annotate(results: DataFrame, scores: DataFrame, index: DataFrame) -> DataFrame:
    """Results with rerank score and, for non-empty values, their verdict; no value is removed."""
    answered = F.col("error").isNull()
    filled = results.where(answered & (strip(F.coalesce("value", F.lit(""))) != ""))
    grounded = ground(filled.select("job_id", "field_id", "value", "source_quote"), index)
    score = F.when(answered, F.bround(F.coalesce("score", F.lit(0.0)), 4))
    return (results.join(scores.select("job_id", "field_id", "score"), ["job_id", "field_id"], "left")
            .withColumn("rerank_score", score).drop("score")
            .join(grounded, ["job_id", "field_id"], "left"))
