"""Batches, synthesis parts and prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestary import fixed
from attestary.fixed import (ANSWER_HEAD, CHAT_HEADS, CHAT_OPEN, CHAT_READY, CHAT_SYSTEM, CHOICE_HINT, EXCERPTS_HEAD,
                             FIELDS_HEAD, SYNTHESIS_HEAD)
from attestary.functions.paths import section_of
from attestary.functions.text import estimate_tokens
from attestary.operators.admission import nonblank_docs
from attestary.operators.numbering import number_rows, running_offsets, running_sums
from attestary.session import stage


def batch_fields(fields: DataFrame, size: int = fixed.BATCH_FIELDS) -> DataFrame:
    """Adds ``section``, ``batch_no`` (from 0) and ``field_ord`` within the form.

    Sections come in the order of their first field, ``size`` fields to a batch.
    """
    rows = number_rows(fields.withColumn("section", section_of(F.col("field_id"))),
                       ["form_id", "section"], "ord", "_n")
    rows = rows.withColumn("_cut", F.floor(F.col("_n") / size))
    # batches are numbered as a table of their own, ``size`` times fewer rows than fields
    firsts = rows.groupBy("form_id", "section").agg(F.min("ord").alias("_first"))
    batches = rows.select("form_id", "section", "_cut").distinct().join(firsts, ["form_id", "section"])
    place = F.row_number().over(W.partitionBy("form_id").orderBy("_first", "_cut")) - 1
    batches = batches.select("form_id", "section", "_cut", place.cast("bigint").alias("batch_no"))
    return (rows.join(batches, ["form_id", "section", "_cut"])
            .withColumnRenamed("ord", "field_ord").drop("_n", "_cut"))


# --- synthesis ------------------------------------------------------------------------------

_EMPTY_JSON = ["null", '""', "[]", "{}", "0", "0.0", "false"]


def synthesis_slice(synthesis: Column, section: Column) -> Column:
    """JSON of the parts that serve a section, empty ones dropped; NULL if none is left."""
    parts = F.try_parse_json(synthesis).try_cast("map<string,variant>")
    wanted = F.create_map(*[x for s, keys in fixed.SECTION_PARTS.items()
                            for x in (F.lit(s), F.array(*[F.lit(k) for k in keys]))])
    keys = F.coalesce(F.try_element_at(wanted, section), F.map_keys(parts))
    pairs = F.filter(
        F.transform(keys, lambda k: F.struct(k.alias("k"),
                                             F.to_json(F.try_element_at(parts, k)).alias("v"))),
        lambda p: p["v"].isNotNull() & ~p["v"].isin(_EMPTY_JSON))
    text = F.concat(F.lit("{"), F.array_join(F.transform(
        pairs, lambda p: F.concat(F.lit('"'), p["k"], F.lit('": '), p["v"])), ", "), F.lit("}"))
    return F.when(F.size(pairs) > 0, text)


def _document_block(name: Column, text: Column) -> Column:
    return F.concat(F.lit("--- DOCUMENT : "), name, F.lit(" ---\n\n"), text)


def synthesis_plan(docs: DataFrame, limit: int = fixed.DIRECT_TOKENS) -> DataFrame:
    """Token estimate and strategy per job, from text lengths alone."""
    block = F.length(_document_block(F.col("filename"), F.lit(""))) + F.length("markdown")
    chars = (F.sum(block) + (F.count(F.lit(1)) - 1) * len(fixed.DOCUMENT_SEPARATOR)).cast("bigint")
    return (nonblank_docs(docs).groupBy("job_id")
            .agg(F.count(F.lit(1)).alias("documents"), chars.alias("chars"))
            .withColumn("tokens", F.floor(F.col("chars") / 4).cast("bigint"))
            .withColumn("strategy", F.when(F.col("tokens") <= limit, "direct")
                        .otherwise("hierarchical")))


def synthesis_prompts(docs: DataFrame, plan: DataFrame, direct: str = "{docs}",
                      single: str = "DOCUMENT : {name}\n\nCONTENU :\n{docs}") -> DataFrame:
    """One prompt per job under the limit, one per document above it.

    ``direct`` and ``single`` are the instruction texts around ``{docs}`` and ``{name}``. Only jobs
    under the token limit are gathered, so no gathered text exceeds that limit.
    """
    def fill(template: str, **parts: Column) -> Column:
        text = F.lit(template)
        for name, value in parts.items():
            text = F.replace(text, F.lit("{" + name + "}"), value)
        return text
    rows = nonblank_docs(docs).join(plan.select("job_id", "strategy"), "job_id")
    small, large = rows.where("strategy = 'direct'"), rows.where("strategy = 'hierarchical'")
    blocks = F.array_sort(F.collect_list(F.struct(
        "doc_no", _document_block(F.col("filename"), F.col("markdown")).alias("t"))))
    joined = F.array_join(F.transform(blocks, lambda b: b["t"]), fixed.DOCUMENT_SEPARATOR)
    whole = (small.groupBy("job_id").agg(joined.alias("t"))
             .select("job_id", F.lit(None).cast("bigint").alias("doc_no"),
                     fill(direct, docs=F.col("t")).alias("prompt")))
    single_rows = large.select(
        "job_id", F.col("doc_no").cast("bigint").alias("doc_no"),
        fill(single, name=F.col("filename"), docs=F.col("markdown")).alias("prompt"))
    return whole.unionByName(single_rows)


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """``(job_id, part, doc_no, document_source, entry_no, entry)``: every entry of every part of all summaries.

    ``summaries(job_id, doc_no, filename, summary)`` with JSON objects, NULL for failures. A list gives
    an entry per element, anything else one; nested values are JSON texts. The result stays a table: a
    dossier's merged lists grow with it.
    """
    parts = F.from_json("summary", "map<string,string>")
    listed = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>"))
    return (summaries.where("summary IS NOT NULL")
            .select("job_id", "doc_no", F.col("filename").alias("document_source"),
                    F.explode(parts).alias("part", "value"))
            .select("job_id", "part", "doc_no", "document_source",
                    F.posexplode(F.coalesce(listed, F.array("value"))).alias("entry_no", "entry"))
            .where("entry IS NOT NULL"))


def _json_text(c: Column) -> Column:
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def synthesis_entries(summaries: DataFrame) -> DataFrame:
    """``(job_id, at, text)``: the merged synthesis of every job with several summaries as a row of short texts.

    In order of ``at``, their first offset, the texts make one JSON object with all entries of all
    summaries under their part, each with its document. Offsets are running sums over blocks, so a job
    of any size is spread over tasks and never gathered.
    """
    ok = summaries.where("summary IS NOT NULL")
    several = ok.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("job_id")
    nested = F.col("entry").rlike(r"^\s*[\[{]") & F.try_parse_json("entry").isNotNull()
    item = F.concat(F.lit('{"document_source": '), _json_text(F.col("document_source")), F.lit(', "valeur": '),
                    F.when(nested, F.col("entry")).otherwise(_json_text(F.col("entry"))), F.lit("}"))
    # every entry is led by a comma; the first of a part, an entry of its own, opens it and has no comma behind it
    entries = (merge_summaries(ok).join(several, "job_id", "left_semi")
               .select("job_id", "part", F.col("doc_no").cast("bigint").alias("doc_no"), F.col("entry_no").cast("bigint").alias("entry_no"), item.alias("item")))
    entries = stage(entries.withColumn("size", F.length("item").cast("bigint") + 2), "synthesis-entries")
    parts = entries.groupBy("job_id", "part").agg(F.sum("size").alias("size"))
    # a handful of parts per job: each opens with its name, and the last one closes the object
    by_part = W.partitionBy("job_id").orderBy("part")
    opening = F.concat(F.when(F.col("k") == 1, "{").otherwise("], "), _json_text(F.col("part")), F.lit(": ["))
    parts = parts.withColumn("k", F.row_number().over(by_part)).withColumn("opening", opening)
    # the comma of a part's first entry is not written
    whole = F.length("opening") + F.col("size") - 2
    before = F.coalesce(F.sum(whole).over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = stage(parts.withColumns({"before": before, "whole": whole}), "synthesis-parts")
    placed = running_sums(entries, ["job_id", "part"], "doc_no", ["entry_no", "item"], "size", "ahead")
    start = F.col("before") + F.length("opening") + F.greatest(F.col("ahead") - 2, F.lit(0))
    texts = (placed.join(parts.select("job_id", "part", "opening", "before"), ["job_id", "part"])
             .select("job_id", start.cast("bigint").alias("at"), F.when(F.col("ahead") == 0, F.col("item")).otherwise(F.concat(F.lit(", "), "item")).alias("text")))
    heads = parts.select("job_id", F.col("before").cast("bigint").alias("at"), F.col("opening").alias("text"))
    ends = parts.groupBy("job_id").agg(F.max(F.col("before") + F.col("whole")).cast("bigint").alias("at")).withColumn("text", F.lit("]}"))
    return texts.unionByName(heads).unionByName(ends)


def synthesis_pieces(summaries: DataFrame, size: int = fixed.SYNTHESIS_PIECE) -> DataFrame:
    """``(job_id, piece_no, text)``: the synthesis of every job that has one, in pieces of about ``size`` characters.

    A single summary is left as it is, in one piece; otherwise a piece holds the entries that begin in
    its stretch of the merged object, so it is longer than ``size`` by one entry at most. Joined in order
    the pieces are the whole object; no entry is cut or left out, whatever the size of the job.
    """
    ok = summaries.where("summary IS NOT NULL")
    single = (ok.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min("summary").alias("text")).where("n = 1")
              .select("job_id", F.lit(0).cast("bigint").alias("piece_no"), "text"))
    rows = F.array_sort(F.collect_list(F.struct("at", "text")))  # at most ``size`` characters and one entry
    merged = (synthesis_entries(summaries).groupBy("job_id", F.floor(F.col("at") / size).cast("bigint").alias("piece_no"))
              .agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("text")))
    return single.unionByName(merged)


def merged_synthesis(jobs: DataFrame, summaries: DataFrame, limit: int = fixed.DIRECT_TOKENS) -> DataFrame:
    """``(job_id, synthesis)`` of every job: NULL without a summary, a single summary as it is, else a
    JSON object with all entries of all summaries under their part, each with its document.

    A merged object beyond ``limit`` tokens is no prompt; it stays in :func:`synthesis_pieces` and is
    NULL here.
    """
    pieces = stage(synthesis_pieces(summaries), "synthesis-pieces")
    given = summaries.where("summary IS NOT NULL").groupBy("job_id").agg(F.count(F.lit(1)).alias("given"))
    small = (pieces.groupBy("job_id").agg(F.sum(F.length("text")).alias("n")).join(given, "job_id")
             .where((F.col("n") <= limit * 4) | (F.col("given") == 1)))
    rows = F.array_sort(F.collect_list(F.struct("piece_no", "text")))  # of jobs under the limit
    whole = (pieces.join(small.select("job_id"), "job_id", "left_semi").groupBy("job_id")
             .agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("synthesis")))
    return jobs.select("job_id").join(whole, "job_id", "left").select("job_id", "synthesis")


def derived_docs(synthesis: DataFrame) -> DataFrame:
    """The synthesis as a searchable text, marked as derived."""
    return synthesis.where("synthesis IS NOT NULL").select(
        "job_id", F.lit(0).cast("bigint").alias("doc_no"),
        F.lit("synthèse médicale").alias("filename"), F.col("synthesis").alias("markdown"))


# --- prompts --------------------------------------------------------------------------------


def build_prompts(fields: DataFrame, contexts: DataFrame) -> DataFrame:
    """One prompt per batch.

    ``fields(job_id, batch_no, field_ord, field_id, question, type, options)`` and
    ``contexts(job_id, batch_no, synthesis, context)``; a missing part is left out.
    """
    has_options = (F.col("type") == "choice") & (F.size("options") > 0)
    line = F.concat(F.lit("• ["), F.col("field_id"), F.lit("] "), F.col("question"),
                    F.when(has_options, F.concat(F.lit(CHOICE_HINT), F.array_join("options", " | "),
                                                 F.lit(")"))).otherwise(""))
    slot = F.concat(F.lit('  "'), F.col("field_id"),
                    F.lit('": {\n    "value": "...",\n    "source_quote": "..."\n  }'))
    rows = F.array_sort(F.collect_list(F.struct("field_ord", line.alias("line"), slot.alias("slot"))))
    asked = (fields.groupBy("job_id", "batch_no").agg(rows.alias("r"))
             .select("job_id", "batch_no",
                     F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("lines"),
                     F.array_join(F.transform("r", lambda x: x["slot"]), ",\n").alias("slots")))

    def part(head: str, col: str) -> Column:
        return F.when(F.length(col) > 0, F.concat(F.lit(head), F.col(col)))
    prompt = F.concat_ws(
        "\n\n", part(SYNTHESIS_HEAD, "synthesis"), part(EXCERPTS_HEAD, "context"),
        part(FIELDS_HEAD, "lines"),
        F.concat(F.lit(ANSWER_HEAD + "{\n"), F.col("slots"), F.lit("\n}")))
    return (asked.join(contexts, ["job_id", "batch_no"], "left")
            .select("job_id", "batch_no", prompt.alias("prompt"),
                    estimate_tokens(prompt).cast("bigint").alias("tokens")))


def field_lines(results: DataFrame) -> DataFrame:
    """``[id] label : value`` lines of the filled fields of each job, in form order."""
    line = F.concat(F.lit("["), F.col("field_id"), F.lit("] "),
                    F.coalesce("label", "field_id"), F.lit(" : "), F.col("value"))
    return (results.where(F.length("value") > 0).groupBy("job_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("fields_context")))


def chat_messages(requests: DataFrame, history: DataFrame, system: str = CHAT_SYSTEM) -> DataFrame:
    """``(conv_id, seq, role, content)``: system, context pair if any, history, question.

    ``requests(conv_id, question, synthesis, fields_context, context)``, ``history(conv_id, turn,
    role, text)`` already filtered.
    """
    given = F.concat_ws("\n\n---\n\n", *[F.when(F.length(c) > 0, F.concat(F.lit(h), F.col(c)))
                                         for c, h in CHAT_HEADS])
    turns = history.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    total = history.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_turns"))
    lead = F.when(F.length("_g") > 0, 3).otherwise(1)
    r = requests.withColumn("_g", given).withColumn("_lead", lead)

    def row(seq: Column, role: str, content: Column) -> Column:
        return F.struct(seq.cast("bigint").alias("seq"), F.lit(role).alias("role"),
                        content.alias("content"))
    some = F.length("_g") > 0
    # what is given is long and stays where it was made: only the question meets the history
    around = r.select("conv_id", F.inline(F.array(
        row(F.lit(0), "system", F.lit(system)),
        row(F.lit(1), "user", F.when(some, F.concat(F.lit(CHAT_OPEN), F.col("_g")))),
        row(F.lit(2), "assistant", F.when(some, F.lit(CHAT_READY)))))).where("content IS NOT NULL")
    last = (r.select("conv_id", "question", "_lead").join(total, "conv_id", "left")
            .select("conv_id", (F.col("_lead") + F.coalesce("_turns", F.lit(0))).cast("bigint").alias("seq"),
                    F.lit("user").alias("role"), F.col("question").alias("content")).where("content IS NOT NULL"))
    said = (history.join(running_offsets(turns, "conv_id", "turn", "n"), ["conv_id", "turn"])
            .join(r.select("conv_id", "_lead"), "conv_id")
            .select("conv_id", (F.col("_lead") + F.col("offset")).cast("bigint").alias("seq"),
                    "role", F.col("text").alias("content")))
    return around.unionByName(last).unionByName(said)
