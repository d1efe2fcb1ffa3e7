"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestary.llm.common import SPACE, WORD, drawn, running, unfolded, whole
from attestary.session import stage


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int, share: float) -> DataFrame:
    """Target of each source: its weighted part of the budget, no more than ``cap`` times its size.

    ``sizes``: stratum, source_size. What a capped source leaves is shared by weight among the
    others until none is above: the level at which weight times level fills the budget, found over
    the sources in the order they reach their cap. One row per source meets in these windows.
    """
    cycle = F.array(*[F.lit(w).cast("double") for w in weights])
    by_name = Window.orderBy("stratum")
    top = F.col("source_size") * F.lit(float(cap))
    rows = (sizes.withColumn("_w", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
            .withColumn("_top", top).withColumn("_full", F.col("_top") / F.col("_w")))
    by_full = Window.orderBy("_full", "stratum")
    every = by_full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    ahead = F.coalesce(F.sum("_top").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(by_full.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (budget - ahead) / open_weight)
    level = F.first(F.when(F.col("_level") <= F.col("_full"), F.col("_level")), ignorenulls=True).over(every)
    return (rows.withColumn("_l", level)
            .select("stratum", "source_size", F.least(F.col("_l") * F.col("_w"), F.col("_top")).alias("target")))


def allotments(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1.0,
               seed: int = 7) -> DataFrame:
    """What the mix takes of every document: ``taken`` words in copies of at most ``size``.

    Each source's documents stand in a seeded order, pass after pass up to ``cap`` passes. A copy
    starts and finishes at the virtual times (words of its source before it, and with it) / target.
    All sources are served at once; at time 1 the budget is spent and the mix is truncated, which
    cuts the one document of each source that is then being served. ``finish`` is the virtual
    finish time of the first copy (null where the target is 0).

    Weights go to the sources by code point, a null source last, and repeat. Nulls: a null text has
    no words and is never taken; a null id is drawn by its size. Repeated rows are documents of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("stratum"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return _allot(stage(rows.withColumn("draw", drawn(seed, "doc_id", "size")), "mix-rows"), weights, cap, share)


def _allot(rows: DataFrame, weights: Sequence[int], cap: int, share: float, extra: Sequence[str] = ()) -> DataFrame:
    sizes = rows.groupBy("stratum").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap, share)
    queued = running(rows, "stratum", "draw", ["doc_id", "size", *extra], F.col("size")).join(targets, "stratum")
    words = F.floor("target")
    taken = [F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("source_size") * n - F.col("_before")))
             for n in range(cap)]
    total = taken[0]
    for t in taken[1:]:
        total = total + t
    finish = F.when(F.col("target") > 0, (F.col("_before") + F.col("size")).cast("double") / F.col("target"))
    return queued.select("doc_id", "stratum", "size", "source_size", "target", total.cast("long").alias("taken"),
                         finish.alias("finish"), "draw", "_before", *extra)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, share: float = 1.0,
        seed: int = 7) -> DataFrame:
    """The mixed documents with all their columns, a row per copy, in the order of virtual finish time.

    The copy that is being served when the budget is spent keeps its first words. ``text`` and,
    where there is one, ``n_chars`` are those of the copy. Cases as in :func:`allotments`; rows that share
    id, source and text get their allotments in the order of a hash of the whole row, so reruns agree.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("stratum"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("_text"))
    rows = stage(rows.withColumn("draw", drawn(seed, "doc_id", "size")), "mix-rows")
    served = _allot(rows, weights, cap, share, ["_text"]).where("taken > 0")
    # repeated rows were allotted one by one: the n-th row of an id, source and text has its n-th allotment
    nobody, key = F.lit(-(2 ** 63)), ["_doc", "stratum", "_text"]
    lots = (served.groupBy(F.coalesce("doc_id", nobody).alias("_doc"), "stratum", "_text")
            .agg(F.array_sort(F.collect_list(F.struct("_before", "size", "source_size", "target"))).alias("_lots")))
    row = whole(docs)
    base = docs.select(row, F.coalesce("doc_id", nobody).alias("_doc"), F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("stratum"),
                       F.xxhash64("text").alias("_text"), F.xxhash64(F.to_json(row)).alias("_row"))
    base = base.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_row")))
    lot = F.get("_lots", F.col("_n") - 1)
    copies = (base.join(lots, key).withColumn("_lot", lot).where("_lot is not null")
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))))
    start = F.col("_lot.source_size") * F.col("_copy") + F.col("_lot._before")
    copies = (copies.withColumn("_words", F.least(F.col("_lot.size"), F.floor("_lot.target") - start)).where("_words > 0")
              .withColumn("_finish", (start + F.col("_words")).cast("double") / F.col("_lot.target")))
    text = F.col("doc.text")
    parts = F.regexp_extract_all(text, F.lit(f"({WORD}[{SPACE}]*)"))
    head = F.array_join(F.slice(parts, F.lit(1), F.col("_words").cast("int")), "")
    cut = F.when(F.col("_words") == F.col("_lot.size"), text).otherwise(head)
    return unfolded(copies.orderBy("_finish", "_doc", "_copy"), docs, cut)
