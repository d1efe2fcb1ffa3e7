"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestary.llm.common import ORDER_BITS, drawn, running
from attestary.session import stage


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """Shard and slot of every document; shards differ by at most one row and all hold the mixture.

    Rows of a source are shuffled by a seeded draw and ranked; the rank as a share of the source,
    with an offset of the source's own, is their place in the interleaved order, which is cut into
    ``shards`` runs of equal length. No source is gathered in a task, and only DataFrame functions
    are used.

    Nulls: a null source is a source of its own; a null text has no bytes (``size`` is 1, the
    checksum that of the empty text); null ids are drawn by their text. Repeated rows each get a
    slot of their own. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("stratum"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = stage(rows.withColumn("draw", drawn(seed, "doc_id", "text_crc32")), "shard-rows")
    ranked = running(rows, "stratum", "draw", ["doc_id", "text_crc32", "size"], F.lit(1))
    span = float(2 ** ORDER_BITS)
    share = (F.col("_before") + drawn(seed, "stratum") / F.lit(span)) / F.col("_total")
    place = F.least((share * F.lit(span)).cast("long"), F.lit(2 ** ORDER_BITS - 1))
    mixed = stage(ranked.withColumn("place", place).withColumn("all", F.lit(0)).drop("_before", "_total"),
                  "shard-places")
    laid = running(mixed, "all", "place", ["stratum", "draw", "doc_id", "text_crc32", "size"], F.lit(1))
    shard = F.expr(f"(_before * {shards}L) div _total")
    first = F.expr(f"(shard * _total + {shards - 1}L) div {shards}L")
    return (laid.withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    (F.col("_before") - first).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 11) -> None:
    """The documents themselves, one folder per shard, in slot order. Ids are taken to be unique."""
    placed = assign_shards(docs, shards, seed).select("doc_id", "shard", "slot")
    (docs.drop("shard", "slot").join(placed, "doc_id")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
