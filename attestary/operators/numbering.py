"""Dense numbers inside groups of any size.

A window over a group is one sorted task, and one group may hold a third of all rows. Here rows
are counted per block of their order number first; only block counts meet in a group-wide
window, a thousand times fewer, and rows are numbered inside their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 1024


def number_rows(df: DataFrame, group: list[str], order: str, name: str, ties: str | None = None,
                block: int = BLOCK) -> DataFrame:
    """Adds ``name``: 0, 1, 2 … per group, by the integer column ``order``, then by ``ties``."""
    # a struct of nulls is no null: groups that are null meet by plain equality, and the join stays where the window has put the rows
    rows = df.withColumn("_g", F.struct(*group, F.floor(F.col(order) / block).alias("_b")))
    before = W.partitionBy(*[F.col(f"_of.{g}") for g in group]).orderBy("_of._b").rowsBetween(W.unboundedPreceding, -1)
    bases = (rows.groupBy(F.col("_g").alias("_of")).agg(F.count(F.lit(1)).alias("_c"))
             .select("_of", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base")))
    by = [order] if ties is None else [order, ties]
    inside = F.row_number().over(W.partitionBy("_g").orderBy(*by)) - 1
    return (rows.withColumn("_in", inside).join(bases, F.col("_g") == F.col("_of"))
            .withColumn(name, (F.col("_base") + F.col("_in")).cast("bigint"))
            .drop("_g", "_in", "_of", "_base"))


def running_offsets(counts: DataFrame, group: str, unit: str, n: str,
                    block: int = BLOCK) -> DataFrame:
    """Rows of the same group that come before each unit: ``counts`` has one row per unit."""
    blocked = counts.withColumn("_b", F.floor(F.col(unit) / block))

    def earlier(by: list[str], order: str, value: Column) -> Column:
        w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0))
    bases = (blocked.groupBy(group, "_b").agg(F.sum(n).alias("_s"))
             .withColumn("_base", earlier([group], "_b", F.col("_s"))).drop("_s"))
    return (blocked.withColumn("_in", earlier([group, "_b"], unit, F.col(n)))
            .join(bases, [group, "_b"])
            .select(group, unit, (F.col("_base") + F.col("_in")).alias("offset")))


def running_sums(df: DataFrame, group: list[str], order: str, ties: list[str], value: str, name: str,
                 block: int = BLOCK) -> DataFrame:
    """Adds ``name``: what ``value`` sums up to over the rows of the group ahead of a row, by the integer column
    ``order``, then by ``ties``. ``group`` and ``order`` hold no nulls. ``df`` is read twice."""
    rows = df.withColumn("_b", F.floor(F.col(order) / block))

    def earlier(by: list[str], orders: list[str], what: str) -> Column:
        w = W.partitionBy(*by).orderBy(*orders).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(w), F.lit(0))
    bases = (rows.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
             .withColumn("_base", earlier(group, ["_b"], "_s")).drop("_s"))
    return (rows.withColumn("_in", earlier([*group, "_b"], [order, *ties], value)).join(bases, [*group, "_b"])
            .withColumn(name, (F.col("_base") + F.col("_in")).cast("bigint")).drop("_b", "_in", "_base"))
