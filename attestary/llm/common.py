"""Helpers the operators of this folder share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
# [0, 2^60) is cut twice, so a group is summed over at most 1 024 coarse and 2^20 fine blocks
ORDER_BITS, COARSE_BITS, FINE_BITS = 60, 10, 20


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value kept for the life of a Python worker process, across tasks.

    Functions of this package reach the workers by value, so their module variables start anew in
    every task; what is dear to make (a loaded tokenizer) lives in a module of its own.
    """
    home = sys.modules.setdefault("attestary_worker_state", types.ModuleType("attestary_worker_state"))
    if name not in home.__dict__:
        setattr(home, name, make())
    return home.__dict__[name]


def whole(docs: DataFrame) -> Column:
    """A row as one struct ``doc``, so that no column of it can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def unfolded(df: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again; with ``text``, that is their text and ``n_chars`` is its length."""
    out = []
    for c in docs.columns:
        value = F.col("doc")[c]
        if text is not None and c == "text":
            value = text
        elif text is not None and c == "n_chars":
            value = F.length(text).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    return df.select(*out)


def drawn(seed: int, *columns: str) -> Column:
    """A seeded uniform number in [0, 2^60), the same in any engine that has MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def running(df: DataFrame, group: str, order: str, ties: Sequence[str], value: Column) -> DataFrame:
    """``_before``: what the rows ahead of a row in its group sum up to; ``_total``: the group's sum.

    ``order`` is spread over [0, 2^60); a group is never gathered in one task: rows are ordered
    within a fine block, and only block sums meet, at most 1 024 in one window. ``group`` holds no
    nulls. Read ``df`` from a staged table: it is used twice.
    """
    coarse, fine = (F.shiftrightunsigned(order, ORDER_BITS - bits) for bits in (COARSE_BITS, FINE_BITS))
    rows = df.withColumns({"_value": value.cast("long"), "_coarse": coarse, "_fine": fine})
    ahead = (Window.unboundedPreceding, -1)
    fines = rows.groupBy(group, "_coarse", "_fine").agg(F.sum("_value").alias("_sum"))
    coarses = fines.groupBy(group, "_coarse").agg(F.sum("_sum").alias("_sum"))
    whole = Window.partitionBy(group)
    coarses = coarses.select(
        group, "_coarse", F.sum("_sum").over(whole).alias("_total"),
        F.coalesce(F.sum("_sum").over(whole.orderBy("_coarse").rowsBetween(*ahead)), F.lit(0)).alias("_a"))
    by_fine = Window.partitionBy(group, "_coarse").orderBy("_fine").rowsBetween(*ahead)
    starts = (fines.withColumn("_b", F.coalesce(F.sum("_sum").over(by_fine), F.lit(0)))
              .join(coarses, [group, "_coarse"])
              .select(group, "_fine", "_total", (F.col("_a") + F.col("_b")).alias("_start")))
    inside = Window.partitionBy(group, "_fine").orderBy(order, *ties).rowsBetween(*ahead)
    return (rows.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .join(starts, [group, "_fine"])
            .withColumn("_before", F.col("_start") + F.col("_in"))
            .drop("_value", "_coarse", "_fine", "_in", "_start"))
