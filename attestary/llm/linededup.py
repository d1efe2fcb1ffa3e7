"""Line dedup: which lines to keep, as a bitmap per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestary.llm.common import unfolded, whole
from attestary.session import stage

BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOBODY = 2 ** 63 - 1  # a null id stands behind all others


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _first_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (h1, h2, id): the first id of each row's hash, as far as this partition knows.

    ``open``: the hash is the first of the partition, so its run may have begun in another one.
    """
    last, opening = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids = (batch.column(c).to_numpy() for c in ("h1", "h2", "id"))
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last and (h1[0], h2[0]) == last[:2]:
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        holder = ids[np.maximum(start, 0)]
        if not new[0]:
            holder[start < 0] = last[2]
        opening = opening or (h1[0], h2[0])
        last = (h1[-1], h2[-1], holder[-1])
        is_open = (h1 == opening[0]) & (h2 == opening[1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(holder), pa.array(is_open)], [*batch.schema.names, "holder", "open"])


def _bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def read_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """One boolean per line: is it kept?"""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")
    return bits[:n_lines].astype(bool)


@F.pandas_udf(T.BinaryType())
def pack_bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([_bitmap(n, np.asarray(d)) for n, d in zip(n_lines, dropped)], dtype=object)


@F.pandas_udf(T.StringType())
def kept_lines(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The lines a bitmap keeps; null where there is no bitmap."""
    out = []
    for t, b in zip(text, bitmap):
        if b is None or t is None:
            out.append(None)
            continue
        lines = t.split("\n")
        out.append("\n".join(x for x, k in zip(lines, read_bitmap(b, len(lines)).tolist()) if k))
    return pd.Series(out, dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``id, row, n_lines, n_dropped, bitmap`` of every document that loses lines.

    A key of at least ``min_chars`` code points keeps its lines in the smallest id holding it and
    loses them elsewhere. Line hashes are range-partitioned together with id and position, so a
    line that many documents share spreads over as many partitions as it fills; each partition
    streams first holders, and only the hash it begins with is looked up among the others.

    ``id`` is ``doc_id`` (null ids together stand behind all others as one document), ``row`` the
    hash of the text, which tells rows of one id apart. Null and empty texts have one empty line.
    """
    lines = docs.select(
        F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), F.xxhash64("text").alias("row"),
        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = lines.select("id", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    order = ["h1", "h2", "id", "row", "pos"]
    hashed = (keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                           "id", "row", "pos", "n_lines")
              .repartitionByRange(*order).sortWithinPartitions(*order))
    schema = "h1 long, h2 long, id long, row long, pos int, n_lines int, holder long, open boolean"
    held = stage(hashed.mapInArrow(_first_holders, schema), "line-holders")
    # one hash per partition: bounded by the number of partitions, not by the data
    opened = held.where("open").select("h1", "h2").distinct()
    owners = (held.join(F.broadcast(opened), ["h1", "h2"], "left_semi")
              .groupBy("h1", "h2").agg(F.min("holder").alias("owner")))
    dropped = (held.join(F.broadcast(owners), ["h1", "h2"], "left")
               .where(F.col("id") > F.coalesce("owner", "holder")))
    return (dropped.groupBy("id", "row", "n_lines").agg(F.collect_set("pos").alias("_pos"))
            .select("id", "row", "n_lines", F.size("_pos").alias("n_dropped"),
                    pack_bitmap("n_lines", "_pos").alias("bitmap")))


def with_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``doc`` (all columns of a document), ``n_lines``, ``n_dropped``, ``bitmap`` (null: all lines stay) and
    ``kept``, the text that remains (null and empty texts are the empty text)."""
    maps = keep_bitmaps(docs, min_chars).select("id", "row", F.col("n_dropped").alias("gone"), "bitmap")
    rows = docs.select(whole(docs), F.coalesce("doc_id", F.lit(NOBODY)).alias("id"), F.xxhash64("text").alias("row"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    joined = rows.join(maps, ["id", "row"], "left")
    # only texts that lose lines travel to Python
    short = kept_lines(F.when(F.col("bitmap").isNotNull(), F.col("doc.text")), F.col("bitmap"))
    return joined.select(
        "doc", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_dropped"), "bitmap", F.coalesce(short, text).alias("kept"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The documents, all columns, with the remaining lines as ``text`` (and ``n_chars`` to match).

    Every document stays, also one that has lost all its lines.
    """
    return unfolded(with_bitmaps(docs, min_chars), docs, F.col("kept"))
