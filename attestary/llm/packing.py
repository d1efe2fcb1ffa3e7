"""Packing documents into sequences: bounded-space online best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestary.llm.encoding import Encoder
from attestary.session import shared_dir

SEQUENCE = 2048
OPEN = 64        # windows a partition keeps open
TOGETHER = 64    # partitions whose leftover windows are merged in one task
PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, "
          "offset bigint, part int, left_over boolean")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()),
                    ("left_over", pa.bool_())])
FLUSH = 1 << 20  # ids gathered before a batch is handed on


class Windows:
    """At most ``OPEN`` windows with room left. A piece goes where it leaves the least room."""

    def __init__(self, size: int):
        self.size, self.rooms, self.pieces, self.next = size, [], {}, 0

    def place(self, piece: tuple, length: int) -> list[tuple[int, list]]:
        """Put a piece down; gives the windows that are emitted for it."""
        out = []
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, w = self.rooms.pop(at)
        else:
            if len(self.rooms) >= OPEN:
                _, fullest = self.rooms.pop(0)
                out.append((fullest, self.pieces.pop(fullest)))
            room, w, self.next = self.size, self.next, self.next + 1
            self.pieces[w] = []
        self.pieces[w].append((piece, self.size - room))
        if room > length:
            insort(self.rooms, (room - length, w))
        else:
            out.append((w, self.pieces.pop(w)))
        return out


def _pack_partition(encoder: Encoder, end_id: int, size: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, rows, held = Windows(size), [], 0

        def add(emitted: list, left_over: bool) -> None:
            nonlocal held
            for w, pieces in emitted:
                for (doc, start, total, ids), offset in pieces:
                    rows.append((doc, start, len(ids) // 4, total, ids, (part << 32) + w, offset, part, left_over))
                    held += len(ids) // 4

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part_ids = ids[4 * start:4 * (start + size)]
                    add(windows.place((doc, start, total, part_ids), len(part_ids) // 4), False)
                if held >= FLUSH:
                    yield batch_of()
                    rows, held = [], 0
        add(sorted(windows.pieces.items()), True)
        if rows:
            yield batch_of()
    return run


def _merge(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The pieces of the leftover windows in one run, cut where a sequence is full."""
        out, at, base = [], 0, (1 << 61) + (int(rows["part"].iloc[0]) // TOGETHER << 32)
        rows = rows.sort_values(["part", "sequence_id", "offset"], kind="stable")
        for r in rows.itertuples(index=False):
            doc = None if pd.isna(r.doc_id) else int(r.doc_id)
            done = 0
            while done < r.length:
                n = min(r.length - done, size - at % size)
                out.append((doc, r.start + done, n, r.doc_tokens, r.ids[4 * done:4 * (done + n)], base + at // size,
                            at % size, r.part, True))
                at, done = at + n, done + n
        frame = pd.DataFrame(out, columns=SCHEMA.names)
        return frame.astype({"doc_id": "Int64"})
    return run


def pack_documents(docs: DataFrame, encoder: Encoder, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents, each with its ``ids``, ``sequence_id`` and ``offset``.

    A document is its ids and ``end_id``; it is cut at every ``size`` ids. Each partition, in one
    pass and without a shuffle, keeps ``OPEN`` windows open: a piece goes where it fits best, and
    where it fits nowhere the fullest window is emitted and a new one opened. The windows left open
    at the end, at most ``OPEN`` per partition, are merged ``TOGETHER`` partitions at a time and cut
    where a sequence is full. The pieces are a table in the shared folder.

    Nulls: a null text is an empty one (the end id alone); a null id stays null. Repeated rows are
    packed each. Other columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "pieces")
    docs.select("doc_id", "text").mapInArrow(_pack_partition(encoder, end_id, size), PIECES).write.parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    merged = (pieces.where("left_over").groupBy(F.floor(F.col("part") / TOGETHER).alias("together"))
              .applyInPandas(lambda rows: _merge(size)(rows[SCHEMA.names]), PIECES))
    return pieces.where("not left_over").union(merged).drop("part", "left_over")
