"""Token ids in a binary table: Simple-8b words with per-block offsets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestary.llm.encoding import Encoder

# selector: ids per 64-bit word and bits per id (4 bits select, 60 hold ids); the last one says that
# the next word is one id as it is
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [60 // n for n in COUNTS]
ESCAPE = 15
RAW = 16  # stands for the word after an escape
SELECTOR_OF = np.zeros(61, dtype=np.int64)
SELECTOR_OF[COUNTS] = np.arange(len(COUNTS))
COUNT_OF = np.array([*COUNTS, 0, 0, 1], dtype=np.int64)
BLOCK = 1 << 14    # ids that are packed together and can be read without those before them
ROW = 1 << 18      # ids of a table row, or one document if it has more


def pack(ids: np.ndarray) -> np.ndarray:
    """Ids (unsigned) to Simple-8b words: each word takes as many of the next ids as fit."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    count = np.ones(n, dtype=np.uint8)
    for c, width in zip(COUNTS[-2::-1], WIDTHS[-2::-1]):
        if c > n:
            break
        narrow = ids < ids.dtype.type(1 << width) if width < 8 * ids.itemsize else np.ones(n, dtype=bool)
        fits = narrow[:n - c + 1].copy()
        for k in range(1, c):
            fits &= narrow[k:n - c + 1 + k]
        if not fits.any():
            break  # a longer run of narrower ids would also be a run of this width
        count[:n - c + 1][fits] = c
    steps, starts, i = count.tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = SELECTOR_OF[count[starts]]
    escaped = (ids[starts].astype(np.uint64) >> np.uint64(60)) > 0
    chosen[escaped] = ESCAPE
    at = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), dtype=np.uint64)
    for s in np.flatnonzero(np.bincount(chosen, minlength=16)).tolist():
        mine = chosen == s
        rows, word = starts[mine], np.uint64(s << 60)
        if s == ESCAPE:
            words[at[mine] + 1] = ids[rows]
        else:
            for k in range(COUNTS[s]):
                word = word | (ids[rows + k].astype(np.uint64) << np.uint64(k * WIDTHS[s]))
        words[at[mine]] = word
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    selector[raw] = RAW
    counts = COUNT_OF[selector]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.flatnonzero(np.bincount(selector, minlength=RAW + 1)).tolist():
        mine = selector == s
        first = ends[mine] - COUNT_OF[s]
        if s == RAW:
            out[first] = words[mine]
        elif s != ESCAPE:
            some, mask = words[mine], np.uint64((1 << WIDTHS[s]) - 1)
            for k in range(COUNTS[s]):
                out[first + k] = (some >> np.uint64(k * WIDTHS[s])) & mask
    return out


TABLE = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                   ("lengths", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("words", pa.binary())])
TABLE_SQL = ("part int, row int, first bigint, doc_ids array<bigint>, lengths array<bigint>, offsets array<bigint>, "
             "words binary")


def _rows(part: int, docs: Iterator[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    row, first, names, parts = 0, 0, [], []

    def table_row() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        blocks = [pack(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1].tolist()
        words = np.concatenate(blocks).astype("<u8").tobytes()
        values = [part, row, first, names, [len(p) // 4 for p in parts], offsets, words]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TABLE.types)], schema=TABLE)

    held = 0
    for name, ids in docs:
        names.append(name)
        parts.append(ids)
        held += len(ids) // 4
        if held >= ROW:
            yield table_row()
            row, first, names, parts, held = row + 1, first + held, [], [], 0
    if names:
        yield table_row()


def write_tokens(docs: DataFrame, path: str, encoder: Encoder, end_id: int = 1) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``doc_id``.

    Texts are range-partitioned by id, encoded in order and written by Spark's own writer, so a
    lost task is written again and the folder may be in any store Spark knows. A table row holds
    whole documents of about ``ROW`` ids: their ids and lengths, the packed words, and where each
    block of ``BLOCK`` ids begins among them. Null ids come first, ties in order of the text; a null
    text is an empty one, which has the end id alone. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        docs = ((name, encoder.ids(text or "") + end) for batch in batches
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield from _rows(TaskContext.get().partitionId(), docs)

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, TABLE_SQL).write.parquet(path)


def read_ids(words: bytes, offsets: list[int]) -> np.ndarray:
    """All ids of a table row, block by block."""
    packed = np.frombuffer(words, dtype="<u8")
    ends = [*offsets[1:], len(packed)]
    return np.concatenate([unpack(packed[a:b]) for a, b in zip(offsets, ends)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = read_ids(r["words"], r["offsets"]).astype("<u4")
            ends = np.cumsum(np.array(r["lengths"], dtype=np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + starts),
                 pa.array(ends - starts), pa.array(crcs, pa.int64())], ["part", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    table = spark.read.schema(TABLE_SQL).parquet(path)
    # one row per file part meets in this window
    sums = table.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("part", F.coalesce(before, F.lit(0)).alias("_start"))
    rows = table.select("part", "doc_ids", "lengths", "first", "offsets", "words").mapInArrow(
        _digests, "part int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
