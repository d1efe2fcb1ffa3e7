"""Document fingerprints: a homomorphic multiset hash of a document's paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestary.llm.common import worker_state

LANES = 128   # lanes that add Cauchy numbers, mod 2^32: two fingerprints' distance is read from them
WIDE = 8      # lanes that add any 64-bit number, mod 2^64
PIECE = 8     # a longer paragraph is divided at content-chosen words, every PIECE words on average
BATCH = 4096  # pieces hashed into lanes at once
SCALE = 256   # a Cauchy number of 1
STEPS = np.arange(1, LANES // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
EMPTY = (0, 0, np.zeros(WIDE, dtype=np.uint64), np.zeros(LANES, dtype=np.uint32))


def cauchy_numbers() -> np.ndarray:
    """65 536 equally likely Cauchy numbers as integers."""
    return np.rint(np.tan(np.pi * ((np.arange(1 << 16) + 0.5) / (1 << 16) - 0.5)) * SCALE).astype(np.int64)


def paragraphs(text: str) -> list[bytes]:
    """The multiset a fingerprint is equal for: the lines of the text."""
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def pieces(line: bytes) -> list[bytes]:
    """A paragraph as what likeness is measured on: itself, or its pieces if it is long.

    It is cut after every word whose length and bytes choose it, which depends on the word alone: an edit
    changes the pieces it touches and no others.
    """
    words = line.split(b" ")
    if len(words) <= PIECE:
        return [line]
    out, start = [], 0
    for i, w in enumerate(words, 1):
        if w and (w[0] * 7 + w[-1] * 13 + len(w) * 5 + w[len(w) // 2]) % PIECE == 0 or i - start >= 4 * PIECE:
            out.append(b" ".join(words[start:i]))
            start = i
    if start < len(words):
        out.append(b" ".join(words[start:]))
    return out


def _seeds(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=32).digest() for p in parts]), dtype="<u8").reshape(-1, 4)


def of_paragraphs(lines: Iterable[bytes]) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Counts of paragraphs and pieces, and the lanes: wide ones add the vectors of whole paragraphs, so they are equal
    for equal multisets of these alone; the others add those of their pieces."""
    lines = list(lines)
    table = worker_state("cauchy", cauchy_numbers)
    wide, lanes = EMPTY[2].copy(), EMPTY[3].copy()
    for i in range(0, len(lines), BATCH):
        seeds = _seeds(lines[i:i + BATCH])
        wide += np.concatenate([seeds.sum(axis=0), (seeds * (seeds | np.uint64(1))).sum(axis=0)])
    parts = [p for line in lines for p in pieces(line)]
    for i in range(0, len(parts), BATCH):
        # the digest's first number is spread over all lanes, 16 bits for each
        x = _seeds(parts[i:i + BATCH])[:, :1] + STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        lanes += table[x.view(np.uint16)].sum(axis=0).astype(np.uint32)
    return len(lines), len(parts), wide, lanes


def fingerprint(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray]:
    return of_paragraphs(paragraphs(text or ""))


def combine(a, b, sign: int = 1):
    """Insertion (``sign`` 1) or deletion (-1) of the paragraphs of ``b``; order does not matter."""
    return tuple(x + y if sign > 0 else x - y for x, y in zip(a, b))


def same(a, b) -> bool:
    """Whether two multisets of paragraphs are equal."""
    return a[0] == b[0] and bool((a[2] == b[2]).all())


def likeness(a, b) -> float:
    """Estimated share of common pieces, |A and B| / |A or B| as multisets, in 0..1; 1 for equal prints and no others.

    A lane of the difference is a sum of Cauchy numbers, each times how often its member is in one
    multiset more than in the other; the median size of such sums is the sum of these counts.
    """
    if same(a, b):
        return 1.0
    apart = float(np.median(np.abs((a[3] - b[3]).view(np.int32).astype(np.int64)))) / SCALE
    total = a[1] + b[1]
    apart = min(max(apart, abs(a[1] - b[1]), 1.0), total)
    return (total - apart) / (total + apart)


def as_hex(print_) -> str:
    lines, parts, wide, lanes = print_
    return (np.array([lines, parts], dtype="<u8").tobytes() + wide.astype("<u8").tobytes() + lanes.astype("<u4").tobytes()).hex()


def from_hex(text: str):
    raw = bytes.fromhex(text)
    head = np.frombuffer(raw[:16 + 8 * WIDE], dtype="<u8")
    return int(head[0]), int(head[1]), head[2:].astype(np.uint64), np.frombuffer(raw[16 + 8 * WIDE:], dtype="<u4").astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns and ``fingerprint``: equal for equal texts, and where paragraphs stand in another order; texts whose
    paragraphs differ, if only in where lines end, have different ones.

    A null text counts as the empty text, which is one empty paragraph. A text is hashed in batches
    of ``BATCH`` pieces; repeated rows have equal fingerprints.
    """
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_hex(fingerprint(t)))
    return docs.drop("fingerprint").withColumn("fingerprint", run(F.coalesce("text", F.lit(""))))


def _edited(text: str, follower: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + follower[:cut]


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order block, extra, doc_id descending: each with its successor, which may be an extra row."""
    held = None  # block, id, text, print of the row that waits for its successor

    def row(block, doc_id, text, print_, follower, next_print):
        edit = _edited(text, follower)
        edit_print = print_ if edit == text else fingerprint(edit)
        return (doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), as_hex(print_), as_hex(edit_print),
                likeness(print_, edit_print), likeness(print_, next_print))

    names = [f.split()[0] for f in OUT.split(", ")]
    for batch in batches:
        out = []
        for block, extra, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            print_ = fingerprint(text)
            if held and held[0] == block:
                out.append(row(*held, text, print_))
            held = None if extra else (block, doc_id, text, print_)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=SCHEMA)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])
NULL_ID = -(2 ** 63)  # null ids stand last in descending order


def compare_with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they and the next document are.

    The edited text has its last third replaced by the beginning of the next document in descending
    order of ``doc_id`` (ties by text; null ids last); after the last comes the first. Nulls: a null
    text is the empty text. A single document is its own successor. Other columns are ignored.

    Texts are shuffled once, into blocks of neighbouring ids whose limits are ids of the table; the
    document at a limit also goes to the block before it, so every successor is at hand.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one number per block reaches the driver; an approximate quantile is a value of the column
    steps = [(i + 1) / blocks for i in range(blocks)]
    limits = sorted(set(rows.agg(F.percentile_approx("_id", steps, 10_000)).first()[0] or [])
                    | set(rows.agg(F.max("_id")).first()) - {None})
    edges, last = np.array(limits, dtype=np.int64), len(limits) - 1

    @F.pandas_udf("array<int>")
    def blocks_of(ids: pd.Series) -> pd.Series:
        # block n holds the ids up to limit n, above the limit before it
        own = np.searchsorted(edges, ids.to_numpy())
        at_limit = edges[own] == ids.to_numpy()
        return pd.Series([[b, b + 1 if b < last else 0] if e else [b] for b, e in zip(own.tolist(), at_limit.tolist())])

    placed = (rows.select("*", F.posexplode(blocks_of("_id")).alias("extra", "block"))
              .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
              .sortWithinPartitions("block", "extra", F.desc("_id"), "text"))
    return (placed.select("block", "extra", "_id", "text").mapInArrow(_compare, OUT)
            .withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))))
