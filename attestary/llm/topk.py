"""Exact top-k search by inner product with a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestary.session import stage

PIVOTS = 32
PIVOT_SAMPLE = 1024  # rows from which pivots are chosen and first thresholds are taken; results do not depend on it
QUERY_BLOCK, ROW_BLOCK = 1024, 4096
SCALE = 256
EXACT = 2.0 ** 52  # sums of products below this are exact in doubles


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, dim, vec``: floor(256 * x) of every component, x as double.

    Vectors that are null or hold a null or non-finite component are left out.
    """
    whole = F.col(vec_col).isNotNull() & F.forall(
        vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (vectors.where(whole & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"),
                    F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vec")))


def _far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each is the row farthest from those before it."""
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where they hold them, in 64-bit integers otherwise."""
    if len(a) and len(b) and a.shape[1] and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= EXACT:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(q_ids, q, q_table, floor, c_ids, c, c_table, k):
    """The best ``k`` of a block of rows for each query of a block: (query's place, id, score) arrays.

    d(q, x) is at least the largest difference of their distances to one pivot, so with
    2 q.x = |q|^2 + |x|^2 - d^2 each row has an upper bound on its score. Rows are evaluated from
    the highest bound down until the next bound is below the k-th best score so far.
    """
    found = [[], [], []]
    c_square, q_square = (c.astype(float) ** 2).sum(axis=1), (q.astype(float) ** 2).sum(axis=1)
    gap = np.zeros((len(q), len(c)), dtype=np.float32)
    for p in range(q_table.shape[1]):
        np.maximum(gap, np.abs(q_table[:, p, None] - c_table[None, :, p]), out=gap)
    # single precision and square roots err by far less than one part in 10^5 of the distances
    gap = np.maximum(gap - np.float32(1e-5) * (q_table.max(axis=1, initial=0)[:, None] + c_table.max(initial=0)) - 1e-3, 0)
    both = q_square[:, None] + c_square[None, :]
    upper = (both - gap.astype(float) ** 2) / 2 + 1e-9 * both + 1e-6
    for i in range(len(q)):
        order = np.flatnonzero((upper[i] >= floor[i]) & (c_ids != q_ids[i]))
        order = order[np.argsort(-upper[i][order], kind="stable")]
        ids, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 128
        while at < len(order):
            if len(scores) == k and upper[i][order[at]] < scores[-1]:
                break
            part = order[at:at + step]
            ids, scores = _best(np.concatenate([ids, c_ids[part]]),
                                np.concatenate([scores, _products(q[i:i + 1], c[part])[0]]), k)
            at, step = at + step, step * 2
        found[0].append(np.full(len(ids), i))
        found[1].append(ids)
        found[2].append(scores)
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` rows of highest inner product, exactly.

    Both tables as :func:`quantised` gives them. A row is no candidate for queries of its own id;
    equal scores go to the smaller id; a query with fewer candidates gets all. Vectors meet those of
    the same length only. Rows of a repeated id are candidates of their own; queries that share id
    and vector are one. Empty tables give no rows.

    Blocks of queries meet blocks of rows; a pair of blocks hands on ``k`` rows per query. The pivots
    and each query's first threshold come from a bounded sample of the rows (``PIVOT_SAMPLE``).
    """
    at = F.shiftrightunsigned(F.xxhash64("id"), 8)
    sample: dict[int, list] = {}
    for r in rows.select("id", "dim", "vec").orderBy(at, "id").limit(PIVOT_SAMPLE).collect():
        sample.setdefault(r.dim, []).append((r.id, r.vec))
    known = {dim: (np.array([i for i, _ in s], dtype=np.int64), np.array([v for _, v in s], dtype=np.int64).reshape(len(s), dim))
             for dim, s in sample.items()}
    pivots = {dim: _far_apart(vecs.astype(float), PIVOTS) for dim, (_, vecs) in known.items()}

    def blocks(df: DataFrame, size: int, prefix: str) -> DataFrame:
        sizes = df.groupBy("dim").agg(F.ceil(F.count("*") / size).alias("_blocks"))
        return (df.join(sizes, "dim").groupBy("dim", F.pmod(at, F.col("_blocks")).alias(f"{prefix}_block"))
                .agg(F.collect_list(F.struct("id", "vec")).alias(f"{prefix}_rows"), F.first("_blocks").alias(f"{prefix}_blocks")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(column: pa.Array, row: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
            members = column[row].values
            flat = members.field("vec").flatten().to_numpy(zero_copy_only=False)
            return members.field("id").to_numpy(), flat.reshape(len(members), dim)

        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("dim")[row].as_py()
                q_ids, q = table(batch.column("q_rows"), row, dim)
                c_ids, c = table(batch.column("c_rows"), row, dim)
                s_ids, s = known.get(dim, (np.empty(0, np.int64), np.empty((0, dim), np.int64)))
                far = pivots.get(dim, np.empty((0, dim)))
                scores = np.where(s_ids[None, :] == q_ids[:, None], np.iinfo(np.int64).min, _products(q, s))
                floor = np.full(len(q), -np.inf)
                if len(s) > k:
                    floor = np.sort(scores, axis=1)[:, -k].astype(float)
                tables = [_distances(m.astype(float), far).astype(np.float32) for m in (q, c)]
                place, ids, best = _search(q_ids, q, tables[0], floor, c_ids, c, tables[1], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[place.astype(np.int64)]), pa.array(place + batch.column("q_block")[row].as_py() * QUERY_BLOCK * 64),
                     pa.array(ids.astype(np.int64)), pa.array(best.astype(np.int64))], ["query_id", "place", "vec_id", "score"])

    c_blocks = blocks(rows, ROW_BLOCK, "c")
    q_blocks = stage(blocks(queries.dropDuplicates(["id", "vec"]), QUERY_BLOCK, "q"), "query-blocks")
    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / ROW_BLOCK).alias("_n"))
    asked = (q_blocks.join(counts, "dim")
             .withColumn("c_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))))
    pairs = asked.join(c_blocks, ["dim", "c_block"]).select("dim", "q_block", "q_rows", "c_rows")
    found = pairs.mapInArrow(search, "query_id long, place long, vec_id long, score long")
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
