"""Centroid clustering in exact integers with a LAESA pivot table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestary.session import stage

SCALE = 256
LARGEST = 1 << 26  # components beyond have squared distances that 64 bits may not hold
EXACT = 2.0 ** 52  # sums of products below this are exact in doubles
ROWS = 4096  # vectors whose bounds are held at once


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, vec, far``: vectors as integers with their distances to the pivots, in single precision; stored once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vec"), pivots.shape[1])
            _checked(rows)
            far = np.sqrt(_squares(rows, pivots).astype(float)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _lists(rows.astype(np.int32)), _lists(far)], ["id", "vec", "far"])
    return stage(vectors.select("id", "vec").mapInArrow(run, "id long, vec array<int>, far array<float>"), "pivot-table")


def _checked(rows: np.ndarray) -> np.ndarray:
    if rows.max(initial=0) > LARGEST or rows.min(initial=0) < -LARGEST:
        raise ValueError(f"components beyond {LARGEST} have squared distances beyond 64 bits")
    return rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def _squares(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: in doubles where they hold every sum, in 64-bit integers otherwise."""
    rows, others = rows.astype(np.int64), others.astype(np.int64)
    top = max(float(np.abs(rows).max(initial=0)), float(np.abs(others).max(initial=0)))
    if top * top * rows.shape[1] * 4 < EXACT:
        rows, others = rows.astype(float), others.astype(float)
    square = (rows ** 2).sum(axis=1)[:, None] + (others ** 2).sum(axis=1)[None, :] - 2 * (rows @ others.T)
    return square.astype(np.int64)


def nearest(rows: np.ndarray, far: np.ndarray, centroids: np.ndarray, centroid_far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each row (ties: smaller number), and how many
    exact distances that took.

    A row's distance to a centroid is at least the largest difference of their distances to one pivot.
    The centroid of the smallest bound gets an exact distance first; whatever is bounded below it
    survives and gets one as well.
    """
    n, k = len(rows), len(centroids)
    bound = np.zeros((n, k), dtype=np.float32)
    for p in range(far.shape[1]):
        np.maximum(bound, np.abs(far[:, p, None] - centroid_far[None, :, p]), out=bound)
    # single precision errs by far less than one part in 10^5 of the distances
    bound -= np.float32(1e-5) * (far.max(axis=1, initial=0)[:, None] + centroid_far.max(initial=0)) + np.float32(1e-3)
    exact = np.full((n, k), np.iinfo(np.int64).max)
    first = bound.argmin(axis=1)
    for c in range(k):
        mine = np.flatnonzero(first == c)
        if len(mine):
            exact[mine, c] = _squares(rows[mine], centroids[c:c + 1])[:, 0]
    reach = np.sqrt(exact[np.arange(n), first].astype(float))
    survives = bound <= reach[:, None]
    survives[np.arange(n), first] = False
    for c in range(k):
        mine = np.flatnonzero(survives[:, c])
        if len(mine):
            exact[mine, c] = _squares(rows[mine], centroids[c:c + 1])[:, 0]
    cluster = exact.argmin(axis=1)
    return cluster, exact[np.arange(n), cluster], n + int(survives.sum())


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
    centroid_far = np.sqrt(_squares(centroids, pivots).astype(float)).astype(np.float32)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            rows, far = _matrix(batch.column("vec"), centroids.shape[1]), _matrix(batch.column("far"), len(pivots))
            yield batch, rows, *nearest(rows, far, centroids, centroid_far)


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The componentwise floor of the mean of each centroid's vectors; a centroid without any stays.

    A task hands on one row of sums per centroid, so only centroids meet in the shuffle and reach the driver.
    """
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, rows, cluster, _, _ in _assigned(batches, centroids, pivots):
            order = np.argsort(cluster, kind="stable")
            held, starts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
            total[held] += np.add.reduceat(rows[order].astype(np.int64), starts)
            n[held] += counts
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), _lists(total[held])], ["cluster", "n", "total"])

    parts = table.mapInArrow(sums, "cluster long, n long, total array<long>")
    parts = parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    wide = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in wide.collect():  # one row per centroid and component
        out[r.cluster, r.place] = int(r.total) // r.n
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64,
             id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of ``dim`` whole components.

    Components are floor(256 x). The centroids begin as the ``k`` vectors of the smallest SHA-256 of
    ``seed:id``; each round assigns every vector to the nearest one and moves the centroids to the
    floor of the means; then vectors are assigned once more. The starting centroids are the pivots:
    the distances to them are computed once and stored with the vectors, and every round bounds all
    distances by them and computes the surviving ones in exact integers.

    Nulls: vectors that are null, of another length or hold null or non-finite components take no
    part; a null id is assigned but never a starting centroid. Repeated ids are vectors of their
    own, ties of the hash in order of the components. With fewer than ``k`` ids all are centroids;
    without any, as in an empty table, there are no rows. Components beyond 2^26 raise an error. Other columns are ignored.
    """
    parts = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & parts).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vec"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.where("id is not null").orderBy(digest, "vec").limit(k).select("vec").collect()
    spark = vectors.sparkSession
    result = ("id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not first:
        return spark.createDataFrame([], result)
    pivots = np.array([r.vec for r in first], dtype=np.int64)
    table, centroids = pivot_table(kept, _checked(pivots)), pivots
    for _ in range(rounds):
        centroids = _moved(table, centroids, pivots)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance, _ in _assigned(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             ["id", "cluster", "distance"])

    assigned = stage(table.mapInArrow(last, "id long, cluster int, distance long"), "assigned")
    digests = spark.createDataFrame(
        [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())],
        "cluster int, centroid_sha256 string")
    # one row per centroid
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.groupBy().agg(F.sum("cluster_inertia").alias("inertia")).first()[0]
    facts = inertia.join(digests, "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return assigned.join(F.broadcast(facts), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
