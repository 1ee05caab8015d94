"""Centroid clustering of integer vectors with a LAESA pivot table.

Some vectors are pivots.  The distances of every vector to them are computed
once and stored beside it, which is the pivot table.  In a round the distances
of the centroids to the pivots are computed as well; by the triangle inequality
no centroid is nearer to a vector than the largest difference between their
distances to a pivot.  The centroid with the least such bound gets its exact
distance first; of the others only those whose bound does not exceed it survive
and get an exact integer distance, so the result is that of comparing with all.

Scale: the table is one narrow pass over the vectors, written once; a round is
a pass over it that sends a row per task and centroid, sums and count, to a
partial aggregation.  Broadcast and collected are centroids and pivots only:
``n_clusters`` and ``N_PIVOTS`` rows of ``dims`` whole numbers.  No vector is
shuffled, so hot or repeated vectors cost nothing further.

Defined results: null vectors, those of another length and those with null or
non-finite components are left out, and so are those with a component of
2^27 or more after scaling, since squared distances of such would not fit a
long; a null id is assigned like others but never a start; rows that repeat an
id tie as starts and are taken in the order of their components; with fewer
rows than centroids there are as many centroids as starts; a table without a
start gives an empty result; an inertia that does not fit a long is null; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import parts, pick
from ledgerlens.session import materialize

#: Pivots, as many numbers of 4 bytes a vector in the table.
N_PIVOTS = 12
#: Components from here on would make squared distances overflow.
TOO_LARGE = 1 << 27
#: Vectors compared at once, which bounds the surviving differences in memory.
COMPARED = 1024

_ASSIGNED = "vec_id long, cluster int, distance long"
_SUMS = "cluster int, place int, amount long, n long"


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and ``components``: floor(scale * x) of the vectors that are kept, as array<int>."""
    x = F.col("embedding").cast("array<double>")
    large = float(TOO_LARGE) / scale
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (c < large) & (c > -large))
    kept = pick(vectors, "vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & sound)
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("components"),
    )


def starting_vectors(whole: DataFrame, n_clusters: int, seed: int) -> np.ndarray:
    """The first vectors by the hash of seed and id: at most ``n_clusters`` rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = whole.where("vec_id is not null").select(key.alias("key"), "components").orderBy("key", "components")
    return np.array([r["components"] for r in first.limit(n_clusters).collect()], np.int64)


def choose_pivots(candidates: np.ndarray, n: int = N_PIVOTS) -> np.ndarray:
    """Up to ``n`` of the candidates, each the one whose distances to those before add up to most."""
    chosen = [0]
    total = np.zeros(len(candidates))
    while len(chosen) < min(n, len(candidates)):
        total += np.sqrt(((candidates - candidates[chosen[-1]]) ** 2).sum(axis=1))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return candidates[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (float64) of whole vectors to the pivots, a column each."""
    return np.sqrt(np.stack([((vectors - p) ** 2).sum(axis=1) for p in pivots], axis=1).astype(np.float64))


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of each vector's nearest centroid; the smaller number wins ties.

    ``table`` has the vectors' distances to the pivots as float32; the bounds
    are lowered by what its rounding may add.
    """
    to_pivots = pivot_distances(centroids, pivots)
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(table[:, p, None] - to_pivots[None, :, p]), out=bound)
    slack = (table.max(axis=1, initial=0) + to_pivots.max(initial=0)) * 1e-6 + 1e-6
    bound -= slack[:, None]
    row = np.arange(len(vectors))
    first = bound.argmin(axis=1)
    best = ((vectors - centroids[first]) ** 2).sum(axis=1)
    survives = bound <= np.sqrt(best.astype(np.float64))[:, None] * (1 + 1e-9)
    survives[row, first] = False
    vector, centroid = np.nonzero(survives)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[row, first] = best
    exact[vector, centroid] = ((vectors[vector] - centroids[centroid]) ** 2).sum(axis=1)
    cluster = exact.argmin(axis=1)  # the first of equal ones
    return cluster, exact[row, cluster]


def _rows(batch: pa.RecordBatch, dims: int, n_pivots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of a batch of the table: first row, components and pivot distances."""
    held = b"".join(batch.column(1).to_pylist())
    vectors = np.frombuffer(held, "<i4").reshape(-1, dims)
    table = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4").reshape(-1, n_pivots)
    for k in range(0, len(vectors), COMPARED):
        yield k, vectors[k : k + COMPARED].astype(np.int64), table[k : k + COMPARED].astype(np.float64)


def pivot_table(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, the components and the distances to the pivots (both as bytes), written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = pivots.shape[1]
        for batch in parts(batches, 10_000):
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            vectors = flat.reshape(-1, dims).astype(np.int64)
            held = [v.tobytes() for v in vectors.astype("<i4")]
            table = [t.tobytes() for t in pivot_distances(vectors, pivots).astype("<f4")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.binary()), pa.array(table, pa.binary())], names=["vec_id", "held", "pivots"]
            )

    return materialize(whole.mapInArrow(work, "vec_id long, held binary, pivots binary"), "pivot-table")


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """For a task: sums and count of the vectors of each centroid, a row for each component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in parts(batches, 10_000):
            for _, vectors, table in _rows(batch, dims, len(pivots)):
                cluster, _ = nearest(vectors, table, centroids, pivots)
                np.add.at(sums, cluster, vectors)
                counts += np.bincount(cluster, minlength=k)
        of, place = np.divmod(np.arange(k * dims, dtype=np.int32), np.int32(dims))
        some = np.repeat(counts > 0, dims)
        columns = [of[some], place[some], sums.ravel()[some], np.repeat(counts, dims)[some]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "place", "amount", "n"])

    return work


def next_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The floored means of the centroids' vectors; centroids without any stay."""
    sums = table.mapInArrow(_sums(centroids, pivots), _SUMS).groupBy("cluster", "place").agg(
        F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"), F.sum("n").alias("n")
    )
    out = centroids.copy()
    for r in sums.collect():  # clusters x components
        out[r["cluster"], r["place"]] = int(r["amount"]) // r["n"]
    return out


def assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector of the pivot table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 10_000):
            for k, vectors, distances in _rows(batch, centroids.shape[1], len(pivots)):
                cluster, distance = nearest(vectors, distances, centroids, pivots)
                columns = [batch.column(0).slice(k, len(vectors)), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(work, _ASSIGNED)


def cluster_vectors(vectors: DataFrame, n_clusters: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, seed: int = 2) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    ``distance`` is the squared distance to the final centroid, whose
    components are ``centroid`` (array<long>); inertias are sums of distances.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dims, scale)
    centroids = starting_vectors(whole, n_clusters, seed)
    if not len(centroids):
        return spark.createDataFrame(
            [], _ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
        )
    pivots = choose_pivots(centroids)
    table = pivot_table(whole, pivots)
    for _ in range(rounds):
        centroids = next_centroids(table, centroids, pivots)
    assigned = materialize(assign(table, centroids, pivots), "assigned-vectors")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = sum(sums.values())
    fits = lambda x: x if x < 1 << 63 else None
    rows = [
        (i, fits(s), fits(inertia), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest(), centroids[i].tolist())
        for i, s in sums.items()
    ]
    named = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    )
    return assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
