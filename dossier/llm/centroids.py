"""Exact centroid clustering that compares blocks of near vectors with few centroids.

Vectors are laid along a Hilbert curve through their leading directions and cut into
blocks of ``BLOCK_ROWS``; each block keeps the least and greatest value per component, a
zone map. For a block's box, every centroid has a least and a greatest distance; only a
centroid whose least distance is at most the smallest greatest one can be the nearest of
any vector in it. The vectors are compared with these centroids alone, exactly: the
components are integers, and sums of squares are formed in doubles only while they stay
below 2^53, in longs otherwise.

Blocks are written once (one shuffle, in ranges of the curve; equal vectors are told
apart by a hash of their id, so a vector that a third of all rows have is cut too) and read
by every round. A round sends back one row per cluster and component at most from each
task, summed by Spark; the driver holds the centroids alone, ``k`` rows.

Defined results: vectors with another number of components, or null or non-finite ones,
are left out, and so are those with a scaled component beyond 2^27, whose squared
distances a long could not hold; equal vectors start as separate centroids if their ids
do; rows that repeat an id are clustered one by one, and those without an id start no
centroid; with fewer than ``k`` vectors there are as many centroids; an empty table
gives an empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import table
from dossier.session import materialise

SIZE = 64
K = 40
ROUNDS = 5
SCALE = 256
SEED = 2
BLOCK_ROWS = 512
#: Directions the curve runs through, and bits of each.
AXES, BITS = 8, 7
#: Largest scaled component: 64 squares of twice that are below 2^63.
LIMIT = 1 << 27
#: Below this, products and their sums are exact in doubles.
DOUBLE_LIMIT = 1 << 22


def scaled(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and vector (array<int>, floor(scale * x)) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.lit(float(scale)) * v).alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= -LIMIT) & (v < LIMIT))
    return rows.filter((F.size("x") == size) & fine).select(
        "vec_id", F.transform("x", lambda v: F.floor(v).cast("int")).alias("vector")
    )


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose seeded id has the smallest digest."""
    named = vectors.filter("vec_id IS NOT NULL")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = named.withColumn("digest", digest).orderBy("digest", "vec_id", "vector").limit(k).select("vector").collect()
    return np.array([row.vector for row in rows], np.int64).reshape(len(rows), SIZE)


class Curve:
    """Places of vectors along a Hilbert curve through the centroids' leading directions.

    The starting centroids are a sample of the vectors. It decides only the order in
    which vectors are stored, so it has no influence on results.
    """

    def __init__(self, sample: np.ndarray, axes: int = AXES, bits: int = BITS):
        self.bits, self.center = bits, sample.mean(axis=0)
        centered = sample - self.center
        self.lines = np.linalg.svd(centered, full_matrices=False)[2][:axes].T
        spread = np.abs(centered @ self.lines).max(axis=0)
        self.reach = np.where(spread > 0, spread, 1.0)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """One long per vector; near places are near in space."""
        at = (vectors - self.center) @ self.lines / self.reach
        cells = np.clip((at + 1) / 2 * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
        return hilbert(cells, self.bits)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells with one small integer per axis.

    From the highest bit down, each level's bits are turned back into the orientation
    of the cell above (exchanges and reversals of the lower bits); what remains is the
    Gray code of the place, read across the axes.
    """
    x = cells.copy()
    axes = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for axis in range(axes):
            reverse = (x[:, axis] & bit) > 0
            swap = np.where(reverse, 0, (x[:, 0] ^ x[:, axis]) & lower)
            x[:, 0] ^= np.where(reverse, lower, swap)
            x[:, axis] ^= swap
    # The bits of all axes, highest level first, as one number in Gray code.
    gray = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            gray = gray << 1 | (x[:, axis] >> level & 1)
    place, shift = gray, 1
    while shift < axes * bits:
        place = place ^ place >> shift
        shift *= 2
    return place


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def with_places(vectors: DataFrame, curve: Curve) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = curve.places(matrix(batch.column("vector"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=[*batch.schema.names, "place"])

    return vectors.mapInArrow(place, "vec_id long, vector array<int>, place long")


BLOCKS = "ids array<long>, vectors binary, low array<int>, high array<int>"


def blocks(vectors: DataFrame, curve: Curve, rows: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive vectors along the curve with their box; written once.

    A block's vectors are little-endian 32-bit integers, row by row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block(ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            columns = [[ids], [data.astype("<i4").tobytes()], [data.min(axis=0)], [data.max(axis=0)]]
            kinds = (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["ids", "vectors", "low", "high"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                # Object arrays, as an id may be null.
                held.append((np.array(batch.column("vec_id").to_pylist(), object), matrix(batch.column("vector"))))
                size += batch.num_rows
            if size >= rows:
                ids, data = map(np.concatenate, zip(*held))
                whole = size - size % rows
                for start in range(0, whole, rows):
                    yield block(ids[start : start + rows], data[start : start + rows])
                held, size = [(ids[whole:], data[whole:])], size - whole
        if size:
            yield block(*map(np.concatenate, zip(*held)))

    placed = with_places(vectors, curve).withColumn("tie", F.xxhash64("vec_id"))
    ordered = placed.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie").select("vec_id", "vector")
    return materialise(ordered.mapInArrow(cut, BLOCKS), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that may be the nearest of some vector in the box."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    greatest = (np.maximum(high - centroids, centroids - low) ** 2).sum(axis=1)
    return np.flatnonzero(least <= greatest.min())


def nearest(data: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; ties to the smaller."""
    if max(np.abs(data).max(), np.abs(centroids).max()) <= DOUBLE_LIMIT:
        v, c = data.astype(np.float64), centroids.astype(np.float64)
        distances = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    else:
        distances = np.stack([((data - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    found = distances.argmin(axis=1)
    return found, distances[np.arange(len(data)), found].astype(np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    """ids, vectors, cluster and distance of every block."""
    for batch in batches:
        for ids, raw, low, high in zip(*(batch.column(name) for name in ("ids", "vectors", "low", "high"))):
            data = np.frombuffer(raw.as_py(), "<i4").reshape(len(ids), -1).astype(np.int64)
            box = [np.array(edge.as_py(), np.int64) for edge in (low, high)]
            chosen = candidates(*box, centroids)
            found, distance = nearest(data, centroids[chosen])
            yield ids.values, data, chosen[found], distance


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; without any it stays."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, data, cluster, _ in _assigned(batches, centroids):
            order = np.argsort(cluster, kind="stable")
            numbers, starts = np.unique(cluster[order], return_index=True)
            totals[numbers] += np.add.reduceat(data[order], starts, axis=0)
            counts += np.bincount(cluster, minlength=k)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(seen, size)),
                pa.array(np.tile(np.arange(size), len(seen))),
                pa.array(totals[seen].ravel()),
                pa.array(np.repeat(counts[seen], size)),
            ],
            names=["cluster", "component", "total", "n"],
        )

    def whole(name: str) -> Column:
        return F.sum(F.col(name).cast("decimal(38,0)")).cast("string").alias(name)

    rows = (
        stored.mapInArrow(sums, "cluster long, component long, total long, n long")
        .groupBy("cluster", "component")
        .agg(whole("total"), whole("n"))
        .collect()
    )
    after = centroids.copy()
    for row in rows:
        after[row.cluster, row.component] = int(row.total) // int(row.n)
    return after


def assign(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector of the blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assigned(batches, centroids):
            columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(rows, "vec_id long, cluster int, distance long")


def fit(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(blocks of the vectors that count, final centroids)."""
    vectors = scaled(embeddings)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return materialise(embeddings.sparkSession.createDataFrame([], BLOCKS), "blocks"), centroids
    stored = blocks(vectors, Curve(centroids))
    for _ in range(rounds):
        centroids = moved(stored, centroids)
    return stored, centroids


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, cluster, distance, the inertias and its centroid's digest."""
    stored, centroids = fit(embeddings, k, rounds)
    assigned = materialise(assign(stored, centroids), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("string").alias("total"))
    # At most k rows, being grouped by cluster.
    inertias = {row.cluster: int(row.total) for row in sums.collect()}
    facts = [
        (n, inertia, sum(inertias.values()), sha256(",".join(map(str, centroids[n].tolist())).encode()).hexdigest())
        for n, inertia in inertias.items()
    ]
    named = embeddings.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_centroid_clusters(spark, sf_dir) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
