"""Approximate nearest neighbours by counting collisions of query-centred windows.

Every vector is projected on ``PROJECTIONS`` random lines, and a block of vectors
keeps its projections as sorted arrays. A query opens a window around itself in each
array; virtual rehashing widens all windows by the factor ``GROWTH`` until the search
is over. A vector that lies in enough windows is verified by its exact distance. The
search of a block ends when its k-th best distance is at most the radius for which
the windows catch a vector with the chosen probability, or when all are verified.

Vectors and queries are cut into blocks of bounded size, and each pair of blocks is
a group of its own; the best k per query of the data blocks are merged. Nothing is
collected or broadcast.

Defined results: vectors that are null, zero or hold null or non-finite components,
and rows without an id, take no part; vectors of different lengths are never
compared; equal vectors are all found, ties go to the smaller id; an empty table
gives an empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from math import ceil, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import table

PROJECTIONS = 64
#: Ratio of far to near, which sets the width of the windows.
RATIO = 2.0
#: Standard deviations that the threshold lies below a near vector's mean collisions.
SLACK = 2.5
GROWTH = 1.3
SEED = 42
DATA_BLOCK = 20_000
QUERY_BLOCK = 2_000

_WIDTH = sqrt(8 * RATIO**2 * log(RATIO) / (RATIO**2 - 1))
#: Chance that a vector at the radius lies in one window.
_NEAR = erf(_WIDTH / 2 / sqrt(2))
THRESHOLD = ceil(PROJECTIONS * _NEAR - SLACK * sqrt(PROJECTIONS * _NEAR * (1 - _NEAR)))


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        self.lines = lines
        places = (self.vectors @ lines).T
        self.order = np.argsort(places, axis=1)
        self.places = np.take_along_axis(places, self.order, axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        n = len(self.ids)
        center = query @ self.lines
        at = np.array([np.searchsorted(p, c) for p, c in zip(self.places, center)])
        low, high = at.copy(), at.copy()
        counts = np.zeros(n, np.int32)
        verified = np.zeros(n, bool)
        found: list[np.ndarray] = []
        distances: list[np.ndarray] = []
        # The first radius: windows that hold about 2 k vectors in the middle array.
        left = np.maximum(at - k, 0)
        right = np.minimum(at + k, n - 1)
        rows = np.arange(PROJECTIONS)
        reach = np.maximum(center - self.places[rows, left], self.places[rows, right] - center)
        radius = max(float(np.median(reach)) * 2 / _WIDTH, 1e-12)
        while True:
            half = radius * _WIDTH / 2
            parts = []
            for j in range(PROJECTIONS):
                lo = np.searchsorted(self.places[j], center[j] - half, side="left")
                hi = np.searchsorted(self.places[j], center[j] + half, side="right")
                parts += [self.order[j, lo : low[j]], self.order[j, high[j] : hi]]
                low[j], high[j] = min(lo, low[j]), max(hi, high[j])
            counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            everything = not low.any() and (high == n).all()
            new = np.flatnonzero((counts >= THRESHOLD) & ~verified)
            if everything:
                new = np.flatnonzero(~verified)
            verified[new] = True
            new = new[self.ids[new] != query_id]
            if len(new):
                found.append(new)
                # Components are added in order, as a loop over them would.
                distances.append(np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1)))
            if found:
                all_found, all_distances = np.concatenate(found), np.concatenate(distances)
                if everything or len(all_found) >= k and np.partition(all_distances, k - 1)[k - 1] <= radius:
                    best = np.lexsort((self.ids[all_found], all_distances))[:k]
                    return list(zip(self.ids[all_found[best]].tolist(), all_distances[best].tolist()))
            elif everything:
                return []
            radius *= GROWTH


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(rows.num_rows, -1)


RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest vectors found for each query row."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), vector.alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(_usable(F.col("vector")), F.lit(False)))
    rows = rows.withColumn("size", F.size("vector"))
    queries = rows.filter(is_query)
    data_blocks = max(1, ceil(rows.count() / DATA_BLOCK))
    query_blocks = max(1, ceil(queries.count() / QUERY_BLOCK))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    data = rows.select("*", block(data_blocks).alias("d"), every(query_blocks).alias("q"))
    asked = queries.select("*", every(data_blocks).alias("d"), block(query_blocks).alias("q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            index = Index(left["vec_id"].to_numpy(), _matrix(left))
            for query_id, query in zip(right["vec_id"].to_pylist(), _matrix(right)):
                out += [(query_id, *hit) for hit in index.search(query_id, query, k)]
        columns = zip(*out) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)

    keys = ["size", "d", "q"]
    hits = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        search, "query_id long, vec_id long, score double"
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_vectors(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
