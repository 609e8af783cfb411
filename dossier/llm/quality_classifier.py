"""Quality classifier: labels of the nearest labelled texts, weighted by similarity.

A text becomes a bag of terms. Words and pairs of neighbouring words, lower-cased and
hashed into ``WORD_TERMS`` slots, say what it is about; layout terms say how it is
written: n-grams over the classes of its characters (letter case, digits, white space,
each punctuation mark) with runs collapsed, how often it repeats words and how well it
compresses. Both parts have a length of their own, so neither drowns the other. A
truncated singular value decomposition of the labelled texts' weighted term counts,
found by random projection, gives the latent space; every document is compared with
every labelled vector by cosine, in blocks, and its nearest neighbours vote.

The labelled rows are a sample of at most ``SAMPLE_ROWS``, those with the smallest
hash of their id, so the broadcast model has at most ``(SAMPLE_ROWS + TERMS +
WORD_TERMS) * RANK`` numbers. Scoring is one pass over the documents without a shuffle.

Defined results: null and blank texts have no terms and get the share of good
labels as score; repeated rows are scored alike; an empty table gives an empty
result; without any label every score is 0.5; a label other than 0 and 1, or without
an id, is ignored; of several labels of one document the largest counts. Only
``doc_id`` and ``text`` are read, and only the text bears on a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import fresh, id_remainder, table
from dossier.session import materialise

SAMPLE_ROWS = 5_000
#: Layout terms, and word terms behind them.
TERMS = 1024
WORD_TERMS = 1 << 15
RANK = 64
#: Length of the word part beside that of the layout part.
WORD_WEIGHT = 1.0
SEED = 42
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Documents whose products with the labelled vectors are computed at once.
BLOCK = 256
#: Weight of the terms for repetition and compression beside the n-grams.
REPETITION_WEIGHT = 0.5
HELD_OUT = 4, 2

_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[ord("A") : ord("Z") + 1] = ord("X")
_CLASSES[ord("a") : ord("z") + 1] = ord("x")
_CLASSES[128:] = ord("x")
_CLASSES[ord("0") : ord("9") + 1] = ord("9")
_CLASSES[[9, 11, 12, 13]] = ord(" ")
_CLASSES = _CLASSES.tobytes()


def layout_terms(text: str | None) -> np.ndarray:
    """Counts of the text's layout terms; all zero for null and blank texts."""
    counts = np.zeros(TERMS, dtype=np.float32)
    data = (text or "").encode("utf-8", "replace")
    shape = np.frombuffer(data.translate(_CLASSES), dtype=np.uint8)
    if not len(shape) or not data.strip():
        return counts
    shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])].astype(np.uint32)
    grams = shape
    for n in (1, 2, 3):
        if n > 1:
            if len(shape) < n:
                break
            grams = grams[:-1] * np.uint32(257) + shape[n - 1 :]
        slots = ((grams * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(TERMS - 64)
        counts += np.bincount(slots, minlength=TERMS)
    np.sqrt(counts, out=counts)
    counts /= np.linalg.norm(counts)
    words = data.split()
    # Long texts repeat more of their words, hence the exponent.
    distinct = len(set(words)) / max(1.0, len(words) ** 0.9)
    packed = min(1.0, len(zlib.compress(data, 1)) / len(data))
    counts[TERMS - 64 + min(31, int(24 * distinct))] = REPETITION_WEIGHT
    counts[TERMS - 32 + min(31, int(31 * packed))] = REPETITION_WEIGHT
    return counts


def word_terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the text's words and word pairs, ascending, and their weights."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    single = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    pairs = (single[:-1] * np.uint32(2246822519)) ^ single[1:]
    slots = (np.concatenate([single, pairs]) * np.uint32(2654435761)) >> np.uint32(17)
    slots, counts = np.unique(slots, return_counts=True)
    values = np.sqrt(counts).astype(np.float32)
    norm = np.linalg.norm(values)
    return slots.astype(np.int32) + TERMS, values * (WORD_WEIGHT / norm if norm else 0.0)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all terms of a text and their weights; none for null and blank texts."""
    layout = layout_terms(text)
    (slots,) = layout.nonzero()
    words, values = word_terms(text)
    return np.concatenate([slots.astype(np.int32), words]), np.concatenate([layout[slots], values])


Terms = list[tuple[np.ndarray, np.ndarray]]


def _times(rows: Terms, matrix: np.ndarray) -> np.ndarray:
    """The product of a sparse matrix, given by its rows, and a matrix."""
    found = [values @ matrix[slots] for slots, values in rows]
    return np.stack(found) if found else np.zeros((0, matrix.shape[1]), matrix.dtype)


def _transposed_times(rows: Terms, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros((TERMS + WORD_TERMS, matrix.shape[1]), matrix.dtype)
    for (slots, values), row in zip(rows, matrix):
        out[slots] += values[:, None] * row
    return out


def latent_axes(rows: Terms, rank: int = RANK, rounds: int = 1) -> np.ndarray:
    """The leading right singular vectors of a sparse matrix, one per column."""
    start = np.random.default_rng(SEED).standard_normal((TERMS + WORD_TERMS, rank + 8), np.float32)
    found = np.linalg.qr(_times(rows, start))[0]
    for _ in range(rounds):
        found = np.linalg.qr(_times(rows, np.linalg.qr(_transposed_times(rows, found))[0]))[0]
    vectors = np.linalg.svd(_transposed_times(rows, found), full_matrices=False)[0]
    return np.ascontiguousarray(vectors[:, :rank])


class Neighbours:
    """Labelled vectors in the latent space, and the projection into it."""

    def __init__(self, rows: Terms, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = np.zeros(TERMS + WORD_TERMS, np.float32)
        for slots, _ in rows:
            seen[slots] += 1
        self.weights = np.log((1.0 + len(rows)) / (1.0 + seen)).astype(np.float32) + 1.0
        self.axes = latent_axes([(slots, values * self.weights[slots]) for slots, values in rows])
        self.vectors = self._latent(rows)

    def _latent(self, rows: Terms) -> np.ndarray:
        weighted = [(slots, values * self.weights[slots]) for slots, values in rows]
        latent = _times(weighted, self.axes)
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.where(norm > 0, norm, 1.0)

    def scores(self, rows: Terms) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        products = self._latent(rows) @ self.vectors.T
        k = min(NEIGHBOURS, products.shape[1])
        # Ties in similarity go to the earlier labelled row.
        nearest = np.argpartition(-products, k - 1, axis=1)[:, :k]
        similarity = np.clip(np.take_along_axis(products, nearest, axis=1), 0.0, 1.0).astype(np.float64)
        weight = similarity**8
        votes = (weight * self.labels[nearest]).sum(axis=1)
        # One weak vote for the prior keeps texts without terms defined.
        score = (votes + 0.01 * self.prior) / (weight.sum(axis=1) + 0.01)
        return np.where([len(slots) > 0 for slots, _ in rows], score, self.prior)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Neighbours:
    """Neighbours from at most ``sample_rows`` labelled rows that are not held out."""
    divisor, held_out = HELD_OUT
    sample = (
        labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL")
        .filter(id_remainder(F.col("doc_id"), divisor) != held_out)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("quality").cast("int").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    sample = materialise(sample, "labels")
    chosen = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    chosen = chosen.join(F.broadcast(sample), "_id").select("_id", "_quality", "_text")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [terms(text) for text in frame["_text"]]
            yield pd.DataFrame(
                {
                    "id": frame["_id"],
                    "quality": frame["_quality"],
                    "slots": [slots.astype("<u2").tobytes() for slots, _ in found],
                    "weights": [values.astype("<f2").tobytes() for _, values in found],
                }
            )

    rows = chosen.mapInPandas(counted, "id long, quality int, slots binary, weights binary")
    # Repeated rows of one document are one example.
    rows = rows.dropDuplicates(["id"]).orderBy("id").toPandas()
    found = [
        (np.frombuffer(slots, "<u2").astype(np.int32), np.frombuffer(values, "<f2").astype(np.float32))
        for slots, values in zip(rows["slots"], rows["weights"])
    ]
    return Neighbours(found, rows["quality"].to_numpy())


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """The rows of ``docs`` with ``quality_score`` instead of any column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        neighbours = shared.value
        for batch in texts:
            found = [
                neighbours.scores([terms(x) for x in batch.iloc[i : i + BLOCK]])
                for i in range(0, len(batch), BLOCK)
            ]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn("quality_score", scored(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, columns as they were."""
    (held,) = fresh(docs, "given_score")
    kept = docs.withColumnRenamed("quality_score", held)
    scored = score(kept, train(docs, labels)).filter(F.col("quality_score") >= threshold)
    given = [F.col(held if c == "quality_score" else c).alias(c) for c in docs.columns]
    return scored.select(*given)


def op9_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    divisor, remainder = HELD_OUT
    held_out = F.coalesce(id_remainder(F.col("doc_id"), divisor) == remainder, F.lit(False))
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
