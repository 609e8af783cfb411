"""Language-model scoring by a hidden Markov model of tokens.

Latent states emit token classes: the ``HEAD`` most frequent training tokens are a
class each, the end of a text is one, and all other tokens fall into ``TAIL_CLASSES``
classes by a hash of their last three characters. Inside such a class a token has its
smoothed relative frequency, so the model is a distribution over whole texts.

Counting tokens covers all training documents and leaves one row per distinct token.
Baum-Welch takes all training documents in disjoint shares, dealt by a hash of their
row, each twice as large as the one before: every task turns its documents of a share
into expected counts, which are added up by blocks of classes, and the model moves on to
the next share with these and half of what it had before. So early steps are cheap, the
last one sees half of all documents, and every share grows with the table. Training cuts texts into runs of
``RUN`` tokens; scoring uses the scaled forward recursion over whole texts and is
exact. Frequent tokens are known to every task (``HEAD`` bounds that table); the rest
of a text meets the token counts in one join, whose keys are rare tokens only.

A token is named by its 64-bit hash in that join.

Defined results: null and blank texts consist of the end token; rows without an id
are training rows; repeated rows count and are scored once each; an empty table
gives an empty result; without training rows every token is equally unknown. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import LOWER, UPPER, ascii_lower, chunks, id_remainder, table, words
from dossier.session import materialise

STATES = 8
HEAD = 32_768
TAIL_CLASSES = 512
#: Steps of the training; the first share is the table's 2 ** (1 - SHARES) th part.
SHARES = 8
#: Weight of the counts of the shares before.
MEMORY = 0.5
RUN = 256
#: Runs of tokens that the recursions take together.
RUNS_AT_ONCE = 512
SEED = 42
ADD = 0.1
#: Weight, in tokens, of the overall class distribution in a state's.
EMISSION_PRIOR = 50.0
CHUNK_BYTES = 4 << 20
#: Classes are added up in so many blocks.
BLOCKS = 16

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


@dataclass
class Model:
    """Everything a task needs; its size is bounded by the constants above."""

    head: dict[bytes, int]
    head_logs: np.ndarray
    tail_logs: np.ndarray
    base_log: float
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray = field(repr=False)

    def classes(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """Classes of the tokens of a text, the end last, and the rare tokens' hashes."""
        import xxhash

        h = xxhash.xxh64_intdigest
        head, first_tail = self.head, len(self.head) + 1
        found, rare = [], []
        for word in (text or "").encode("utf-8", "replace").translate(_LOWER).split():
            place = head.get(word)
            if place is None:
                rare.append(h(word, SEED))
                ending = word[-3:] if word.isascii() else word.decode()[-3:].encode()
                place = first_tail + (h(ending, SEED) & (TAIL_CLASSES - 1))
            found.append(place)
        found.append(0)
        return np.array(found, dtype=np.int32), rare


def tail_class(token: Column) -> Column:
    return F.xxhash64(F.right(token, F.lit(3))).bitwiseAND(TAIL_CLASSES - 1).cast("int")


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all training texts; the end token is the null token."""
    tokens = F.concat(words(ascii_lower(F.col("text"))), F.array(F.lit(None).cast("string")))
    exploded = train.select(F.explode(tokens).alias("token"))
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("c"))


def _most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows with the highest counts, ties by token.

    A histogram over the counts' logarithms, a few hundred rows, tells from which
    count on rows can be among them, so that tasks do not all send ``limit`` rows.
    """
    level = F.floor(F.log2("c") * 8)
    lowest, seen = 0, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        lowest, seen = row["level"], seen + row["count"]
        if seen >= limit:
            break
    return counts.filter(level >= lowest).orderBy(F.desc("c"), "token").limit(limit)


def vocabulary(counts: DataFrame, states: int = STATES) -> tuple[Model, DataFrame]:
    """A model before training, and the rare tokens as (h, c)."""
    spark = counts.sparkSession
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = n or 0, v or 0
    known = counts.filter("token IS NOT NULL")
    top = _most_frequent(known, HEAD).collect()
    ends = counts.filter("token IS NULL").first()
    named = spark.createDataFrame([(row["token"],) for row in top], "token string")
    rare = materialise(
        known.join(F.broadcast(named), "token", "left_anti").select(
            F.xxhash64("token").alias("h"), "c", tail_class(F.col("token")).alias("k")
        ),
        "rare",
    )
    per_class = rare.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    sums, kinds = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for row in per_class:
        sums[row["k"]], kinds[row["k"]] = row["n"], row["v"]
    head_counts = np.array([ends["c"] if ends else 0, *(row["c"] for row in top)], dtype=np.float64)
    class_counts = np.concatenate([head_counts, sums])
    overall = (class_counts + ADD) / (class_counts.sum() + ADD * len(class_counts))
    random = np.random.default_rng(SEED)
    emit = overall * (random.gamma(0.5, size=(states, len(overall))) + 0.01)
    model = Model(
        head={row["token"].encode(): i + 1 for i, row in enumerate(top)},
        head_logs=np.log10(head_counts + ADD),
        tail_logs=np.log10(sums + ADD * (kinds + 1)),
        base_log=float(np.log10(n + ADD * (v + 1))),
        start=np.full(states, 1.0 / states),
        move=np.where(np.eye(states, dtype=bool), 0.93, 0.07 / max(1, states - 1)) if states > 1 else np.ones((1, 1)),
        emit=emit / emit.sum(axis=1, keepdims=True),
    )
    return model, rare.select("h", "c")


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each class sequence, by the scaled forward recursion.

    The sequences advance together, longest first, so that those still running are
    always the first rows.
    """
    order = np.argsort([-len(x) for x in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([texts[i] for i in order])
    by_class = np.ascontiguousarray(model.emit.T)
    logs = np.zeros(len(texts))
    alpha = np.tile(model.start, (len(texts), 1))
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for t in range(sizes[0]):
        n = running[t]
        if t:
            alpha = alpha[:n] @ model.move
        alpha = alpha * by_class[flat[offsets[:n] + t]]
        scale = alpha.sum(axis=1)
        logs[:n] += np.log10(scale)
        alpha /= scale[:, None]
    out = np.zeros(len(texts))
    out[order] = logs
    return out


def expected_counts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts of runs of tokens: one row per state, columns start | move | emit."""
    states, k = model.emit.shape
    total = np.zeros((states, 1 + states + k))
    flat = np.concatenate(texts)
    cuts = [np.arange(0, len(x), RUN) for x in texts]
    starts = np.concatenate([c + o for c, o in zip(cuts, np.cumsum([0, *map(len, texts)]))])
    sizes = np.diff(np.append(starts, len(flat)))
    by_class = np.ascontiguousarray(model.emit.T, dtype=np.float32)
    move, start = model.move.astype(np.float32), model.start.astype(np.float32)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    for first in range(0, len(starts), RUNS_AT_ONCE):
        begin, size = starts[first : first + RUNS_AT_ONCE], sizes[first : first + RUNS_AT_ONCE]
        steps, n = size[0], len(begin)
        at = np.minimum(begin[None, :] + np.arange(steps)[:, None], len(flat) - 1)
        seen = flat[at]
        running = np.searchsorted(-size, -np.arange(steps), side="left")
        emitted = by_class[seen]
        alpha = np.zeros((steps, n, states), np.float32)
        for t in range(steps):
            m = running[t]
            a = (alpha[t - 1, :m] @ move if t else start) * emitted[t, :m]
            alpha[t, :m] = a / a.sum(axis=1, keepdims=True)
        moved = np.zeros((states, states))
        gamma = np.zeros_like(alpha)
        beta = np.ones((n, states), np.float32)
        for t in range(steps - 1, -1, -1):
            m = running[t]
            g = alpha[t, :m] * beta[:m]
            gamma[t, :m] = g / g.sum(axis=1, keepdims=True)
            if t:
                # beta is scaled freely: every use of it is normalised.
                ahead = emitted[t, :m] * beta[:m]
                weight = (alpha[t - 1, :m] @ move * ahead).sum(axis=1, keepdims=True)
                moved += (alpha[t - 1, :m].T @ (ahead / weight)) * move
                back = ahead @ move.T
                beta[:m] = back / back.sum(axis=1, keepdims=True)
        total[:, 0] += gamma[0].sum(axis=0)
        total[:, 1 : 1 + states] += moved
        live = np.arange(steps)[:, None] < size[None, :]
        tokens, weights = seen[live], gamma[live]
        for s in range(states):
            total[s, 1 + states :] += np.bincount(tokens, weights=weights[:, s], minlength=k)
    return total


def counted(train: DataFrame, model: Model) -> np.ndarray | None:
    """Expected counts over ``train``: those of each task, added up by blocks of columns."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, None
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            found = expected_counts(known, [known.classes(x)[0] for x in chunk["text"].to_pylist()])
            total = found if total is None else total + found
        if total is not None:
            parts = [np.ascontiguousarray(x).tobytes() for x in np.array_split(total, BLOCKS, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS)), pa.array(parts)], ["block", "counts"])

    def added(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for frame in batches:
            for part in frame["counts"]:
                total = total + np.frombuffer(part)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    parts = train.select(F.col("text").cast("string")).mapInArrow(of_task, "block long, counts binary")
    rows = parts.groupBy("block").applyInPandas(added, "block long, counts binary").orderBy("block").collect()
    shared.unpersist()
    if not rows:
        return None
    states = len(model.start)
    return np.concatenate([np.frombuffer(row["counts"]).reshape(states, -1) for row in rows], axis=1)


def moved(model: Model, total: np.ndarray) -> Model:
    """The model that expected counts lead to."""
    states, k = model.emit.shape
    start, move, emit = total[:, 0] + 0.1, total[:, 1 : 1 + states] + 0.1, total[:, 1 + states :]
    overall = (emit.sum(axis=0) + ADD) / (emit.sum() + ADD * k)
    emit = emit + EMISSION_PRIOR * overall
    return Model(
        model.head, model.head_logs, model.tail_logs, model.base_log,
        start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True),
    )


def fit(train: DataFrame, states: int = STATES, shares: int = SHARES):
    """(model, rare token counts, N) from all rows of ``train``."""
    counts = materialise(token_counts(train), "tokens")
    model, rare = vocabulary(counts, states)
    # The last share has the upper half of the numbers, the one before the next quarter.
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(SEED)), F.lit(1 << (shares - 1)))
    total: np.ndarray | float = 0.0
    for share in range(shares):
        low, high = (1 << share) >> 1, 1 << share
        found = counted(train.filter((place >= low) & (place < high)), model)
        if found is not None:
            total = MEMORY * total + found
            model = moved(model, total)
    return model, rare, counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]


SCORED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
        ("n_frequent", pa.int64()), ("base_part", pa.float64()), ("score_part", pa.float64()),
        ("rare", pa.list_(pa.int64())),
    ]
)


def score(docs: DataFrame, model: Model, rare_counts: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, text) to doc_id, held_out, n_tokens, n_known, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        frequent = known.head_logs
        row = TaskContext.get().partitionId() << 33
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            pairs = [known.classes(x) for x in chunk["text"].to_pylist()]
            forwards = forward(known, [x for x, _ in pairs])
            columns = [[] for _ in range(5)]
            for (found, rare), likelihood in zip(pairs, forwards):
                head = found[found < len(frequent)]
                tail = found[found >= len(frequent)] - len(frequent)
                base = float(frequent[head].sum()) - len(found) * known.base_log
                seen = len(head) - int(frequent[0] < np.log10(2 * ADD))  # the end, if never trained on
                unseen = float(np.log10(ADD)) * len(tail)
                values = (
                    len(found), seen, base + unseen,
                    likelihood + unseen - float(known.tail_logs[tail].sum()),
                    np.array(rare, dtype=np.uint64).view(np.int64),
                )
                for column, value in zip(columns, values):
                    column.append(value)
            ids = pa.array(np.arange(row, row + len(pairs)))
            row += len(pairs)
            arrays = [ids, chunk["doc_id"].combine_chunks(), chunk["held_out"].combine_chunks()]
            arrays += [pa.array(c, f.type) for c, f in zip(columns, list(SCORED)[3:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=SCORED)

    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, "
        "base_part double, score_part double, rare array<long>"
    )
    parts = materialise(docs.select("doc_id", "held_out", "text").mapInArrow(scored, schema), "scored")
    met = parts.select("row", F.explode("rare").alias("h")).join(rare_counts, "h")
    gain = F.log10(F.col("c") + ADD) - F.log10(F.lit(ADD))
    rare = met.groupBy(F.col("row").alias("_row")).agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("n"))
    joined = parts.drop("rare").join(rare, F.col("row") == F.col("_row"), "left")
    gained = F.coalesce("gain", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n", F.lit(0))).alias("n_known"),
        (F.col("base_part") + gained).alias("base_score"),
        (F.col("score_part") + gained).alias("score"),
    )


def op7_hmm_scoring(spark, sf_dir) -> DataFrame:
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string")
    )
    model, rare, total = fit(docs.filter("NOT held_out"))
    return score(docs, model, rare).withColumn("train_tokens", F.lit(total).cast("long"))
