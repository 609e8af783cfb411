"""Runs of words that repeat with a period, found by a sparse dynamic program on lags.

A run with smallest period q is a diagonal of the table word x word: its words equal
those q places before. The program goes through a text once. Each word is looked up
among its earlier occurrences; the distance to one, the lag, is a diagonal, and the
length reached on it so far grows by one if the word before was on it as well. A
diagonal that is not carried on has ended, and is emitted at once if it is long enough.

Single words would have too many earlier occurrences (of "the", every one before), so a
word counts together with the ``L - 1`` words after it, at one L for each stretch of lags
``low <= q <= high`` with ``2 * high <= L <= 3 * low``. That makes the table sparse and
loses nothing:

- Inside a run of period q, a stretch of ``L >= 2 q`` words has its *nearest* earlier
  occurrence exactly q before (a nearer one would give the run a smaller period), so one
  earlier occurrence per word and stretch of lags is enough.
- Every run is at least ``4 q`` words long, so it holds at least one stretch of
  ``L <= 3 q`` words that has the run's first q words before it.
- A diagonal of nearest occurrences at lag q from word i to word k is a run from
  ``i - q`` to ``k + L``; it can't be extended, and q is its smallest period.

Equal stretches get equal numbers by doubling: a number for two words from those of each
one, and so on, computed for a chunk of documents together. A stretch that occurs once
drops out, and with it all that contain it, so prose costs little beyond its words. Time
is n log n per text, also for one word repeated a million times.

A row's text is one task's work (numpy in ``mapInArrow``); nothing is shuffled. A task
holds one chunk of texts, or one long text.

Defined results: a null or blank text has no words, no runs and the digests of nothing;
repeated rows give one row each; without an id a text is taken as it is; an empty table
gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import chunks, table

#: A run is at least this many words and this many periods long.
LEAST = 6
PERIODS = 4
#: Texts worked on together.
CHUNK_BYTES = 2 << 20


def stretches(n: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, L) of the lags a text of n words can have runs at."""
    low = 1
    while PERIODS * low <= n:
        high = max(low, 3 * low // 2)
        yield low, high, 2 * high
        low = high + 1


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word that is the same for equal words of one text, and text ends."""
    numbers, ends, base = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers += [base + known.setdefault(word, len(known)) for word in words]
        ends.append(len(numbers))
        base += len(known)
    return np.array(numbers, np.int64), np.array(ends, np.int64)


def _again(keys: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the keys by place; -1 where a key occurs once or there is none."""
    out = np.full(size, -1, np.int64)
    codes = pd.factorize(keys)[0]
    repeated = np.bincount(codes, minlength=1)[codes] > 1 if len(codes) else np.zeros(0, bool)
    out[places[repeated]] = codes[repeated]
    return out


def occurrences(words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each stretch of lags: L, the words with an earlier occurrence there, their lags."""
    n, sizes = len(words), np.diff(ends, prepend=0)
    if not n:
        return
    text_end = np.repeat(ends, sizes)
    doubled = [_again(words, np.arange(n), n)]

    def pairs(left: np.ndarray, step: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and places of stretches that start and end with repeated ones."""
        at = np.flatnonzero(left >= 0)
        at = at[at + length <= text_end[at]]
        right = left[at + step] if len(at) else at
        at, right = at[right >= 0], right[right >= 0]
        return left[at] * n + right, at

    for low, high, length in stretches(int(sizes.max())):
        # Numbers of stretches of 2^k words, for the largest 2^k within this length.
        k = length.bit_length() - 1
        while len(doubled) <= k:
            half = 1 << (len(doubled) - 1)
            doubled.append(_again(*pairs(doubled[-1], half, 2 * half), n))
        if (doubled[k] < 0).all():
            return
        keys, at = pairs(doubled[k], length - (1 << k), length)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        lag = np.diff(at, prepend=0)
        near = (np.diff(keys, prepend=-1) == 0) & (lag >= low) & (lag <= high)
        if near.any():
            found = np.argsort(at[near])
            yield length, at[near][found], lag[near][found]


def diagonals(places: list[int], lags: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of one text, from words in order with one lag each."""
    lag, first, last = 0, 0, -2
    for place, found in zip(places, lags):
        if found == lag and place == last + 1:
            last = place
            continue
        if lag and last + length - first + lag >= max(LEAST, PERIODS * lag):
            yield first - lag, last + length - first + lag, lag
        lag, first, last = found, place, place
    if lag and last + length - first + lag >= max(LEAST, PERIODS * lag):
        yield first - lag, last + length - first + lag, lag


def runs_of(texts: list[list[bytes]]) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start and period, for the texts that have any."""
    words, ends = numbered(texts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for length, at, lag in occurrences(words, ends):
        text = np.searchsorted(ends, at, side="right")
        at = at - np.where(text > 0, ends[text - 1], 0)
        bounds = np.flatnonzero(np.diff(text, prepend=-1)).tolist() + [len(text)]
        for start, stop in zip(bounds, bounds[1:]):
            part = slice(start, stop)
            runs = list(diagonals(at[part].tolist(), lag[part].tolist(), length))
            if runs:
                found.setdefault(int(text[start]), []).extend(runs)
    return {text: sorted(runs, key=lambda r: (r[0], r[2])) for text, runs in found.items()}


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those a run repeats after its first period."""
    kept, done = [], 0
    for start, length, period in sorted(runs, key=lambda r: r[0] + r[2]):
        if start + period > done:
            kept += words[done : start + period]
        done = max(done, start + length)
    return kept + words[done:]


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text, by its id, repeats a stretch of its own words up to its end."""
    n, h = len(words), 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + period]
    return words[:a] + (unit * -(-(n - a) // period))[: n - a]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SPANS = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed_text", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _mapped(docs: DataFrame, schema: pa.Schema, ddl: str, row, planted: bool) -> DataFrame:
    """One row per document of ``row(doc_id, words, runs)``."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            ids = chunk["doc_id"].to_pylist()
            # Splitting bytes without a separator splits at the six ASCII blanks.
            texts = [(text.as_py() or b"").split() for text in chunk["text"]]
            if planted:
                texts = [with_planted_run(*pair) for pair in zip(ids, texts)]
            runs = runs_of(texts)
            yield _table([row(i, words, runs.get(n, [])) for n, (i, words) in enumerate(zip(ids, texts))], schema)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(detect, ddl)


def detect_runs(docs: DataFrame) -> DataFrame:
    """doc_id, the runs of its words, and the text without their repetitions."""

    def row(doc_id, words, runs):
        spans = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        return doc_id, spans, b" ".join(collapsed(words, runs)).decode("utf-8", "replace")

    runs = "array<struct<start: long, length: long, period: long>>"
    return _mapped(docs, SPANS, f"doc_id long, runs {runs}, collapsed_text string", row, planted=False)


DIGEST = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def _digest(doc_id, words, runs) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    start, length, period = best
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    exponent = 1000 * length // period if runs else None
    kept = b" ".join(collapsed(words, runs) if runs else words)
    return (
        doc_id, len(runs), start, length, period, exponent,
        sha256(listed).hexdigest(), sha256(kept).hexdigest(),
    )


def run_digests(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all and of what is left."""
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in DIGEST)
    return _mapped(docs, DIGEST, ddl, _digest, planted)


def op11_periodic_runs(spark, sf_dir) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), planted=True)
