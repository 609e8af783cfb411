"""Best-fit packing of tokenized documents into sequences of a fixed length.

Tokenizing is one pass without a shuffle; what it hands on is one narrow row per
piece. Pieces are dealt into groups of about ``GROUP_TOKENS`` tokens by a hash of
their place, and each group is packed online: a fixed number of open bins, a bitset
keyed by free space to find the bin that fits best, and the fullest bin closes when
there are too many. Inside a group the longest pieces come first, so that short ones
fill what long ones leave. A group wastes at most its last open bins.

Ids: those of the byte-level vocabulary's ``tokenizers`` file. They are computed from
its rank table, which gives the same ids at about four times the speed (README has the
figures; tests compare both). The query and the pipeline read the strings of the file's
special tokens as these tokens, like the file as loaded; without ``special`` the strings
are ordinary text.

Defined results: a null text counts as empty, which is one piece with the end token
alone; equal pieces are packed in order of id and piece; repeated rows are packed
once each; a null id is kept; an empty table gives an empty result. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import chunks, table
from dossier.session import materialise

LENGTH = 1024
END = 2
OPEN_BINS = 1024
GROUP_TOKENS = 4_000_000
#: Texts tokenized before their pieces are handed on.
CHUNK_BYTES = 8 << 20

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)

# The pattern that cuts texts before merging, for this vocabulary. Runs
# that cannot give a character back are matched possessively; cuts stay the same.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)


@lru_cache(maxsize=2)
def encoder(ranks_file: str, special_file: str | None = None):
    import tiktoken

    special = {}
    if special_file:
        with open(special_file, encoding="utf-8") as described:
            added = json.load(described)["added_tokens"]
        special = {token["content"]: token["id"] for token in added}

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ranks_path() -> str:
    """The rank table of the vocabulary, from the installed package of each machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def special_path() -> str:
    """The file that names the vocabulary's special tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces; only the first may be shorter than ``length``."""
    if n <= length:
        return [n]
    first = n % length
    return [first] * (first > 0) + [length] * (n // length)


def token_pieces(
    docs: DataFrame, length: int = LENGTH, end: int = END, ranks_file: str | None = None, special: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file or ranks_path(), special_path() if special else None).encode_to_numpy
        allowed = "all" if special else set()
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            rows = ([], [], [], [], [])
            for doc_id, text in zip(chunk["doc_id"].to_pylist(), chunk["text"].to_pylist()):
                ids = np.append(encode(text or "", allowed_special=allowed, disallowed_special=()), end).astype("<u4")
                start = 0
                for piece, size in enumerate(cut(len(ids), length)):
                    crc = zlib.crc32(ids[start : start + size].tobytes())
                    for column, value in zip(rows, (doc_id, piece, start, size, crc)):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, PIECES)], schema=PIECES)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = LENGTH, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each item in turn, with at most ``open_bins`` bins open.

    Bit f of ``free`` is set while a bin with f free places is open; the lowest set
    bit from an item's length on is the best fit, the lowest of all the fullest bin.
    """
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, count, n_open = 0, 0, 0
    bins, offsets = [], []
    for size in lengths:
        fits = free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            chosen = at[space].pop()
            if not at[space]:
                free ^= 1 << space
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (free & -free).bit_length() - 1
                at[fullest].pop()
                if not at[fullest]:
                    free ^= 1 << fullest
                n_open -= 1
            chosen, space = count, capacity
            count += 1
        bins.append(chosen)
        offsets.append(capacity - space)
        left = space - size
        if left:
            at[left].append(chosen)
            free |= 1 << left
            n_open += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start and length.

    The rows are written once: counting them decides how many groups there are.
    """
    rows = materialise(pieces, "pieces")
    total = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // GROUP_TOKENS))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(
            ["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable"
        )
        bins, offsets = best_fit(frame["length"].tolist(), capacity, open_bins)
        frame["sequence_id"] = (np.int64(key[0]) << 32) + np.array(bins, dtype=np.int64)
        frame["offset"] = np.array(offsets, dtype=np.int64)
        return frame.drop(columns="_group")

    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_group", group).groupBy("_group").applyInPandas(
        packed, f"{schema}, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS, special: bool = False
) -> DataFrame:
    return pack(token_pieces(docs, length, end, special=special), length, open_bins)


def op4_best_fit_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), special=True)
