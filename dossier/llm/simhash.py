"""SimHash near-duplicates by a self-join of the trie of fingerprints.

Documents with one fingerprint form a class, so copies cost one node however many
there are. Fingerprints that differ in at most ``budget`` bits agree in at least one
of ``budget + 1`` blocks of bits; each fingerprint is sent once per block, and those
that share a block's value share a binary trie over the other bits. The join walks
pairs of trie nodes together, adds up differing bits, and drops a pair of subtrees
as soon as the budget is exceeded. A task hands on a spanning forest of the links it
found, not the pairs: components are the same, and a group of near copies costs as
many edges as it has fingerprints.

Defined results: texts without a word have fingerprint zero and are linked like any
other; rows without an id get a fingerprint and, where a document with an id is in
reach, its component, else null; rows that repeat an id are one document; an empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import chunks, fresh, LOWER, table, UPPER
from dossier.llm.components import components
from dossier.session import materialise

SHINGLE = 4
BUDGET = 4
SEED = 42
CHUNK_BYTES = 16 << 20
#: Node pairs that are expanded at once; bounds a task's memory.
FRONTIER = 1 << 18

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words, of all words if fewer; none without words."""
    import xxhash

    words = _BLANKS.split((text or "").encode("utf-8", "replace").translate(_LOWER).strip(b" \t\n\x0b\x0c\r"))
    if words == [b""]:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; zero without words."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 4096):
        bits = np.unpackbits(hashes[start : start + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; the fingerprint's 64 bits as a long."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            prints = np.array([fingerprint(x, shingle) for x in chunk["text"].to_pylist()], np.uint64)
            ids = chunk["doc_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(printed, "doc_id long, fp long")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each of ``budget + 1`` blocks that cover 64 bits."""
    edges = [round(i * 64 / (budget + 1)) for i in range(budget + 2)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


class Forest:
    """Union-find over positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = root[root]
                if np.array_equal(further, root):
                    break
                root[:] = further


def trie_links(groups: np.ndarray, prints: np.ndarray, budget: int) -> np.ndarray:
    """For each fingerprint a position of its component among links inside its group.

    Rows are sorted by (group, fingerprint), so a trie node is a range of rows. Each
    step descends one bit in all node pairs of the frontier.
    """
    forest = Forest(len(prints))
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    stops = np.concatenate([starts[1:], [len(groups)]])
    many = stops - starts > 1
    starts, stops = starts[many], stops[many]
    stack = []
    for i in range(0, len(starts), FRONTIER):
        a, b = starts[i : i + FRONTIER], stops[i : i + FRONTIER]
        stack.append((63, a, b, a, b, np.zeros(len(a), np.int8)))
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if bit < 0:
            # Equal fingerprints do not occur within a group.
            single[:] = True
        if single.any():
            a, b = alo[single], blo[single]
            near = (np.bitwise_count(prints[a] ^ prints[b]) <= budget) & (a != b)
            forest.link(a[near], b[near])
            go = ~single
            alo, ahi, blo, bhi, diff = alo[go], ahi[go], blo[go], bhi[go], diff[go]
        if not len(alo):
            continue
        mask = np.uint64(1 << bit)
        amid, bmid = _middle(prints, alo, ahi, mask), _middle(prints, blo, bhi, mask)
        own = alo == blo
        quads = [
            (alo, amid, blo, bmid, diff, None),
            (amid, ahi, bmid, bhi, diff, None),
            (alo, amid, bmid, bhi, diff + 1, None),
            (amid, ahi, blo, bmid, diff + 1, ~own),  # of a node with itself, once
        ]
        parts = []
        for al, ah, bl, bh, d, only in quads:
            keep = (ah > al) & (bh > bl) & (d <= budget)
            if only is not None:
                keep &= only
            parts.append([x[keep] for x in (al, ah, bl, bh, d)])
        columns = [np.concatenate(x) for x in zip(*parts)]
        for i in range(0, len(columns[0]), FRONTIER):
            stack.append((bit - 1, *(x[i : i + FRONTIER] for x in columns)))
    return forest.root


def _middle(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.uint64) -> np.ndarray:
    """First row in each range whose bit is set; the ranges are sorted and agree above it."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        is_set = (prints[np.minimum(mid, len(prints) - 1)] & mask) != 0
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)


def links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (u, v) between representatives of classes (fp, rep): a forest per block value."""
    blocks = F.array(
        *(
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", low).bitwiseAND((1 << bits) - 1).alias("value"))
            for i, (low, bits) in enumerate(_blocks(budget))
        )
    )
    sent = classes.filter("rep IS NOT NULL").select("fp", "rep", F.inline(blocks))
    # A block has at most 2^32 values: one number names block and value.
    sent = sent.select((F.col("block") * F.lit(1 << 40) + F.col("value")).alias("block"), "fp", "rep")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per row 24 bytes, and every fingerprint is here at most once per block.
        rows = pa.Table.from_batches(list(batches), SENT)
        groups = rows["block"].to_numpy()
        prints = rows["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((prints, groups))
        reps = rows["rep"].to_numpy()[order]
        root = trie_links(groups[order], prints[order], budget)
        tied = root != np.arange(len(root))
        yield pa.RecordBatch.from_arrays([pa.array(reps[tied]), pa.array(reps[root[tied]])], ["u", "v"])

    return sent.repartition("block").mapInArrow(joined, "u long, v long").distinct()


SENT = pa.schema([("block", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64())])


def near_components(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes, budget))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The documents with the smallest id of each component; rows without an id stay."""
    others = near_components(docs, shingle, budget).filter("component_id < doc_id")
    (name,) = fresh(docs, "gone")
    gone = others.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


def op6_simhash(spark, sf_dir) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
