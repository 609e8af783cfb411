"""Suffix-array dedup: repeated stretches of bytes go, all but the first document's.

A byte goes if a string of ``MATCH`` bytes around it also starts in a document with a
smaller id. Suffixes are sorted by mergesort; two of them are compared through
polynomial prefix hashes, a binary search over lengths finding their common
extension, and all extensions in the sorted order are verified byte by byte.

To sort in parallel, every string of ``MATCH`` bytes is assigned to its anchor: the
``GRAM`` bytes inside it with the smallest hash, the leftmost of equals. Equal strings
have equal anchors. Strings in a row with one anchor form a run, about 70 bytes long
and 17 bytes apart; runs are dealt into buckets by their anchor's hash, and a bucket
sorts its runs' suffixes from the anchor on, and their reversed prefixes before it.
Both orders with their common extensions tell which strings of a run occur in a
smaller document.

What bounds a task: texts are read in chunks; equal runs of a chunk are sent once,
with the smallest id, and the others are settled on the spot, so a group of copies
costs its first member and a few bytes per chunk. An anchor with many different
surroundings, as at the edges of a very common line, would fill one bucket; such
anchors are found in a sample beforehand, and their runs are sent string by string,
dealt by the whole string. The sample decides where strings go, not what goes.

Defined results: null texts count as empty; texts shorter than ``MATCH`` bytes stay;
rows without an id are left alone and not compared with; rows that repeat an id are
one document, from each of which goes what goes from any; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import chunks, table
from dossier.session import materialise

MATCH = 50
GRAM = 12
CHUNK_BYTES = 8 << 20
#: Of the bytes of a string before its anchor, so many count as many.
LEFT = 19
#: Bytes whose anchors are found at once.
BLOCK_BYTES = 1 << 20
#: Longer texts are cut into pieces that overlap by ``MATCH - 1`` bytes.
PIECE_BYTES = 16 << 20
#: Texts per bucket, about; a bucket is one group of a task.
BUCKET_BYTES = 4 << 20
#: Documents looked at for anchors with many surroundings, and when an anchor has many.
SAMPLE_DOCS = 20_000
HOT_RUNS = 100
LEVEL = 3

_PLACE = np.uint64((1 << 28) - 1)
_PRIME = np.uint64((1 << 31) - 1)
_BASE = 1_000_003


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place of ``data`` but the last few."""
    loads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8")[:, 0]
    return _mixed(loads[: len(loads) - (GRAM - 8)], loads[GRAM - 8 :])


def _hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The same hash at the given places only."""
    loads = np.lib.stride_tricks.sliding_window_view(data, 8)
    return _mixed(*(np.ascontiguousarray(loads[places + i]).view("<u8")[:, 0] for i in (0, GRAM - 8)))


def _mixed(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    h = head * np.uint64(0x9E3779B97F4A7C15)
    h ^= tail * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, place of the anchor of the string that starts at each place)."""
    h = _hashes(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, span = MATCH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    return h, (least & _PLACE).astype(np.int64)


def _pieces(docs: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (doc, place in the document, bytes)."""
    block, size = [], 0
    for doc, text in docs:
        for start in range(0, max(1, len(text) - MATCH + 1), PIECE_BYTES):
            piece = text[start : start + PIECE_BYTES + MATCH - 1]
            if len(piece) >= MATCH:
                block.append((doc, start, piece))
                size += len(piece)
                if size >= BLOCK_BYTES:
                    yield block
                    block, size = [], 0
    if block:
        yield block


def runs(docs: list[tuple[int, bytes]], hot: np.ndarray) -> Iterator[tuple]:
    """Blocks of runs: documents, places, keys to deal them by, the anchors' places in
    the runs, and the runs' bytes.

    Runs come document by document as given. Those with an anchor in ``hot`` are
    split into their strings, whose key is a hash of the whole string.
    """
    for block in _pieces(docs):
        joined = b"".join(piece for _, _, piece in block)
        sizes = np.array([len(piece) for _, _, piece in block])
        ends = np.cumsum(sizes)
        data = np.frombuffer(joined, np.uint8)
        h, anchor = _anchors(data)
        valid = np.zeros(len(data) + 1, bool)
        for start, end in zip((ends - sizes).tolist(), ends.tolist()):
            valid[start : end - MATCH + 1] = True
        n = len(anchor)
        changed = np.ones(n + 1, bool)
        changed[1:n] = anchor[1:] != anchor[:-1]
        before = np.zeros(n, bool)
        before[1:] = valid[: n - 1]
        first = np.flatnonzero(valid[:n] & (changed[:n] | ~before))
        last = np.flatnonzero(valid[:n] & (changed[1:] | ~valid[1 : n + 1]))
        keys = h[anchor[first]]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            split = hot[at] == keys
            if split.any():
                # One run per string where the anchor is hot.
                counts = np.where(split, last - first + 1, 1)
                own = np.repeat(np.arange(len(first)), counts)
                step = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
                single = split[own]
                first, last, keys = first[own] + step, last[own], keys[own]
                last = np.where(single, first, last)
                whole = first[single]
                mixed = keys[single]
                for offset in range(0, MATCH - GRAM + 1, GRAM):
                    mixed = (mixed ^ h[whole + offset]) * np.uint64(0x9E3779B97F4A7C15)
                keys[single] = mixed ^ (mixed >> np.uint64(31)) ^ h[whole + MATCH - GRAM]
        piece = np.searchsorted(ends, first, side="right")
        base = np.array([start for _, start, _ in block]) - (ends - sizes)
        ids = np.array([doc for doc, _, _ in block], np.int64)[piece]
        cut = [joined[a:b] for a, b in zip(first.tolist(), (last + MATCH).tolist())]
        yield ids, first + base[piece], keys, anchor[first] - first, cut


def _planes(values: np.ndarray) -> bytes:
    """Bytes of numbers, all the lowest first: these compress well."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<i8")[:, 0]


def to_blob(ids: np.ndarray, places: np.ndarray, anchors: np.ndarray, texts: list[bytes]) -> bytes:
    import zstandard

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    steps = np.diff(ids, prepend=0)
    small = [x.astype(np.uint8).tobytes() for x in (sizes, anchors)]
    parts = [np.int64(len(texts)).tobytes(), _planes(steps), _planes(places), *small, *texts]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(ids, places, anchors, sizes, bytes of all runs)."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at = 8 + 16 * n
    ids = np.cumsum(_numbers(data[8 : 8 + 8 * n], n))
    places = _numbers(data[8 + 8 * n : at], n)
    sizes, anchors = np.frombuffer(data, np.uint8, 2 * n, at).astype(np.int64).reshape(2, n)
    return ids, places, anchors, sizes, data[at + 2 * n :]


def _merge_spans(ids: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Spans that touch or overlap within a document as one."""
    order = np.lexsort((low, ids))
    ids, low, high = ids[order], low[order], high[order]
    if not len(ids):
        return ids, low, high
    # Spans of the documents side by side on one line, to find each span's reach.
    rank = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
    wide = int(high.max()) + 1
    reach = np.maximum.accumulate(rank * wide + high)
    fresh = np.concatenate([[True], (rank * wide + low)[1:] > reach[:-1]])
    starts = np.flatnonzero(fresh)
    stops = np.append(starts[1:], len(ids)) - 1
    return ids[starts], low[starts], reach[stops] - rank[stops] * wide


class _Hashed:
    """Prefix hashes of bytes modulo a prime; equality of two stretches in a few steps."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.ones(n + 1, np.uint64)
        # base^i, doubling the known part each time.
        done, step = 1, _BASE
        while done < n + 1:
            take = min(done, n + 1 - done)
            powers[done : done + take] = powers[:take] * np.uint64(step) % _PRIME
            done, step = done + take, step * step % int(_PRIME)
        values = (data.astype(np.uint64) + np.uint64(1)) * powers[:n] % _PRIME
        self.powers, self.n, self.data = powers, n, data
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64) % _PRIME])

    def _hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        found = (self.prefix[start + size] + _PRIME - self.prefix[start]) % _PRIME
        return found * self.powers[self.n - start] % _PRIME

    def extension(self, a, a_end, b, b_end) -> np.ndarray:
        """Length of the common prefix of the stretches [a, a_end) and [b, b_end)."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(a_end - a, b_end - b)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = self._hash(a, mid) == self._hash(b, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def before(self, a, a_end, b, b_end, or_equal) -> np.ndarray:
        """Whether each stretch b sorts before a (or, where asked, is equal to it)."""
        common = self.extension(a, a_end, b, b_end)
        a_at, b_at = a + common, b + common
        a_over, b_over = a_at >= a_end, b_at >= b_end
        last = self.n - 1
        less = self.data[np.minimum(b_at, last)] < self.data[np.minimum(a_at, last)]
        return np.where(b_over, ~a_over | or_equal, ~a_over & less)


def sort_suffixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, extension): stretches sorted within each group, and what each has in
    common with the one before it (-1 for a group's first).

    ``group`` is ascending. A bottom-up mergesort: a stretch's place in the merged
    runs is its place in its own run plus its rank in the other one, found by binary
    search; all groups and runs advance together.
    """
    n = len(start)
    hashed = _Hashed(data)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, n))
    head, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    own = np.arange(n) - head
    run = 1
    while run < sizes.max(initial=0):
        at = np.flatnonzero(size > run)
        block = own[at] // run
        other = (block ^ 1) * run
        low = np.minimum(other, size[at])
        high = np.minimum(other + run, size[at])
        base, leftwards = low.copy(), block % 2 == 1
        me = order[at]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            them, mine = order[head[at[open_]] + mid], me[open_]
            # Equal stretches keep their order: those of the left run come first.
            less = hashed.before(start[mine], end[mine], start[them], end[them], leftwards[open_])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        place = head[at] + (block // 2) * 2 * run + own[at] % run + (low - base)
        merged = order.copy()
        merged[place] = me
        order = merged
        run *= 2
    extension = np.full(n, -1)
    inner = np.flatnonzero(own > 0)
    a, b = order[inner - 1], order[inner]
    extension[inner] = hashed.extension(start[a], end[a], start[b], end[b])
    if not _verified(data, start, end, a, b, extension[inner]):
        return _sort_plainly(data, start, end, group)
    return order, extension


def _verified(data, start, end, a, b, common) -> bool:
    """Whether neighbours agree in exactly ``common`` bytes and are in order."""
    last = len(data) - 1
    for step in range(int(common.max(initial=0))):
        on = common > step
        if (data[np.minimum(start[a] + step, last)] != data[np.minimum(start[b] + step, last)])[on].any():
            return False
    a_at, b_at = start[a] + common, start[b] + common
    a_over, b_over = a_at >= end[a], b_at >= end[b]
    less = data[np.minimum(a_at, last)] < data[np.minimum(b_at, last)]
    return bool((a_over | (~b_over & less)).all())


def _sort_plainly(data, start, end, group):
    """The same by comparing bytes, for the case of a hash collision."""
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
    order = np.array(sorted(range(len(texts)), key=lambda i: (group[i], texts[i], i)))
    extension = np.full(len(order), -1)
    for i in range(1, len(order)):
        a, b = texts[order[i - 1]], texts[order[i]]
        if group[order[i - 1]] == group[order[i]]:
            common = min(len(a), len(b))
            while a[:common] != b[:common]:
                common -= 1
            extension[i] = common
    return order, extension


def _stretch(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` bytes, 8 or more, at each place."""
    loads = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = np.zeros(len(places), np.uint64)
    for step in [*range(0, size - 8, 8), size - 8]:
        h = (h ^ np.ascontiguousarray(loads[places + step]).view("<u8")[:, 0]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _shared(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows whose key occurs in more than one document."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    sorted_keys, sorted_ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    several = np.minimum.reduceat(sorted_ids, first) != np.maximum.reduceat(sorted_ids, first)
    return order[np.repeat(several, np.diff(np.append(first, len(order))))]


def _least(key: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The smallest value among rows with the same key, for each row."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    least = np.minimum.reduceat(values[order], first)
    out = np.empty_like(values)
    out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def repeated_spans(ids: np.ndarray, places: np.ndarray, anchors: np.ndarray, sizes: np.ndarray, data: bytes):
    """(ids, low, high): what the runs of a bucket say goes from which document."""
    buffer = np.frombuffer(data, np.uint8)
    offsets = np.cumsum(sizes) - sizes
    at = offsets + anchors
    # A string has LEFT bytes before its anchor or MATCH - LEFT from it on; a run that
    # shares neither with another document is done with.
    met = np.zeros(len(ids), bool)
    for enough, low, size in ((anchors >= LEFT, -LEFT, LEFT + GRAM), (sizes - anchors >= MATCH - LEFT, 0, MATCH - LEFT)):
        rows = np.flatnonzero(enough)
        met[rows[_shared(_stretch(buffer, at[rows] + low, size), ids[rows])]] = True
    rows = np.flatnonzero(met)
    keys = _hashes_at(buffer, at[rows])
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))[: len(rows)]
    # Equal runs: all but the smallest document's go as a whole.
    numbers: dict[bytes, int] = {}
    kind = np.empty(len(rows), np.int64)
    for i, (a, b) in enumerate(zip(offsets[rows].tolist(), (offsets[rows] + sizes[rows]).tolist())):
        kind[i] = numbers.setdefault(data[a:b], len(numbers))
    least = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids[rows])
    whole = ids[rows] > least[kind]
    out = [(ids[rows][whole], places[rows][whole], places[rows][whole] + sizes[rows][whole])]
    # Different runs around one anchor: sort the suffixes on both sides of it.
    kinds, sample = np.unique(kind, return_index=True)
    own = np.argsort(group[sample], kind="stable")
    kinds, sample = kinds[own], sample[own]
    several = group[sample]
    first = np.flatnonzero(np.concatenate([[True], several[1:] != several[:-1]])) if len(several) else several
    counts = np.diff(np.append(first, len(several)))
    keep = np.repeat(counts > 1, counts)
    kinds, sample, several = kinds[keep], sample[keep], several[keep]
    if len(kinds):
        run = rows[sample]
        low, high = _covered(buffer, offsets[run], sizes[run], at[run] - offsets[run], several, least[kinds])
        place = np.full(len(numbers), -1)
        place[kinds] = np.arange(len(kinds))
        mine = np.flatnonzero(~whole & (place[kind] >= 0))
        mine = mine[high[place[kind[mine]]] > 0]
        row, found = rows[mine], place[kind[mine]]
        out.append((ids[row], places[row] + low[found], places[row] + high[found]))
    return [np.concatenate(x) for x in zip(*out)]


def _covered(buffer, offset, size, anchor, group, doc):
    """Of different runs, sorted by group: the part that smaller documents also have."""
    total = int(size.sum())
    begin = np.cumsum(size) - size
    gather = np.arange(total) + np.repeat(offset - begin, size)
    data = buffer[gather]
    middle, end = begin + anchor, begin + size
    right_order, right = sort_suffixes(data, middle, end, group)
    left_order, left = sort_suffixes(data[::-1], total - middle, total - begin, group)
    low, high = np.full(len(size), MATCH * 4), np.zeros(len(size), np.int64)
    n = len(size)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(0, MATCH - GRAM + 1):
        on = np.flatnonzero((anchor >= before) & (size - anchor >= MATCH - before))
        if len(on) < 2:
            continue
        right_class[right_order] = np.cumsum(right < MATCH - before)
        left_class[left_order] = np.cumsum(left < before)
        gone = on[_least(right_class[on] * (n + 1) + left_class[on], doc[on]) < doc[on]]
        low[gone] = np.minimum(low[gone], anchor[gone] - before)
        high[gone] = np.maximum(high[gone], anchor[gone] - before + MATCH)
    return low, high


def _sorted_docs(chunk: pa.Table) -> list[tuple[int, bytes]]:
    pairs = zip(chunk["doc_id"].to_pylist(), chunk["text"].to_pylist())
    return sorted((doc, text) for doc, text in pairs if doc is not None and text)


def hot_anchors(docs: DataFrame, total: int) -> np.ndarray:
    """Hashes of anchors with many different surroundings in a sample, ascending.

    ``total`` is the number of documents.
    """
    part = max(1, -(-total // SAMPLE_DOCS))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            nothing = np.zeros(0, np.uint64)
            keys = [np.zeros(0, np.uint64)]
            texts: set[bytes] = set()
            for _, _, found, _, cut in runs(_sorted_docs(chunk), nothing):
                fresh = []
                for text in cut:
                    fresh.append(text not in texts)
                    texts.add(text)
                keys.append(found[np.array(fresh, bool)])
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            some = counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[some].view(np.int64)), pa.array(counts[some])], ["anchor", "n"]
            )

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
    # At most the sample's runs divided by HOT_RUNS come back.
    counted = sample.mapInArrow(seen, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = [row[0] for row in counted.filter(F.col("n") >= HOT_RUNS).select("anchor").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): per document the places that go, as an array of (low, high)."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    total, size = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shared = spark.sparkContext.broadcast(hot_anchors(given, total))
    buckets = max(6 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            first: dict[bytes, int] = {}
            sent: list[list] = [[], [], [], [], []]
            gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for ids, places, keys, anchors, cut in runs(_sorted_docs(chunk), hot):
                owners = np.fromiter((first.setdefault(x, d) for x, d in zip(cut, ids.tolist())), np.int64, len(cut))
                # The chunk is in order of id, so an earlier owner is smaller.
                new = owners == ids
                done = ~new
                sizes = np.fromiter(map(len, cut), np.int64, len(cut))
                gone.append(_merge_spans(ids[done], places[done], (places + sizes)[done]))
                sent[0].append(ids[new])
                sent[1].append(places[new])
                sent[2].append(((keys[new] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64))
                sent[3].append(anchors[new])
                sent[4] += [x for x, keep in zip(cut, new.tolist()) if keep]
            first.clear()
            if not sent[0]:
                continue
            ids, places, bucket, anchors = (np.concatenate(x) for x in sent[:4])
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            texts = sent[4]
            for i, j in zip(edges.tolist(), np.append(edges[1:], len(order)).tolist()):
                rows = order[i:j]
                blob = to_blob(ids[rows], places[rows], anchors[rows], [texts[r] for r in rows.tolist()])
                yield _row(int(bucket[rows[0]]), True, blob)
            done = [np.concatenate(x) for x in zip(*gone)]
            if len(done[0]):
                # Settled in this chunk: any bucket may hand it on.
                number = int(done[0][0]) % buckets
                yield _row(number, False, np.stack(done).tobytes())

    def _row(bucket: int, runs_: bool, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int64()), pa.array([runs_]), pa.array([blob], pa.binary())],
            ["bucket", "runs", "blob"],
        )

    def _out(ids, low, high) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _merge_spans(ids, low, high)], ["doc_id", "low", "high"])

    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        *numbers, data = zip(*map(from_blob, blobs))
        found = repeated_spans(*map(np.concatenate, numbers), b"".join(data))
        return _out(*found)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for bucket, is_runs, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != current and held:
                    yield settle(held)
                    held = []
                current = bucket
                if is_runs:
                    held.append(blob)
                else:
                    ids, low, high = np.frombuffer(blob, np.int64).reshape(3, -1)
                    yield _out(ids, low, high)
        if held:
            yield settle(held)

    sent = given.mapInArrow(dealt, "bucket long, runs boolean, blob binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        compared, "doc_id long, low long, high long"
    )
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


#: What is left of each row's text.
CUT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]


def _cut(data: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, int, bytes]:
    """n_bytes, n_removed, n_spans and what is kept."""
    if not len(low):
        return len(data), 0, 0, data
    _, low, high = _merge_spans(np.zeros(len(low), np.int64), low, high)
    high = np.minimum(high, len(data))
    low = np.minimum(low, high)
    kept = [data[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(data)])]
    return len(data), int((high - low).sum()), int((high > low).sum()), b"".join(kept)


def _with_cut(docs: DataFrame, characters: bool = False) -> DataFrame:
    """(row, had_text, n_bytes, n_removed, n_spans, kept): each row but its text, and the cut.

    With ``characters``, one that loses some of its bytes goes as a whole. A task holds
    one chunk of texts at a time.
    """
    gone = materialise(spans(docs), "spans").withColumnRenamed("doc_id", "gone")
    others = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
    rows = docs.select(
        F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            spans_ = chunk["spans"].combine_chunks().fill_null([])
            low, high = (spans_.values.field(name).to_numpy() for name in ("low", "high"))
            edges = spans_.offsets.to_numpy().tolist()
            found = [
                _cut(text.as_py() or b"", low[i:j], high[i:j]) for text, i, j in zip(chunk["text"], edges, edges[1:])
            ]
            if characters:
                found = [(*x[:3], x[3].decode("utf-8", "ignore").encode() if x[1] else x[3]) for x in found]
            columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*found), CUT)]
            had_text = pa.chunked_array(chunk["text"].is_valid()).combine_chunks()
            row = chunk["row"].combine_chunks()
            names = ["row", "had_text", *(name for name, _ in CUT)]
            yield pa.RecordBatch.from_arrays([row, had_text, *columns], names=names)

    joined = rows.join(gone, F.col("id") == F.col("gone"), "left").select("row", "text", "spans")
    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        cut, f"row {row}, had_text boolean, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left) of each row."""
    return _with_cut(docs.select("doc_id", "text")).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated stretches cut from the texts, and n_chars to match.

    A character that loses some of its bytes goes as a whole. A text that loses all
    becomes empty; null texts stay null.
    """
    removed = F.col("n_removed") > 0
    text = F.when(F.col("had_text"), F.col("kept").cast("string"))
    rows = _with_cut(docs, characters=True).withColumn("text", text)
    out = []
    for field in docs.schema:
        if field.name == "text":
            value = F.col("text")
        elif field.name == "n_chars":
            held = F.col("row")[field.name]
            value = F.when(removed, F.length("text").cast(field.dataType)).otherwise(held)
        else:
            value = F.col("row")[field.name]
        out.append(value.alias(field.name))
    return rows.select(*out)


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
