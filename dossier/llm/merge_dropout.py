"""Subword encoding with seeded merge-dropout, and decoding.

The merges of a SentencePiece model of the merge type run over an agenda: the pair
with the highest score merges first, the leftmost among equals. With dropout, a
candidate that reaches the head of the agenda is skipped when a hash, keyed by seed,
document, number of the word in its text, place and merged piece, falls below the
rate; it stays skipped until one of its sides changes. So every occurrence of a word
draws its own merges. Texts are cut before each run of spaces, which no piece crosses.
The words of a chunk are encoded together, one agenda step of all words at a time:
occurrences of a word share an agenda for as long as they have drawn alike, and it
splits where some skip and others merge. Words too long for that go by a heap.

Characters outside the vocabulary become byte pieces, so decoding gives back every
text exactly, U+2581 included. The model's path is a parameter; the file is read on
each machine from the installed package.

Defined results: null and empty texts have no ids and decode to the empty text; rows
without an id use the key of id 0; repeated rows get the same ids; an empty table
gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import chunks, table

RATE = 0.1
SEED = 42
#: Longer words are encoded by themselves, over a heap.
LONG = 32
CHUNK_BYTES = 8 << 20
#: Occurrences whose words are encoded in one step over all words.
ROWS = 1 << 16

_WORDS = re.compile(r" *[^ ]+| +")
_NONE = np.float32(-np.inf)
_MASK = (1 << 64) - 1


def _mix(x):
    """A 64-bit finalizer, for arrays of uint64 and for plain integers alike."""
    if isinstance(x, np.ndarray):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class Merges:
    """The tables of a model, with spaces in place of its space marks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces: list[bytes] = [b""] * size
        self.byte_ids = np.zeros(256, np.int32)
        self.score = np.full(size, _NONE, np.float32)
        by_text: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                by_text[piece] = i
                self.pieces[i] = piece.encode()
                self.score[i] = model.get_score(i)
        # Characters that only occur inside pieces get numbers beyond the vocabulary.
        self.char_ids = np.full(0x110000, -1, np.int32)
        symbols = dict(by_text)
        for piece in by_text:
            for char in piece:
                symbols.setdefault(char, size + len(symbols))
        for text, i in symbols.items():
            if len(text) == 1:
                self.char_ids[ord(text)] = i
        keys, merged = [], []
        for piece, i in by_text.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.pairs = dict(zip(keys, merged))
        self.size = size

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece (-1: none) and score of adjacent symbols."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        piece = np.where(found, self.merged[at], -1)
        return piece, np.where(found, self.score[piece], _NONE)

    def encode_words(self, words: list[str], keys: np.ndarray, rate: float) -> list[np.ndarray]:
        """Ids of each word; ``keys`` are the words' hash keys."""
        forms, form = self._encode_places(words, np.arange(len(words)), keys, rate)
        return [forms[i] for i in form]

    def _encode_places(self, words: list[str], at: np.ndarray, keys: np.ndarray, rate: float):
        """Distinct results, and which of them each occurrence gets: the word's number, a hash key."""
        forms: list[np.ndarray] = []
        form = np.zeros(len(at), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        # Occurrences by word, the short words first.
        by_word = np.argsort(rank[at], kind="stable")
        ends = np.cumsum(np.bincount(rank[at], minlength=len(words)))
        n_short = int(np.searchsorted(sizes[order], LONG, side="right"))
        first = 0
        while first < n_short:
            begin = int(ends[first - 1]) if first else 0
            last = max(first + 1, min(n_short, int(np.searchsorted(ends, begin + ROWS, side="right"))))
            rows, mine = order[first:last], by_word[begin : ends[last - 1]]
            width = int(sizes[rows[-1]])
            joined = "".join(words[i].ljust(width, "\x00") for i in rows)
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(rows), width)
            for ids, starts, left, origin, who, node in self._encode_block(
                codes, sizes[rows], rank[at[mine]] - first, keys[mine], rate
            ):
                form[mine[who]] = len(forms) + node
                strange = ((ids < 0) | (ids >= self.size)) & (np.arange(width) < left[:, None])
                plain = (~strange.any(axis=1)).tolist()
                for n, size in enumerate(left.tolist()):
                    found = ids[n, :size]
                    if not plain[n]:
                        found = self._with_bytes(words[rows[origin[n]]], found, starts[n, :size].tolist())
                    forms.append(found)
            first = last
        for i in by_word[int(ends[n_short - 1]) if n_short else 0 :]:
            form[i] = len(forms)
            forms.append(self._encode_long(words[at[i]], int(keys[i]), rate))
        return forms, form

    def _with_bytes(self, word: str, ids, places: list[int]) -> np.ndarray:
        """Symbols that are no pieces (always single characters) as their bytes."""
        parts = []
        for i, place in zip(ids, places):
            if 0 <= i < self.size:
                parts.append([i])
            else:
                parts.append(self.byte_ids[np.frombuffer(word[place].encode(), np.uint8)])
        return np.concatenate(parts).astype(np.int32)

    def _encode_block(self, codes, sizes, node, keys, rate):
        """Agenda steps of many words at once, for occurrences (row of ``codes``, hash key).

        Yields what ends at a step: symbols, their places, symbols per result, row of
        ``codes``; and the occurrences with the number of their result among those.
        """
        n, width = codes.shape
        columns = np.arange(width)
        ids = np.where(columns < sizes[:, None], self.char_ids[codes], -1)
        starts = np.broadcast_to(columns.astype(np.int32), ids.shape)
        left, origin, who = sizes, np.arange(n), np.arange(len(keys))
        if width < 2:
            yield ids, starts, left, origin, who, node
            return
        piece, score = self.candidates(ids[:, :-1], ids[:, 1:])
        limit = np.uint64(min(rate, 1.0) * float(1 << 53))
        while len(ids):
            each = np.arange(len(ids))
            best = score.argmax(axis=1)
            going = score[each, best] > _NONE
            if not going.all():
                ended, number = ~going, np.where(going, np.cumsum(going), np.cumsum(~going)) - 1
                out = ended[node]
                yield ids[ended], starts[ended], left[ended], origin[ended], who[out], number[node[out]]
                ids, starts, left, origin, piece, score, best = (
                    x[going] for x in (ids, starts, left, origin, piece, score, best)
                )
                node, who, keys = number[node[~out]], who[~out], keys[~out]
                each = each[: len(ids)]
                if not len(ids):
                    return
            new = piece[each, best]
            if rate > 0:
                salt = _mix((starts[each, best].astype(np.uint64) << np.uint64(32)) | new.astype(np.uint64))
                skips = (_mix(keys ^ salt[node]) >> np.uint64(11)) < limit
            else:
                skips = np.zeros(len(keys), bool)
            # An agenda goes on as up to two: of those that skip and of those that merge.
            code = node * 2 + skips
            used = np.zeros(2 * len(ids), bool)
            used[code] = True
            node = (np.cumsum(used) - 1)[code]
            code = np.flatnonzero(used)
            parent, skipped = code >> 1, (code & 1).astype(bool)
            ids, starts, left, origin, piece, score, best, new = (
                x[parent] for x in (ids, starts, left, origin, piece, score, best, new)
            )
            score[skipped, best[skipped]] = _NONE
            rows = np.flatnonzero(~skipped)
            if len(rows):
                at = best[rows]
                # Everything right of the merged pair moves one place to the left.
                shift = np.minimum(columns + (columns > at[:, None]), width - 1)
                ids[rows] = np.take_along_axis(ids[rows], shift, axis=1)
                starts[rows] = np.take_along_axis(starts[rows], shift, axis=1)
                ids[rows, width - 1] = -1
                ids[rows, at] = new[rows]
                left[rows] -= 1
                shift = np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 2)
                piece[rows] = np.take_along_axis(piece[rows], shift, axis=1)
                score[rows] = np.take_along_axis(score[rows], shift, axis=1)
                score[rows, width - 2] = _NONE
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < width - 1)
                    r, c = rows[ok], side[ok]
                    piece[r, c], score[r, c] = self.candidates(ids[r, c], ids[r, c + 1])

    def _encode_long(self, word: str, key: int, rate: float) -> np.ndarray:
        """The same agenda for one word, over a heap and linked symbols."""
        ids = self.char_ids[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        limit, agenda = int(min(rate, 1.0) * float(1 << 53)), []

        def add(a: int, b: int) -> None:
            if a < 0 or b < 0 or ids[a] < 0 or ids[b] < 0:
                return
            merged = self.pairs.get((ids[a] << 32) | ids[b])
            if merged is not None:
                heapq.heappush(agenda, (-float(self.score[merged]), a, b, ids[a], ids[b], merged))

        for a in range(n - 1):
            add(a, a + 1)
        while agenda:
            _, a, b, left, right, merged = heapq.heappop(agenda)
            if ids[a] != left or ids[b] != right or after[a] != b:
                continue
            if rate > 0 and _mix(key ^ _mix((a << 32) | merged)) >> 11 < limit:
                continue
            ids[a], ids[b] = merged, -2
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            add(before[a], a)
            add(a, after[a])
        at, kept, places = 0, [], []
        while at >= 0:
            kept.append(ids[at])
            places.append(at)
            at = after[at]
        return self._with_bytes(word, kept, places)

    def encode(self, texts: list[str | None], keys: list[int], rate: float = RATE, seed: int = SEED) -> list[np.ndarray]:
        """Ids of each text; ``keys`` tell the texts' draws apart."""
        known: dict[str, int] = {}
        number = known.setdefault
        places: list[np.ndarray] = []
        drawn: list[np.ndarray] = []
        for text, key in zip(texts, keys):
            cut = _WORDS.findall(" " + text) if text else []
            places.append(np.array([number(word, len(known)) for word in cut], np.int64))
            first = np.uint64(_mix((_mix(key & _MASK) + seed) & _MASK))
            drawn.append(first + np.arange(len(cut), dtype=np.uint64))
        if not known:
            return [np.zeros(0, np.int32) for _ in texts]
        ends = np.cumsum([len(found) for found in places])
        encoded, form = self._encode_places(list(known), np.concatenate(places), _mix(np.concatenate(drawn)), rate)
        places = np.split(form, ends[:-1])
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.concatenate(encoded)
        offsets = np.cumsum(sizes) - sizes
        out = []
        for found in places:
            lengths = sizes[found]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.arange(total) + np.repeat(offsets[found] - ends + lengths, lengths)])
        return out

    @staticmethod
    def _keys(words: list[str], kinds: list[int], seed: int) -> np.ndarray:
        import xxhash

        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(word, seed & _MASK) for word in words), np.uint64, len(words))
        return _mix(hashes + np.array(kinds, np.uint64))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; exact for every result of ``encode``."""
        if not len(ids):
            return ""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, rate: float = RATE, seed: int = SEED, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), and whether decoding gave back the text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path or model_path())
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            texts = chunk["text"].to_pylist()
            keys = [x or 0 for x in chunk["doc_id"].to_pylist()]
            found = model.encode(texts, keys, rate, seed)
            same = [model.decode(ids) == (text or "") for ids, text in zip(found, texts)]
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"].combine_chunks(), pa.array(found, pa.list_(pa.int32())), pa.array(same)],
                ["doc_id", "ids", "lossless"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(encoded, "doc_id long, ids array<int>, lossless boolean")


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path or model_path())
        for batch in batches:
            texts = [model.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id long, text string")


def op8_merge_dropout(spark, sf_dir) -> DataFrame:
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            sums = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in ids]
            sizes = [len(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(sums), batch.column("lossless")],
                ["doc_id", "n_ids", "ids_crc32", "lossless"],
            )

    schema = "doc_id long, n_ids long, ids_crc32 long, lossless boolean"
    return encode_documents(table(spark, sf_dir, "documents")).mapInArrow(digests, schema)
