"""Byte-level BPE, encoded left to right with an automaton instead of a merge loop.

The bytes of a piece are mapped to Latin-1 characters, one for one, so that an
Aho-Corasick automaton over the vocabulary finds the longest token that starts at each
byte in one pass. The encoder takes the longest token, and a shorter one, or the token
before it back, whenever the two neighbours are not compatible. Two neighbours are
compatible if merging their joint bytes gives just these two again, and a sequence is
the result of merging by rank exactly if all its neighbours are; verdicts are memoised.
No place is left twice by the same end, so a piece takes time in proportion to its
length, also one of a million letters.

A text is one row's work: it is cut into pieces by the vocabulary's pattern, and pieces
met before come from a cache of bounded size. No shuffle, nothing collected; a task
holds one chunk of texts and the ids of one text.

Defined results: a null text counts as empty (no ids, both digests those of nothing);
repeated rows and null ids give one row each; an empty table gives an empty result.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import chunks, table

#: Texts taken from Arrow at a time.
CHUNK_BYTES = 4 << 20
#: Pieces a task remembers, twice this at most: the older half is forgotten as a whole,
#: but pieces met again have by then moved to the younger one.
CACHE_PIECES = 200_000
#: Pairs of tokens with a known verdict; beyond, it starts afresh.
CACHE_PAIRS = 1_000_000
#: Longer pieces are encoded each time, so that the cache's bytes are bounded too.
CACHE_LENGTH = 64


def merged(piece: bytes, ranks: dict[bytes, int], barred: bytes | None = None) -> list[bytes]:
    """Parts of a short piece after merging by rank; ``barred`` is never formed."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        joined = [a + b for a, b in zip(parts, parts[1:])]
        at = min(
            (i for i, both in enumerate(joined) if both in ranks and both != barred),
            key=lambda i: ranks[joined[i]],
            default=None,
        )
        if at is None:
            break
        parts[at : at + 2] = [joined[at]]
    return parts


class Vocabulary:
    """Tokens by rank, with what the encoder needs to know of each."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        size = max(ranks.values()) + 1
        #: By rank: bytes, length, decimal text, and the longest shorter token it starts with.
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = list(map(len, self.tokens))
        self.names = list(map(str, range(size)))
        #: The two tokens whose merge forms a token; none for single bytes.
        self.halves: dict[int, tuple[int, int]] = {}
        self.single = [ranks[bytes([n])] for n in range(256)]
        # Single bytes are always found, so the automaton has the longer tokens only.
        self.automaton = ahocorasick.Automaton()
        formed = {bytes([n]) for n in range(256)}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merged(token, ranks, barred=token)
                # A token that merging can't form occurs as a whole piece only.
                if len(parts) == 2:
                    self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                    formed.add(token)
                    self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter: list[int | None] = [None] * size
        for token in formed:
            found = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in formed), None)
            self.shorter[ranks[token]] = None if found is None else ranks[found]
        #: Verdicts by left * size + right, and pieces with their ids.
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves both as they are."""
        pair = left * len(self.tokens) + right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undoes both tokens' merges, latest first, looking for an earlier merge across.

        Each state has the tokens that touched at some time while both were formed. A
        merge across them would have happened if it came before the merge that took
        either away, which is the one undone last.
        """
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        # The next merge on each side: (rank, side); at one rank the left one comes first.
        ended = (len(tokens) + 1, 0)
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and (across, 0.5) < ended:
                return False
            undo = max(((left, 0), (right, 1)), key=lambda x: (x[0] in halves, x[0], x[1]))
            if undo[0] not in halves:
                return True
            ended = undo
            if undo[1] == 0:
                left = halves[left][1]
            else:
                right = halves[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, the same as merging by rank gives."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, lengths, shorter, pairs, n_tokens = len(piece), self.lengths, self.shorter, self.pairs, len(self.tokens)
        longest = list(map(self.single.__getitem__, piece))
        for end, (n, rank) in self.automaton.iter(piece.decode("latin-1")):
            # Ends ascend, so the last one that reports a start is the longest.
            longest[end + 1 - n] = rank
        ids: list[int] = []
        at, token, open_ends = 0, longest[0], bytearray(b"\x01") * (size + 1)
        while True:
            end = at + lengths[token]
            if open_ends[end]:
                fits = not ids or pairs.get(ids[-1] * n_tokens + token)
                if fits is None:
                    fits = self.compatible(ids[-1], token)
                if fits:
                    ids.append(token)
                    if end == size:
                        return ids
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token is None:
                # Nothing that starts here works: never come here again, take one back.
                open_ends[at] = 0
                last = ids.pop()
                at -= lengths[last]
                token = shorter[last]

    def encode(self, text: str, pattern) -> list[int]:
        ids: list[int] = []
        young = self.young
        for piece in pattern.findall(text):
            found = young.get(piece)
            if found is None:
                found = self.old.get(piece) or tuple(self.encode_piece(piece.encode()))
                if len(piece) <= CACHE_LENGTH:
                    if len(young) >= CACHE_PIECES:
                        self.old, self.young = young, {}
                        young = self.young
                    young[piece] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(ranks_file: str) -> Vocabulary:
    with open(ranks_file, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@lru_cache(maxsize=2)
def compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def ranks_path() -> str:
    """The rank table, from the installed package of each machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
ROUND_TRIP = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _rows(docs: DataFrame, kind: pa.Schema, ddl: str, row, ranks_file: str | None, pattern: str | None) -> DataFrame:
    """One row per document of ``row(doc_id, ids, vocabulary)``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = vocabulary(ranks_file or ranks_path()), compiled(pattern or piece_pattern())
        for chunk in chunks(batches, "text", CHUNK_BYTES):
            rows = [
                row(doc_id.as_py(), known.encode(text.as_py() or "", cut), known)
                for doc_id, text in zip(chunk["doc_id"], chunk["text"])
            ]
            columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), kind)]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(encoded, ddl)


def encode(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids of every document."""
    return _rows(
        docs, ENCODED, "doc_id long, ids array<int>", lambda doc_id, ids, known: (doc_id, ids), ranks_file, pattern
    )


def decode(encoded: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id and the bytes that the ids of each row stand for."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks_file or ranks_path())
        for batch in batches:
            found = pa.array([known.decode(ids.as_py() or []) for ids in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(texts, "doc_id long, bytes binary")


def _digests(doc_id, ids, known: Vocabulary) -> tuple:
    listed = ",".join(map(known.names.__getitem__, ids)).encode()
    return doc_id, len(ids), sha256(listed).hexdigest(), sha256(known.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them.

    Encodes and decodes in one pass, so that the ids need not leave the task.
    """
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _rows(docs, ROUND_TRIP, ddl, _digests, ranks_file, pattern)


def op12_byte_bpe(spark, sf_dir) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
