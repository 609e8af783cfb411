"""Periodic runs, byte-level BPE and centroid clusters against brute-force versions."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import byte_bpe, centroids, periodic_runs
from test_operators import WORDS, docs, empty, odd, sentences  # noqa: F401 - fixtures

# --- periodic runs ---------------------------------------------------------------


def runs_by_lag(words):
    """Every lag on its own; a stretch that a smaller period explains is left out."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            smaller = any(all(words[x] == words[x - p] for x in range(start + p, i)) for p in range(1, q))
            if i - start >= max(6, 4 * q) and not smaller:
                found.append((start, i - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_of(doc_id, text):
    words = planted(doc_id, WORDS.findall(text or ""))
    runs = runs_by_lag(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(word for i, word in enumerate(words) if i not in dropped)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def periodic_words(draw):
    """A text over a small alphabet with stretches of several periods laid over each other."""
    words = [c for c in draw.choices(draw.choice(["a", "ab", "abc", "abcdefgh"]), k=draw.randint(0, 120))]
    for _ in range(draw.randint(0, 3)):
        if words:
            a, p, m = draw.randrange(len(words)), draw.randint(1, 25), draw.randint(1, len(words))
            for i in range(a + p, min(len(words), a + m)):
                words[i] = words[i - p]
    return words


def test_runs_equal_those_of_every_lag():
    draw = random.Random(11)
    for _ in range(400):
        texts = [periodic_words(draw) for _ in range(3)]
        found = periodic_runs.runs_of([[w.encode() for w in words] for words in texts])
        assert [found.get(n, []) for n in range(3)] == [runs_by_lag(words) for words in texts]


def test_one_word_a_million_times():
    for unit, period in (([b"a"], 1), ([b"a", b"b", b"a", b"c"], 4)):
        words = unit * (400_000 // len(unit))
        assert periodic_runs.runs_of([words]) == {0: [(0, len(words), period)]}
        assert periodic_runs.collapsed(words, [(0, len(words), period)]) == unit


@pytest.mark.parametrize("chunk", [2 << 20, 300])
def test_run_digests(spark, odd, empty, monkeypatch, chunk):  # noqa: F811
    """Also with chunks so small that every text is one of its own."""
    monkeypatch.setattr(periodic_runs, "CHUNK_BYTES", chunk)
    draw, (_, rows) = random.Random(7), odd
    rows = [row for row in rows if len(row[1] or "") < 5000] + [(n, " ".join(periodic_words(draw))) for n in range(400, 520)]
    got = Counter(map(tuple, periodic_runs.run_digests(docs(spark, rows), planted=True).collect()))
    assert got == Counter(digest_of(*row) for row in rows)
    assert sum(row[1] > 0 for row in got) > 20
    assert periodic_runs.run_digests(empty, planted=True).count() == 0


def test_detected_runs_and_what_is_left(spark):
    text = "x " + "so it goes " * 5 + "and again and again and again and again y"
    row = periodic_runs.detect_runs(docs(spark, [(1, text), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(run) for run in row[0].runs] == [(1, 15, 3), (16, 8, 2)]
    assert row[0].collapsed_text == "x so it goes and again y"
    assert (row[1].runs, row[1].collapsed_text) == ([], "")


# --- byte-level BPE --------------------------------------------------------------


@pytest.fixture(scope="module")
def encodings():
    import public_tokenizers
    import tiktoken

    known = byte_bpe.vocabulary(byte_bpe.ranks_path())
    theirs = tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={}
    )
    return known, theirs


def test_pieces_are_merged_exactly(encodings):
    known, theirs = encodings
    draw, tokens = random.Random(3), list(known.ranks)
    for n in range(6000):
        if n % 3:
            piece = b"".join(draw.choices(tokens, k=draw.randint(1, 6)))
        else:
            piece = bytes(draw.choices(b"aabnestin gr\xc3\xa9\xe0\xa4\xff", k=draw.randint(1, 40)))
        ids = known.encode_piece(piece)
        assert ids == theirs._encode_single_piece(piece), piece
        assert known.decode(ids) == piece


def test_long_pieces_in_linear_time(encodings):
    known, theirs = encodings
    draw = random.Random(4)
    for piece in (b"a" * 100_000, b"ab" * 50_000, bytes(draw.choices(b"etaoinshr", k=100_000))):
        assert known.encode_piece(piece) == theirs._encode_single_piece(piece)


def test_full_caches_change_nothing(encodings, monkeypatch):
    known, theirs = encodings
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "CACHE_PAIRS", 3)
    cut = byte_bpe.compiled(byte_bpe.piece_pattern())
    for text in sentences(6, 60):
        assert known.encode(text, cut) == theirs.encode_ordinary(text)
    assert len(known.young) <= 5 and len(known.pairs) <= 3


def test_round_trip(spark, odd, empty, encodings):  # noqa: F811
    given, rows = odd
    rows = rows + [(500, "don't  stop\n\n\t you'll <|endoftext|> ½ 12345 ①"), (501, "İ\U0001f600​ नमस्ते " * 20)]
    got = Counter(map(tuple, byte_bpe.round_trip(docs(spark, rows)).collect()))
    expected = Counter()
    for doc_id, text in rows:
        ids = encodings[1].encode_ordinary(text or "")
        listed = ",".join(map(str, ids)).encode()
        expected[doc_id, len(ids), sha256(listed).hexdigest(), sha256((text or "").encode()).hexdigest()] += 1
    assert got == expected
    assert byte_bpe.round_trip(empty).count() == 0
    decoded = byte_bpe.decode(byte_bpe.encode(docs(spark, rows)))
    assert Counter((r.doc_id, bytes(r.bytes)) for r in decoded.collect()) == Counter(
        (doc_id, (text or "").encode()) for doc_id, text in rows
    )


# --- centroid clusters -----------------------------------------------------------


def clusters_of(rows, k=40, rounds=5):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x):
            kept.append((vec_id, np.floor(256 * np.array(x, np.float64)).astype(int).tolist()))
    first = sorted((row for row in kept if row[0] is not None), key=lambda r: (sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(x) for _, x in first[:k]]

    def assigned():
        for vec_id, x in kept:
            distances = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centers]
            best = min(range(len(centers)), key=lambda n: (distances[n], n))
            yield vec_id, x, best, distances[best]

    for _ in range(rounds):
        members = {}
        for _, x, best, _ in assigned():
            members.setdefault(best, []).append(x)
        for n, xs in members.items():
            centers[n] = [sum(column) // len(xs) for column in zip(*xs)]
    final = list(assigned())
    inertia = Counter()
    for _, _, best, distance in final:
        inertia[best] += distance
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), digests[n]) for i, _, n, d in final)


def vectors(n, seed):
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((12, 64))
    return [(i, (middles[i % 12] + 0.2 * draw.standard_normal(64)).astype(np.float32).astype(float).tolist()) for i in range(n)]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))


@pytest.mark.parametrize("block", [512, 7])
def test_clusters(spark, monkeypatch, block):
    """Hot vectors, repeated and null ids, large components, and rows that take no part."""
    monkeypatch.setattr(centroids, "BLOCK_ROWS", block)
    monkeypatch.setattr(centroids.blocks, "__defaults__", (block,))
    rows = vectors(150, 1)
    hot = [(1000 + i, rows[0][1]) for i in range(90)]
    odd_rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [None] + [1.0] * 63), (5, [float("nan")] * 64), (6, [float("inf")] * 64)]
    odd_rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (None, [0.0] * 64), (8, [30000.0] * 64), (9, [-30000.5] * 64)]
    rows = rows + hot + odd_rows
    got = Counter(map(tuple, centroids.cluster(embeddings(spark, rows).repartition(3)).collect()))
    assert got == clusters_of(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(9, 2)
    given = embeddings(spark, rows)
    assert Counter(map(tuple, centroids.cluster(given).collect())) == clusters_of(rows)
    assert centroids.cluster(given.limit(0)).count() == 0
    assert centroids.cluster(given.filter("vec_id < 0")).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    ]
    beyond = embeddings(spark, [(1, [1e30] * 64), (2, [0.5] * 64)])
    assert [row.vec_id for row in centroids.cluster(beyond).collect()] == [2]


def test_boxes_keep_the_nearest(spark):
    """No vector of a block has its nearest centroid outside the block's candidates."""
    draw = np.random.default_rng(3)
    for _ in range(200):
        centers = draw.integers(-50, 50, (20, 8))
        data = draw.integers(-50, 50, 8) + draw.integers(0, int(draw.integers(1, 40)), (30, 8))
        chosen = centroids.candidates(data.min(axis=0), data.max(axis=0), centers)
        every = ((data[:, None, :] - centers) ** 2).sum(axis=2)
        assert set(every.argmin(axis=1)) <= set(chosen.tolist())
        found, distance = centroids.nearest(data, centers)
        assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_places_follow_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
    places = centroids.hilbert(cells, bits)
    assert sorted(places.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
