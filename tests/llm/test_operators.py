"""Each operator against a brute-force version, and its defined results for odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import (
    common, components, hmm, license_scan, merge_dropout, nearest, packing, quality_classifier, quality_rules,
    simhash, suffix_dedup, url_filters,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(common.UPPER, common.LOWER)
# Columns that clash with names the operators use themselves.
CLASHES = ["kept", "host", "n_words", "spans", "rule", "score", "quality_score", "n_removed", "fp", "rank", "row", "cut"]
CLASHES += ["_verdict", "_host", "_facts", "_gone", "gone", "_key", "_fp", "_id", "id", "key", "found", "facts", "had_text", "_given_score"]


def docs(spark, texts, clash=True):
    rows = [(i, text, "en", f"src{(i or 0) % 3}" if text != "no source" else None, 0) for i, text in texts]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        given = given.withColumns({name: F.lit("x") for name in CLASHES})
    return given.repartition(3)


def sentences(seed, n, vocabulary=400):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgö", k=draw.randint(1, 8))) for _ in range(vocabulary)]
    return [" ".join(draw.choices(words, k=draw.randint(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, all kinds of blanks."""
    texts = sentences(1, 40)
    long = " ".join(sentences(2, 400))
    rows = list(enumerate(texts)) + [(100 + i, text) for i, text in enumerate(texts[:10])]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, long), (204, long + " end"), (None, texts[3]), (None, None)]
    rows += [(5, texts[5]), (205, "a\x0bb\x0cc\rd é\u2003f"), (206, "no source"), (207, "x" * 3000), (208, "\u2581 \x00 lit")]
    return docs(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [(1, "x")]).limit(0)


# --- quality rules ---------------------------------------------------------------


def facts_of(text):
    text = text or ""
    words = WORDS.findall(text)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for found in places.values() if len(found) > 1 for i in found for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    n, repeats = len(words), len(covered)
    failed = n < 10 or 100 * repeats > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, failed


def test_quality_rules(spark, odd):
    given, rows = odd
    rows = rows + [(300, "a b c d e f g a b c d e"), (301, "q\n\nq\n q\nq"), (302, "a " * 30), (303, "# $ % a|b")]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality_rules.judge(docs(spark, rows)).collect()
    got = Counter((r.doc_id, *(r[name] for name in names)) for r in judged)
    assert got == Counter((i, *facts_of(text)) for i, text in rows)
    assert all(not (r.base_failed and r.kept) for r in judged)
    kept = quality_rules.keep_good(given)
    assert kept.columns == given.columns
    expected = [i for i, text in odd[1] if not facts_of(text)[-1]]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, expected))


def test_bad_hosts_fall_and_small_ones_are_shrunk(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "bad"
    rows = [("evil", bad)] * 195 + [("evil", good)] * 5 + [("fine", good)] * 300 + [("tiny", bad), ("tiny", good)]
    given = spark.createDataFrame([(n, t, s) for n, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    verdicts = {r.host: r for r in quality_rules.judge(given).select("host", "host_verdict", "host_rate").distinct().collect()}
    assert (verdicts["evil"].host_verdict, verdicts["fine"].host_verdict) == ("bad", "good")
    assert verdicts["fine"].host_rate < 0.1
    kept = quality_rules.keep_good(given)
    assert kept.filter("source = 'evil'").count() == 0 and kept.filter("source = 'fine'").count() == 300
    assert kept.filter("source = 'tiny'").count() <= 1


# --- URL filters -----------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "nohost": ("", "", None), "HTTP://A.Net/x": ("a.net", "/x", "net/"),
        "http://net?x": ("net", "", None), "x://www.example.net/en/1#a": ("www.example.net", "/en/1", "example.net/en/"),
        "x://example.net/enx": ("example.net", "/enx", "net/"), "x://fakeexample.com/de/": ("fakeexample.com", "/de/", None),
        "x://m.example.com/de/9": ("m.example.com", "/de/9", "example.com/de/"), "a://b.ORG/fr/?://z": ("b.org", "/fr/", "org/fr/"),
        "a://b.org/FR/": ("b.org", "/FR/", None), "x://É.net/": ("É.net", "/", "net/"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("verdict", F.lit("x"))
    got = {r.url: (r.host, r.path, r.rule) for r in url_filters.filter_urls(pages).collect()}
    assert got == cases
    verdicts = {r.rule: r.verdict for r in url_filters.filter_urls(pages).filter("rule IS NOT NULL").collect()}
    assert verdicts == {f"{host}{path}": verdict for host, path, verdict in url_filters.RULES}
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_trees_learn_lexical_labels(spark):
    draw = random.Random(5)
    rows = []
    for n in range(1200):
        bad = n % 2
        host = "".join(draw.choices("0123456789x-" if bad else "abcdefgh", k=draw.randint(5, 12))) + ".com"
        rows.append((n, f"http://{host}/{'a/' * draw.randint(0, 3)}{'?q=1&r=2' if bad else ''}", bad))
    given = spark.createDataFrame(rows, "page_id long, url string, label int")
    train, test = given.filter("page_id % 3 > 0"), given.filter("page_id % 3 = 0")
    scored = url_filters.filter_urls(test.select("page_id", "url"), train.select("url", "label")).join(given.select("page_id", "label"), "page_id")
    right = scored.filter((F.col("score") >= 0.5) == (F.col("label") == 1)).count()
    assert right >= 0.95 * test.count()
    # A URL that fills most rows is one example, whatever its hash.
    hot = train.select("url", "label").unionByName(
        spark.range(30_000).select(F.lit("http://hot.example.com/a").alias("url"), F.lit(1).alias("label"))
    )
    scored = url_filters.filter_urls(test.select("page_id", "url"), hot).join(given.select("page_id", "label"), "page_id")
    assert scored.filter((F.col("score") >= 0.5) == (F.col("label") == 1)).count() >= 0.9 * test.count()
    one_class = url_filters.filter_urls(test.select("page_id", "url"), train.filter("label = 1").select("url", "label"))
    assert {r.score for r in one_class.collect()} == {1.0}


def features_of(url):
    """The lexical features of a URL, one character at a time."""

    def entropy(text):
        return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())

    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0].translate(LOWER)
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    query = re.search(r"\?([^#]*)", url)
    digits = [sum(c in "0123456789" for c in part) / max(1, len(part)) for part in (url, host)]
    params = query[1].count("&") + 1 if query and query[1] else 0
    return [
        len(url), len(host), len(path), host.count("."), path.count("/"), *digits, entropy(url), entropy(host), params,
        url.count("-") + url.count("_"), int("#" in url), int(url.startswith("https")),
    ]


def test_features_equal_a_plain_count(spark):
    draw = random.Random(6)
    urls = ["", "none", "a://", "http://x.org?", "HTTPS://A-b.com/c_d/?q=1&r=2&&#f?g"]
    urls += ["https://" + "".join(draw.choices("ab1-_./?&#=é", k=draw.randint(0, 40))) for _ in range(80)]
    given = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns(
        {"host": url_filters.host_of(F.col("url")), "path": url_filters.path_of(F.col("url"))}
    )
    none = spark.createDataFrame([], "_suffix string, _rate double, _seen double")
    names = [name for name in url_filters.FEATURES if "suffix" not in name]
    for row in url_filters.with_features(given, none, 0.5).collect():
        assert [row[name] for name in names] == pytest.approx(features_of(row.url)), row.url


# --- packing ---------------------------------------------------------------------


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    given, rows = odd
    rows = rows + [(400, "<|endoftext|> a's  \n\n b \u3000 1234 é\U0001f642"), (401, "word " * 2500)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            expected[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    packed = packing.pack_documents(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1 + 1.05 * sum(r.length for r in packed) / 1024
    assert packing.pack_documents(empty).count() == 0


def test_packing_reads_special_tokens_like_the_tokenizer_as_loaded(spark, tmp_path):
    from tokenizers import Tokenizer
    import corpus_pipeline
    import public_tokenizers

    rows = list(enumerate(["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\n y <|endoftext", "plain  "]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = set()
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        expected.add((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for packed in (
        packing.op4_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs(spark, rows), ""),
    ):
        assert {(r.doc_id, r.length, r.ids_crc32) for r in packed.collect()} == expected


@pytest.mark.parametrize("open_bins", [3, 1000])
def test_best_fit_equals_a_plain_search(open_bins):
    draw = random.Random(4)
    lengths = [draw.randint(1, 64) for _ in range(800)]
    bins, offsets = packing.best_fit(lengths, 64, open_bins)
    opened, free = [], {}
    for size, got, offset in zip(lengths, bins, offsets):
        fitting = [b for b in opened if free[b] >= size]
        if fitting:
            best = min(free[b] for b in fitting)
            assert free[got] == best and got in opened
        else:
            if len(opened) >= open_bins:
                # The closed one is among the fullest; which of equals does not matter.
                full = min(free[b] for b in opened)
                opened.remove(next(b for b in reversed(opened) if free[b] == full))
            free[got] = 64
            opened.append(got)
        assert offset == 64 - free[got]
        free[got] -= size
        if free[got] == 0:
            opened.remove(got)
        else:
            opened.remove(got)
            opened.append(got)


# --- near duplicates -------------------------------------------------------------


def fingerprint_of(text):
    import xxhash

    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, budget=4):
    """(id, print) pairs -> smallest id reachable, by comparing all pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[n + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_fingerprints_and_components(spark, odd, empty):
    given, rows = odd
    near = " ".join(sentences(8, 5))
    rows = rows + [(500 + i, near + f" tail{i}") for i in range(30)]
    found = simhash.near_components(docs(spark, rows)).collect()
    prints = {(i, text): fingerprint_of(text) for i, text in rows}
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in found) == Counter(
        (i, prints[i, text]) for i, text in rows
    )
    component = groups_of(sorted({(i, p) for (i, _), p in prints.items() if i is not None}))
    assert all(r.component_id == component[r.doc_id] for r in found if r.doc_id is not None)
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in component if component[i] == i} | {None}
    assert simhash.near_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_trie_join_equals_all_pairs():
    draw = random.Random(6)
    centers = [draw.getrandbits(64) for _ in range(20)]
    prints = set()
    for center in centers:
        for _ in range(30):
            flipped = center
            for bit in draw.sample(range(64), draw.randint(0, 6)):
                flipped ^= 1 << bit
            prints.add(flipped)
    prints = np.array(sorted(prints), np.uint64)
    root = simhash.trie_links(np.zeros(len(prints), np.int64), prints, 4)
    expected = groups_of([(i, int(p)) for i, p in enumerate(prints)])
    assert root.tolist() == [expected[i] for i in range(len(prints))]


def test_links_find_every_pair_through_the_blocks(spark):
    draw = random.Random(9)
    prints = {draw.getrandbits(64) for _ in range(60)}
    prints |= {p ^ sum(1 << b for b in draw.sample(range(64), 4)) for p in list(prints)[:40]}
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    found = {r.node: r.component for r in components.components(simhash.links(classes)).collect()}
    expected = groups_of([(i, p) for i, p in enumerate(sorted(prints))])
    assert {i: found.get(i, i) for i in expected} == expected


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (500, 501), (501, 500)]
    given = spark.createDataFrame(edges, "u long, v long")
    found = {r.node: r.component for r in components.components(given).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 200)} | {501: 500}
    assert components.components(given.limit(0)).count() == 0


# --- suffix dedup ----------------------------------------------------------------


def cut_of(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256), rows without an id apart."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            key = data[i : i + 50]
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if doc is not None:
            for i in range(len(data) - 49):
                if first[data[i : i + 50]] < doc:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeats(seed):
    draw = random.Random(seed)
    rows = [(i, "".join(draw.choices("ab", k=draw.choice([10, 60, 400])))) for i in range(25)]
    base = "abcdefghij" * 20
    for i in range(25, 45):
        rows.append((i, base[draw.randrange(50) : draw.randrange(60, 200)] + "é" * draw.randrange(30) + base[: draw.randrange(200)]))
    line = "this line is very common and stands in a third of all documents, with other text around it. "
    for i in range(45, 120):
        rows.append((i, "".join(draw.choices("abcdefgh ", k=80)) + line + "".join(draw.choices("abcdefgh ", k=80))))
    return rows


@pytest.mark.parametrize("hot_runs", [100, 4])
def test_cut_repeats(spark, odd, empty, monkeypatch, hot_runs):
    """Also with the anchors of the common line split string by string."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot_runs)
    rows = repeats(1) + [(i + 1000 if i is not None else None, text) for i, text in odd[1]]
    given = docs(spark, rows)
    found = suffix_dedup.cut_repeats(given).withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in found) == cut_of(rows)
    texts = suffix_dedup.dedup_texts(given)
    assert texts.columns == given.columns
    lengths = {(r.doc_id, r.n_chars) for r in texts.filter("doc_id < 45").collect()}
    assert any(n for _, n in lengths)
    assert suffix_dedup.cut_repeats(empty).count() == 0 and suffix_dedup.dedup_texts(empty).count() == 0


def test_sorted_suffixes_and_collisions(monkeypatch):
    draw = random.Random(2)
    data = np.array([draw.randrange(2) for _ in range(900)], np.uint8)
    start = np.array(sorted(draw.sample(range(850), 300)))
    end = start + np.array([draw.randint(1, 50) for _ in start])
    group = np.sort(np.array([draw.randrange(7) for _ in start]))
    order, common = suffix_dedup.sort_suffixes(data, start, end, group)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(start, end)]
    expected = sorted(range(len(texts)), key=lambda i: (group[i], texts[i], i))
    assert [texts[i] for i in order] == [texts[i] for i in expected]
    # A hash that always collides is noticed, and the order is right all the same.
    monkeypatch.setattr(suffix_dedup._Hashed, "_hash", lambda self, a, n: np.zeros(len(a), np.uint64))
    again, common_again = suffix_dedup.sort_suffixes(data, start, end, group)
    assert [texts[i] for i in again] == [texts[i] for i in expected]
    assert common_again.tolist() == common.tolist()


# --- nearest vectors -------------------------------------------------------------


def test_nearest_vectors(spark):
    draw = np.random.default_rng(3)
    vectors = np.concatenate([draw.normal(c, 1.0, (300, 16)) for c in range(4)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[7].tolist(), 0) for i in range(400)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [None] + [1.0] * 15, 0)]
    rows += [(None, vectors[1].tolist(), 0), (5100, [1.0, 2.0], 0), (5200, [3.0, 4.0], 0)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = nearest.nearest(given, F.col("vec_id") % 50 == 0)
    usable = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for query in [i for i in usable if i % 50 == 0]:
        others = [(math.sqrt(((v - usable[query]) ** 2).sum()), i) for i, v in usable.items() if i != query and len(v) == len(usable[query])]
        best = sorted(others)[:10]
        assert sorted(got[query]) == list(range(1, len(best) + 1))
        hits += len({i for _, i in best} & {i for i, _ in got[query].values()})
        total += len(best)
        for vec_id, score in got[query].values():
            assert score == pytest.approx(math.sqrt(((usable[vec_id] - usable[query]) ** 2).sum()), rel=1e-12)
    assert hits >= 0.95 * total
    assert [i for i, _ in (got[5100][r] for r in sorted(got[5100]))] == [5200]
    # Copies of one vector: the smallest ids win.
    assert [got[2000][r][0] for r in range(1, 11)] == [7, *range(2001, 2010)]
    assert nearest.nearest(given.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- language model --------------------------------------------------------------


def test_hmm_scores(spark, odd, empty):
    rows = odd[1]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else False for i, _ in rows]
    given = docs(spark, rows).withColumn("held_out", F.coalesce(common.id_remainder(F.col("doc_id"), 10) == 0, F.lit(False)))
    model, rare, total = hmm.fit(given.filter("NOT held_out"), shares=3)
    tokens = [[*WORDS.findall((text or "").translate(LOWER)), None] for _, text in rows]
    counts = Counter()
    for found, out in zip(tokens, held):
        counts.update([] if out else found)
    n, v = sum(counts.values()), len(counts)
    assert total == n
    expected = Counter(
        (i, out, len(found), sum(counts[t] > 0 for t in found),
         round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found), 6))
        for (i, _), found, out in zip(rows, tokens, held)
    )
    scored = hmm.score(given.select("doc_id", "held_out", "text"), model, rare).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scored) == expected
    assert all(r.score < 0 for r in scored)
    nothing = empty.select("doc_id", F.lit(True).alias("held_out"), "text")
    assert hmm.score(nothing, model, rare).count() == 0
    model, rare, total = hmm.fit(empty)
    assert total == 0
    lone = hmm.score(docs(spark, [(1, None)], False).select("doc_id", F.lit(True).alias("held_out"), "text"), model, rare).first()
    assert (lone.n_tokens, lone.n_known, lone.base_score) == (1, 0, pytest.approx(0.0))


def test_most_frequent_tokens(spark):
    draw = random.Random(5)
    rows = [(f"t{n}", draw.choice([1, 1, 1, 2, 3, 50, 51, 900])) for n in range(500)]
    counts = spark.createDataFrame(rows, "token string, c long").repartition(6)
    for limit in (1, 60, 130, 499, 900):
        got = [(r.token, r.c) for r in hmm._most_frequent(counts, limit).collect()]
        assert got == sorted(rows, key=lambda r: (-r[1], r[0]))[:limit]


def toy_model(states, k, seed):
    draw = np.random.default_rng(seed)
    start, move, emit = (draw.random(s) for s in (states, (states, states), (states, k)))
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model({}, np.zeros(1), np.zeros(1), 0.0, norm(start), norm(move), norm(emit))


def test_forward_and_counts_equal_sums_over_paths():
    from itertools import product

    model = toy_model(3, 5, 1)
    draw = random.Random(1)
    texts = [np.array([draw.randrange(5) for _ in range(n)], np.int32) for n in (1, 4, 6, 6, 2)]
    total = np.zeros((3, 1 + 3 + 5))
    for text, log in zip(texts, hmm.forward(model, texts)):
        likelihood, counts = 0.0, np.zeros_like(total)
        for path in product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[path[0], text[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], text[t]]
            likelihood += p
            counts[path[0], 0] += p
            for t, s in enumerate(path):
                counts[s, 4 + text[t]] += p
                if t:
                    counts[path[t - 1], 1 + s] += p
        assert log == pytest.approx(math.log10(likelihood), rel=1e-9)
        total += counts / likelihood
    assert np.allclose(hmm.expected_counts(model, texts), total, atol=1e-4)


def test_the_model_is_a_distribution_over_tokens():
    """Next-token probabilities over all classes add up to one, and rare ones within a class too."""
    model = toy_model(4, 7, 2)
    one = [10 ** hmm.forward(model, [np.array([c], np.int32)])[0] for c in range(7)]
    assert sum(one) == pytest.approx(1.0)


# --- merge dropout ---------------------------------------------------------------


def test_merges_equal_the_model_and_come_back(spark, odd, empty):
    import sentencepiece

    given, rows = odd
    path = merge_dropout.model_path()
    model, reference = merge_dropout.merges(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [text for _, text in rows] + ["  two  spaces ", "日本語 🙂 ñ\n\n\tq", " " * 90, "aaaa" * 30 + "é" * 70, "hello hello hello hello"]
    plain = model.encode(texts, [0] * len(texts), rate=0.0)
    for text, ids in zip(texts, plain):
        if text is not None and "\u2581" not in text:
            assert ids.tolist() == reference.encode(text), text
    for rate in (0.1, 0.6, 1.0):
        varied = model.encode(texts, list(range(len(texts))), rate=rate)
        assert [model.decode(ids) for ids in varied] == [text or "" for text in texts]
        assert sum(map(len, varied)) > sum(map(len, plain))
    again = model.encode(texts, list(range(len(texts))), rate=0.6, seed=1)
    twice = model.encode(texts, list(range(len(texts))), rate=0.6, seed=1)
    assert all((a == b).all() for a, b in zip(again, twice))
    assert any(a.tolist() != b.tolist() for a, b in zip(again, model.encode(texts, list(range(len(texts))), 0.6, seed=2)))
    encoded = merge_dropout.encode_documents(given)
    assert encoded.filter("NOT lossless").count() == 0 and encoded.count() == len(rows)
    decoded = merge_dropout.decode_ids(encoded)
    assert Counter((r.doc_id, r.text) for r in decoded.collect()) == Counter((i, text or "") for i, text in rows)
    assert merge_dropout.encode_documents(empty).count() == 0


def test_both_agendas_agree():
    model = merge_dropout.merges(merge_dropout.model_path())
    words = [word for text in sentences(3, 40) for word in re.findall(r" *[^ ]+", " " + text)] + [" 日本é\n", " aaaaaaaaaaaa"]
    keys = merge_dropout.Merges._keys(words, [n % 4 for n in range(len(words))], 42)
    for word, key, ids in zip(words, keys, model.encode_words(words, keys, 0.3)):
        assert model._encode_long(word, int(key), 0.3).tolist() == ids.tolist()


def test_every_occurrence_of_a_word_draws_its_own_merges():
    model = merge_dropout.merges(merge_dropout.model_path())
    word = " international"
    plain = tuple(model.encode_words([word], np.zeros(1, np.uint64), 0.0)[0].tolist())
    texts, keys = [word[1:]] * 3000, list(range(3000))
    seen = Counter(tuple(ids.tolist()) for ids in model.encode(texts, keys, rate=0.1))
    drawn = np.random.default_rng(1).integers(0, 1 << 63, 3000, np.uint64)
    expected = sum(tuple(model._encode_long(word, int(key), 0.1).tolist()) != plain for key in drawn)
    assert len(seen) > 4 and abs(3000 - seen[plain] - expected) < 200
    repeated = model.encode([" ".join(texts)], [7], rate=0.1)[0]
    assert model.decode(repeated) == " ".join(texts)
    places = [" " + text for text in texts]
    first = np.uint64(merge_dropout._mix((merge_dropout._mix(7) + merge_dropout.SEED) & ((1 << 64) - 1)))
    own = merge_dropout._mix(first + np.arange(3000, dtype=np.uint64))
    assert repeated.tolist() == [x for place, key in zip(places, own) for x in model._encode_long(place, int(key), 0.1)]


# --- quality classifier ----------------------------------------------------------


def test_classifier(spark, odd, empty):
    good = sentences(11, 150)
    shout = [" ".join(w.upper() + "!!" for w in text.split()) for text in sentences(12, 150)]
    rows = [(i, text) for i, text in enumerate(good)] + [(1000 + i, text) for i, text in enumerate(shout)]
    labels = spark.createDataFrame(
        [(i, int(i < 1000), 0) for i, _ in rows] + [(None, 1, 0), (1, None, 0), (2, 7, 0), (99999, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    given = docs(spark, rows)
    model = quality_classifier.train(given, labels)
    trained = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
    assert len(model.labels) == trained
    held = quality_classifier.score(given, model).filter(common.id_remainder(F.col("doc_id"), 4) == 2).collect()
    right = sum((r.quality_score >= 0.7) == (r.doc_id < 1000) for r in held)
    assert right >= 0.97 * len(held)
    kept = quality_classifier.keep_good(given, labels)
    assert kept.columns == given.columns and kept.select("quality_score").distinct().collect()[0][0] == "x"
    scores = [r.quality_score for r in quality_classifier.score(odd[0], model).collect()]
    assert len(scores) == len(odd[1]) and all(0 <= s <= 1 for s in scores)
    assert quality_classifier.score(empty, model).count() == 0
    untrained = quality_classifier.train(given, labels.limit(0))
    assert {r.quality_score for r in quality_classifier.score(given, untrained).collect()} == {0.5}


def test_scores_equal_a_plain_vote():
    texts = sentences(21, 60)
    counts = [quality_classifier.terms(t) for t in texts]
    labels = np.array([n % 2 for n in range(60)])
    model = quality_classifier.Neighbours(counts, labels)
    latent = model._latent(counts)
    for vector, score in zip(latent, model.scores(counts)):
        cosines = np.clip(model.vectors @ vector, 0, 1).astype(np.float64)
        nearest_ones = np.argsort(-cosines, kind="stable")[: quality_classifier.NEIGHBOURS]
        weight = cosines[nearest_ones] ** 8
        expected = ((weight * labels[nearest_ones]).sum() + 0.01 * model.prior) / (weight.sum() + 0.01)
        assert score == pytest.approx(expected, abs=1e-3)


def test_topics_of_equal_layout(spark):
    """Labels that depend on the wording alone: the same sentence frames, other words."""
    draw = random.Random(31)
    frames = ["the {} of the {} was {} by a {}.", "Every {} and each {} had {} in the {}.", "A {} is {}, but no {} can {}."]
    lists = [["".join(draw.choices("abcdefgh", k=6)) for _ in range(120)] for _ in range(2)]
    rows = []
    for n in range(600):
        used = lists[n % 2]
        rows.append((n, " ".join(draw.choice(frames).format(*draw.choices(used, k=4)) for _ in range(6))))
    labels = spark.createDataFrame([(n, n % 2) for n, _ in rows], "doc_id long, quality int")
    given = docs(spark, rows)
    scored = quality_classifier.score(given, quality_classifier.train(given, labels))
    held = scored.filter(common.id_remainder(F.col("doc_id"), 4) == 2).collect()
    assert sum((r.quality_score >= 0.5) == (r.doc_id % 2) for r in held) >= 0.95 * len(held)


def test_latent_axes_equal_a_full_decomposition():
    rows = [quality_classifier.terms(t) for t in sentences(5, 30, 60)]
    dense = np.zeros((30, quality_classifier.TERMS + quality_classifier.WORD_TERMS))
    for row, (slots, values) in zip(dense, rows):
        row[slots] = values
    axes = quality_classifier.latent_axes(rows, 8, rounds=6)
    full = np.linalg.svd(dense, full_matrices=False)[2][:8]
    assert np.allclose(np.abs(np.sum(axes.T * full, axis=1))[:4], 1, atol=1e-2)
    assert np.linalg.norm(dense @ axes) == pytest.approx(np.linalg.norm(dense @ full.T), rel=1e-3)


def test_pieces_and_blocks_lose_no_string(monkeypatch):
    """Long texts are cut into pieces, and pieces gathered into blocks: every string is in one run."""
    texts = [(n, " ".join(sentences(40 + n, 3)).encode()) for n in range(4)] + [(9, b"short"), (10, b"x" * 400)]
    expected = Counter((d, p, t[p : p + 50]) for d, t in texts for p in range(len(t) - 49))
    for piece, block in ((16 << 20, 1 << 20), (64, 150), (51, 1)):
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
        found = Counter()
        for ids, places, _, _, cut in suffix_dedup.runs(texts, np.zeros(0, np.uint64)):
            for doc, place, run in zip(ids.tolist(), places.tolist(), cut):
                found.update((doc, place + i, run[i : i + 50]) for i in range(len(run) - 49))
        assert found == expected


# --- license scan ----------------------------------------------------------------


def scan_of(text):
    """License -> best share of a template's shingles in any window of its width and step."""
    tokens = re.findall(r"[a-z0-9]+", (text or "").translate(LOWER))
    grams = [tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
    best = {}
    for name, statement in license_scan.TEMPLATES:
        wanted = re.findall(r"[a-z0-9]+", statement.lower())
        wanted = {tuple(wanted[i : i + 3]) for i in range(len(wanted) - 2)}
        step = max(1, len(wanted) // 4)
        for at in range(0, len(grams), step):
            share = len(wanted & set(grams[at : at + len(wanted) + step])) / len(wanted)
            if share >= 0.8:
                best[name] = max(best.get(name, 0), share)
    return best


def test_license_scan(spark, odd, empty):
    rows = list(odd[1])
    for n, (_, statement) in enumerate(license_scan.TEMPLATES):
        words = statement.split()
        rows.append((600 + n, f"some text before {statement.upper()} and after"))
        rows.append((700 + n, " ".join(words[: len(words) // 2])))
        rows.append((800 + n, " ".join(words[:-1])))
    found = {}
    for r in license_scan.scan(docs(spark, rows)).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.containment
    assert found == {i: scan_of(text) for i, text in rows if scan_of(text)}
    assert len(found) >= len(license_scan.TEMPLATES)
    assert license_scan.scan(empty).count() == 0
