"""The pipeline: registration, columns, and what each stage does with planted cases."""

import random

import numpy as np

import corpus_pipeline
from checks.compare import differences, duck
from dossier.llm import near_copies, registry
from dossier.session import materialise

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__

    names = [f"op{n}_" for n in range(1, 14)]
    queries = __spark_entry__.queries()
    assert all(any(query.startswith(name) for query in queries) for name in names)
    assert "pipeline" in queries and set(registry.ORACLE_SQL) <= set(queries)


def test_twins(spark):
    connection = duck(SF_DIR)
    for name, sql in registry.ORACLE_SQL.items():
        result = registry.QUERIES[name](spark, SF_DIR).toPandas()
        assert len(result) and differences(result, connection.sql(sql).df()) is None, name


def planted(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(draw.choices(words, k=n))

    base, passage = prose(300), prose(60)
    rows = [(i, prose(120)) for i in range(40)]
    rows += [(100, base), (101, base), (102, base + " tail")]
    rows += [(200, f"{prose(80)} {passage} {prose(80)}"), (201, f"{prose(80)} {passage} {prose(80)}")]
    rows += [(300, "too short"), (301, "again " * 60)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(40)]
    docs = spark.createDataFrame(
        [(i, text, "en", f"src{i % 4}", len(text)) for i, text in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    labels = spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels, dict(rows), passage


def test_stages(spark, tmp_path):
    docs, labels, texts, passage = planted(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "simhash", "suffix_dedup", "packing"]
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        ids[name] = {row.doc_id for row in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "suffix_dedup":
            after = {row.doc_id: row for row in docs.collect()}
    clean = set(range(40)) | {100, 200, 201}
    assert {300, 301}.isdisjoint(ids["quality_rules"]) and ids["quality_rules"] >= clean
    assert ids["quality_classifier"] >= clean
    assert len(ids["quality_classifier"] & set(range(400, 440))) <= 2
    assert ids["simhash"] >= clean and {101, 102}.isdisjoint(ids["simhash"])
    assert passage in after[200].text and passage not in after[201].text
    assert after[201].n_chars == len(after[201].text) and after[200].text == texts[200]
    assert ids["packing"] == ids["suffix_dedup"] == ids["simhash"]


def test_stages_on_nothing(spark, tmp_path):
    docs, labels, _, _ = planted(spark)
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def jaccard(one, other):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (one.split(), other.split()))
    return len(a & b) / len(a | b)


def copy_of(draw, text, least):
    """The text with words replaced while the similarity stays at ``least`` or above."""
    made = text.split()
    for place in draw.sample(range(len(made)), len(made)):
        tried = [*made[:place], "z" + made[place] + "z", *made[place + 1 :]]
        if jaccard(text, " ".join(tried)) < least:
            break
        made = tried
    return " ".join(made)


def test_near_copies_of_every_similarity_go(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(900)]
    rows, copies, others = [], set(), set()
    for n in range(240):
        text = " ".join(draw.choices(words, k=draw.choice([150, 400])))
        least = (0.80, 0.85, 0.90, 0.70)[n % 4]
        near = copy_of(draw, text, least)
        assert least <= jaccard(text, near) < least + 0.1
        rows += [(2 * n, text), (2 * n + 1, near)]
        (copies if jaccard(text, near) >= 0.8 else others).add(2 * n + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {row.doc_id for row in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()}
    assert len(copies) >= 180
    assert kept == {i for i, _ in rows} - copies


def test_near_copies_of_odd_rows(spark):
    rows = [(1, "one two"), (2, "ONE  two"), (3, "one three"), (4, ""), (5, None), (6, " "), (None, "one two"), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} == {1, 4, None}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF_DIR).count() == 0


def test_near_copies_of_a_large_group(spark):
    draw = random.Random(12)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(900)]
    base = " ".join(draw.choices(words, k=200))
    texts = [copy_of(draw, base, 0.9) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate([base, *texts])), "doc_id long, text string")
    assert [row.doc_id for row in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()] == [0]


def test_near_copies_are_found_by_fingerprints_of_bits(spark, monkeypatch):
    """SimHash is what retrieves: fingerprints that are as far apart as can be link nothing."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(900)]
    text = " ".join(draw.choices(words, k=300))
    one, other = (near_copies.prints(near_copies.shingles(x)) for x in (text, copy_of(draw, text, 0.8)))
    far = near_copies.prints(near_copies.shingles(" ".join(draw.choices(words, k=300))))
    apart = [int(np.bitwise_count(one ^ x).sum()) / near_copies.BITS for x in (other, far)]
    assert 0.10 < apart[0] < 0.20 and 0.42 < apart[1] < 0.58
    # By hand: a bit is set if it is in over half of the hashes.
    found = near_copies.shingles("a b c d e f g")
    single = [near_copies.prints(found[i : i + 1]) for i in range(3)]
    voted = (single[0] & single[1]) | (single[0] & single[2]) | (single[1] & single[2])
    assert len(found) == 3 and (near_copies.prints(found) == voted).all()


def test_large_groups_are_as_brute_force_has_them(spark):
    """Varied copies of one text: of a group of any size every pair of candidates counts."""
    draw = random.Random(21)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(900)]
    base = " ".join(draw.choices(words, k=300))
    texts = [copy_of(draw, base, draw.choice([0.76, 0.87])) for _ in range(160)]
    sets = [set(near_copies.shingles(x).tolist()) for x in texts]
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and first[i] != first[j]:
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {row.doc_id for row in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()}
    assert kept == set(first) and len(kept) > 20


def test_texts_that_are_alike_do_not_cost_their_square(spark, monkeypatch):
    """Of a group whose pairs are nearly all below 0.8, few pairs of sets are compared, and none is lost."""
    draw = random.Random(31)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(900)]
    base = " ".join(draw.choices(words, k=200))
    texts = [copy_of(draw, base, 0.8 if i < 30 else 0.72) for i in range(330)]
    compared, write = [], near_copies.materialise

    def counted(rows, name="table"):
        written = write(rows, name)
        if name == "candidates":
            only = "b IS NOT NULL AND NOT left" if "left" in written.columns else "b IS NOT NULL"
            compared.append(written.filter(only).count())
        return written

    monkeypatch.setattr(near_copies, "materialise", counted)
    docs = spark.createDataFrame(list(enumerate([base, *texts])), "doc_id long, text string")
    kept = {row.doc_id for row in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect()}
    assert kept == {0} | set(range(31, 331))
    assert sum(compared) < 60 * len(texts)
