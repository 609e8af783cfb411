"""Rules as a table against rules in the plan, and many of them against plain search."""

import random

from pyspark.sql import functions as F

from dossier.operators import rule_table


def test_many_rules(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choices("abcdé AB.\n", k=draw.choice([0, 3, 40, 400]))) for _ in range(120)] + [None]
    patterns = []
    for _ in range(5000):
        text = draw.choice(texts) or "x"
        start, size = draw.randrange(max(1, len(text))), draw.choice([1, 2, 4, 5, 6, 7, 12, 30])
        cut = text[start : start + size]
        patterns.append(cut.swapcase() if draw.random() < 0.5 else cut + draw.choice(["", "q"]))
    patterns[0] = ""
    rows = [(n, f"k{n}", "l", p, n % 2 == 0, p, 0.5, "e", None, 0.0, "") for n, p in enumerate(patterns)]
    rules = spark.createDataFrame(rows, rule_table.RULES)
    given = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "document_id string, text string")
    got = {(r.document_id, r.rule_seq) for r in rule_table.table_hits(given, rules).collect()}
    expected = {
        (str(d), n)
        for n, p in enumerate(patterns)
        for d, text in enumerate(texts)
        if p and text is not None and (p.lower() in text.lower() if n % 2 == 0 else p in text)
    }
    assert got == expected
    assert rule_table.table_hits(given.limit(0), rules).count() == 0
    assert rule_table.table_hits(given, rules.limit(0)).count() == 0


def test_absent_rules_and_plan_size(spark):
    rules = rule_table.rule_table(spark)
    given = spark.createDataFrame(
        [("d1", "x SITA Sharma y"), ("d2", "nobody"), ("d3", "27-01-78-12345")], "document_id string, text string"
    )
    types = spark.createDataFrame(
        [("d1", "individual_kyc"), ("d2", "individual_kyc"), ("d3", "loan_onboarding")], "document_id string, case_type string"
    )
    found = {r.document_id: [(f.key, f.value) for f in r.found] for r in rule_table.table_fields(given, types, rules).collect()}
    assert found == {
        "d1": [("full_name", "Sita Sharma")],
        "d2": [("full_name", "")],
        "d3": [("citizenship_number", "27-01-78-12345")],
    }
    # A thousand rules more do not change the plan.
    many = spark.range(1000).select(
        F.col("id").cast("int").alias("rule_seq"), F.lit("k").alias("key"), F.lit("l").alias("label"),
        F.concat(F.lit("pattern "), "id").alias("pattern"), F.lit(True).alias("ignore_case"), F.lit("v").alias("value"),
        F.lit(0.5).alias("confidence"), F.lit("e").alias("evidence_text"), F.lit(None).cast("string").alias("absent_case_type"),
        F.lit(0.0).alias("absent_confidence"), F.lit("").alias("absent_evidence_text"),
    )
    few = [len(rule_table.table_hits(given, many.limit(n))._jdf.queryExecution().optimizedPlan().toString()) for n in (900, 1000)]
    assert abs(few[0] - few[1]) < 200
