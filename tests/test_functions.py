import random

from pyspark.sql import functions as F

import restated
from dossier.functions.rounding import percent, round2
from dossier.functions.scoring import decided_action, decided_status, overall_confidence, route
from dossier.functions.text import labelize, strip, title_label
from dossier.functions.validation import validate

DEVANAGARI_PAN = "१२३४५६७८९"


def test_round2_equals_python(spark):
    draw = random.Random(7)
    values = [n / 1000 for n in range(-1200, 3001)]
    values += [draw.uniform(-50, 50) for _ in range(3000)]
    values += [1.005, 2.675, 0.835, 0.0, float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for row in rows.select("v", round2(F.col("v")).alias("r")).collect():
        assert row.r == round(row.v, 2), row.v


def test_round2_of_nan(spark):
    row = spark.sql("SELECT double('NaN') AS v").select(round2(F.col("v")).alias("r")).first()
    assert row.r != row.r


def test_strip_equals_python(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [b + "a" + b + "z" + b for b in blanks] + ["", " ", "".join(blanks), "a​b​", "᠎x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", strip(F.col("t")).alias("s")).collect():
        assert row.s == row.t.strip(), repr(row.t)


def test_validate_equals_restatement(spark):
    keys = ["mobile", "phone", "email", "pan", "citizenship_number", "cheque_number", "dob", "date", "amount", "name", "Mobile"]
    values = [
        "", " ", " ", "\x1c", "9841000000", " 9841000000\n", "98410O0000", "98012",
        "9८४१००००००", DEVANAGARI_PAN, "123456789", "12345678", "a@b.c", "a b@c.d", "a@b　c.d",
        "sita at example.com", "a@@b.c", "27-01/A", "27 01", "२७", "2026-99-99", "27/05/2026",
        "१९९२-०४-१३", "25000.00", "25000.", "25000.123", "Rs 5", "12\n", " 123456789 ", "x\ny",
    ]
    rows = spark.createDataFrame(
        [(k, v, d) for k in keys for v in values for d in ("cheque", "citizenship", "enterprise_kyc")],
        "k string, v string, d string",
    )
    checked = rows.withColumn("c", validate(F.col("k"), F.col("v"), F.col("d")))
    for row in checked.collect():
        assert row.c.status == restated.status(row.k, row.v, row.d), row


def test_validate_messages(spark):
    rows = spark.createDataFrame(
        [("mobile", "98012", "account_opening"), ("email", "customer@example.com", "account_opening")],
        "k string, v string, d string",
    )
    bad, good = [r.c for r in rows.select(validate(F.col("k"), F.col("v"), F.col("d")).alias("c")).collect()]
    assert bad.status == "invalid" and "10 digits" in bad.message
    assert (good.status, good.message) == ("valid", "OK")


def test_routing(spark):
    rows = spark.createDataFrame([(0.96,), (0.95,), (0.80,), (0.79,)], "c double")
    assert [r.r for r in rows.select(route(F.col("c")).alias("r")).collect()] == [
        "auto_approved",
        "auto_approved",
        "review_required",
        "manual_entry",
    ]


def test_overall_confidence(spark):
    rows = spark.createDataFrame(
        [
            ("a", True, 0.94), ("a", False, 0.60), ("a", True, 0.88),
            ("none required", False, 0.9), ("no confidence", None, None), ("tie", True, 0.835),
        ],
        "d string, required boolean, c double",
    )
    scored = rows.groupBy("d").agg(overall_confidence(F.col("c"), F.col("required")).alias("o"))
    assert {r.d: r.o for r in scored.collect()} == {
        "a": 0.88, "none required": 0.0, "no confidence": 0.0, "tie": round(0.835, 2)
    }


def test_decisions_are_exact_words(spark):
    rows = spark.createDataFrame([("approve",), ("reject",), ("APPROVE",), ("",)], "d string")
    got = rows.select(decided_status(F.col("d")).alias("s"), decided_action(F.col("d"), "case").alias("a"))
    assert [tuple(r) for r in got.collect()] == [
        ("approved", "case_approved"),
        ("rejected", "case_rejected"),
        ("review_required", "review_saved"),
        ("review_required", "review_saved"),
    ]


def test_title_label_equals_python(spark):
    keys = ["mobile", "father_mother_name", "a1b", "o'neil_x", "PAN_no", "x__y", "é_à", "नाम_abc", ""]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    for row in rows.select("k", title_label(F.col("k")).alias("t")).collect():
        assert row.t == row.k.replace("_", " ").title()


def test_display_texts(spark):
    rows = spark.createDataFrame([("individual_kyc", 0.915), ("o'neil-x_éa B1", 0.005)], "v string, c double")
    got = rows.select(labelize(F.col("v")).alias("l"), percent(F.col("c")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("Individual Kyc", "92%"), ("O'Neil-X éA B1", "1%")]
