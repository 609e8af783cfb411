import random

import pytest
from pyspark.sql import functions as F

import restated
from dossier.operators import reviews
from dossier.schemas import REVIEWS

FIELDS = (
    "case_id string, document_id string, field_id string, event_seq long, field_seq int, key string, "
    "label string, value string, confidence double, required boolean, source string, "
    "validation_status string, validation_message string, bbox array<bigint>, "
    "evidence struct<document_id:string,source_page:bigint,bbox:array<bigint>,evidence_text:string,image_crop_uri:string>, "
    "extracted_by string, review_status string"
)


def field(case_id, seq, n, key, value):
    document = f"{case_id}-{seq}"
    return (
        case_id, document, f"{document}/{n}", seq, n, key, key, value, 0.5, True, "document", "-", "-",
        None, (document, 1, None, "", None), "rules", "needs_review",
    )


def review(case_id, seq, updates, decision="save"):
    return (case_id, seq, f"r{seq}", decision, f"n{seq}", updates, None)


def histories(cases: int, seed: int):
    draw = random.Random(seed)
    for n in range(cases):
        events = []
        for _ in range(draw.randint(1, 14)):
            if draw.random() < 0.5:
                events.append(
                    {"fields": [(draw.choice("ab") + "_x", str(draw.randint(0, 99))) for _ in range(draw.randint(0, 3))]}
                )
            else:
                keys = draw.sample(["a_x", "b_x", "c_x", "mobile"], draw.randint(0, 3))
                events.append({"updates": {k: draw.choice(["9841000000", "bad", " "]) for k in keys}})
        yield f"case{n}", events


def tables(spark, cases):
    fields, found = [], []
    for case_id, events in cases:
        for seq, event in enumerate(events):
            fields += [field(case_id, seq, n, k, v) for n, (k, v) in enumerate(event.get("fields", []))]
            if "updates" in event:
                found.append(review(case_id, seq, event["updates"]))
    return spark.createDataFrame(fields, FIELDS), spark.createDataFrame(found, REVIEWS)


@pytest.mark.parametrize("bucket_rows", [1 << 20, 3])
@pytest.mark.parametrize("unit", [1, 1_000_000])
def test_fold_equals_events_one_by_one(spark, bucket_rows, unit):
    """Also with buckets so small that every history crosses several, in any unit."""
    cases = list(histories(120, 11))
    fields, found = tables(spark, cases)
    seq = F.lit(1_700_000_000_000_000) + F.col("event_seq") * unit
    fields, found = fields.withColumn("event_seq", seq), found.withColumn("event_seq", seq)
    got = {}
    for row in reviews.apply_case_reviews(fields, found, bucket_rows).collect():
        got.setdefault(row.case_id, []).append(
            (row.key, row.value, row.source, row.validation_status)
        )
    for case_id, events in cases:
        assert sorted(got.get(case_id, [])) == restated.reviewed(events), case_id


def test_entered_field(spark):
    fields, found = tables(
        spark, [("c", [{"fields": [("a_x", "1")]}, {"updates": {"tax_no": "7", "a_x": "2"}}])]
    )
    got = {row.key: row for row in reviews.apply_case_reviews(fields, found).collect()}
    entered, changed = got["tax_no"], got["a_x"]
    assert (entered.label, entered.value, entered.confidence, entered.source) == ("Tax No", "7", 1.0, "reviewer_entry")
    assert (entered.validation_status, entered.validation_message) == ("valid", "Entered by reviewer")
    assert entered.evidence.evidence_text == "Reviewer-entered field" and entered.extracted_by == "reviewer"
    assert (changed.value, changed.confidence, changed.source, changed.label) == ("2", 1.0, "reviewer_verified", "a_x")
    assert changed.document_id == "c-0" and changed.review_status == "needs_review"


def test_hot_key_and_tied_numbers(spark):
    """A third of all events on one (case, key), many with one number: one winner, always."""
    hot = [{"fields": [("a_x", "0")]}] + [{"updates": {"a_x": str(n)}} for n in range(400)]
    fields, found = tables(spark, [("hot", hot), *histories(40, 3)])
    # Two events at a time share a number.
    tied = F.floor(F.col("event_seq") / 2)
    fields, found = fields.withColumn("event_seq", tied), found.withColumn("event_seq", tied)
    results = []
    for parts, bucket_rows in ((1, 1 << 20), (7, 50), (3, 5)):
        rows = reviews.apply_case_reviews(fields.repartition(parts), found.repartition(parts), bucket_rows)
        results.append(sorted((r.case_id, r.key, r.value, r.source, r.field_id) for r in rows.collect()))
    assert results[0] == results[1] == results[2]
    # The last number holds review 399 alone.
    assert ("hot", "a_x", "399", "reviewer_verified", "hot-0/0") in results[0]
    state = reviews.review_state(found.repartition(5)).filter("case_id = 'hot'").first()
    assert state.reviewer == "r400"


def test_last_review_counts(spark):
    found = spark.createDataFrame(
        [review("c", 2, {}, "approve"), review("c", 9, {}, "reject"), review("c", 5, {}, "approve")], REVIEWS
    )
    row = reviews.review_state(found).first()
    assert (row.reviewer, row.note, row.status_after) == ("r9", "n9", "rejected")


def _exchanges(spark, build):
    """Exchanges of the tables that ``build`` writes and of the plan it returns."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1024"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return build()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_fold_reads_each_side_once(spark):
    fields, found = tables(spark, list(histories(20, 2)))
    targets = _exchanges(spark, lambda: reviews.mention_targets(fields, found))
    applied = _exchanges(spark, lambda: reviews.apply_case_reviews(fields, found))
    # With one bucket of time, the order across buckets needs no exchange of its own.
    assert targets == 1 and targets + applied <= 3
    many = _exchanges(spark, lambda: reviews.mention_targets(fields, found, 3))
    assert many == 2
