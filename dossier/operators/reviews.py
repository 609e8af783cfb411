"""Reviewer updates applied to fields as a fold over one event log."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.scoring import decided_action, decided_status
from dossier.functions.text import stable_id, title_label
from dossier.functions.validation import validate
from dossier.schemas import (
    DEFAULT_REVIEW_STATUS,
    EVIDENCE,
    FIELD_COLUMNS,
    GENERIC_DOCUMENT_TYPE,
)
from dossier.session import materialise

# Events, of all cases, in one stretch of time: no (case, key) has more to put in order.
BUCKET_ROWS = 1 << 20
# Equal cells in which events are counted to find these stretches.
CELLS = 1 << 10

# How reviewed fields are marked.
REVIEWER = "reviewer"
VERIFIED_SOURCE = "reviewer_verified"
ENTERED_SOURCE = "reviewer_entry"
ENTERED_MESSAGE = "Entered by reviewer"
ENTERED_EVIDENCE = "Reviewer-entered field"
REVIEWED_CONFIDENCE = 1.0


def mentions(reviews: DataFrame, target: str = "case_id") -> DataFrame:
    """One row per field a review names, in the review's own order."""
    entries = F.posexplode(F.map_entries("field_updates")).alias("mention_seq", "entry")
    return reviews.select(target, "event_seq", entries).select(
        target,
        F.col("entry.key").alias("key"),
        "event_seq",
        "mention_seq",
        F.coalesce("entry.value", F.lit("")).alias("value"),
    )


def arrivals(fields: DataFrame, *kept: str) -> DataFrame:
    """What the fold reads of fields: whose they are, their key, and when they came."""
    place = F.struct(
        "event_seq",
        F.lit(0).alias("kind"),
        F.coalesce("document_id", F.lit("")).alias("document_id"),
        F.col("field_seq").alias("sub_seq"),
    )
    return fields.select("case_id", "key", place.alias("place"), "field_id", *kept)


def mention_places(reviews: DataFrame) -> DataFrame:
    """The mentions of reviews of cases with their places among the arrivals."""
    place = F.struct(
        "event_seq",
        F.lit(1).alias("kind"),
        F.lit("").alias("document_id"),
        F.col("mention_seq").alias("sub_seq"),
    )
    return mentions(reviews).select("case_id", "key", place.alias("place"), "value")


def _listed(numbers: list[float]) -> Column:
    """An array of constants; folded into one literal."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def time_buckets(seqs: DataFrame, bucket_rows: int) -> Column:
    """Numbers of stretches of time that hold about ``bucket_rows`` events each.

    ``seqs`` has one row (event_seq) per event of all cases. Their distribution is
    counted in ``CELLS`` equal cells and taken as even within each, so the number of a
    bucket never falls along time and does not depend on the unit of the sequence
    numbers. As no bucket holds many events, no (case, key) has many in one.
    """
    seq = F.col("event_seq")
    facts = seqs.agg(F.count(seq).alias("n"), F.min(seq).alias("low"), F.max(seq).alias("high")).first()
    if facts.n <= bucket_rows:
        return F.lit(0).cast("long")
    share = (seq - F.lit(facts.low)) / F.lit(facts.high - facts.low + 1) * CELLS
    cell = F.least(F.floor(share), F.lit(CELLS - 1)).cast("int")
    counts = dict(seqs.filter(seq.isNotNull()).groupBy(cell.alias("cell")).count().collect())
    ends = list(accumulate(counts.get(n, 0) / bucket_rows for n in range(CELLS)))
    low, high = F.get(_listed([0.0, *ends[:-1]]), cell), F.get(_listed(ends), cell)
    return F.floor(F.least(low + (share - cell) * (high - low), high)).cast("long")


def _timeline(arrived: DataFrame, mentioned: DataFrame, bucket_rows: int) -> DataFrame:
    """Arrivals and mentions together, in buckets of time.

    Places are total: equal sequence numbers are told apart by kind, document and the
    place within it.
    """
    events = arrived.withColumn("value", F.lit(None).cast("string")).unionByName(
        mentioned.withColumn("field_id", F.lit(None).cast("string"))
    )
    seqs = events.select(F.col("place.event_seq").alias("event_seq"))
    bucket = time_buckets(seqs, bucket_rows)
    return events.withColumn("event_seq", F.col("place.event_seq")).withColumn("bucket", bucket).drop("event_seq")


def fold_mentions(arrived: DataFrame, mentioned: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per changed field its mentions: case_id, key, target, times, last and first.

    A mention changes the field with its key that arrived last before it; ``target`` is
    null where none did. Each bucket of a (case, key) is put in order once and gives one
    row per field that was mentioned in it. Two kinds of rows are open, i.e. go together
    with those of other buckets: mentions before the bucket's first arrival, and its
    last arrival. They alone meet in the second window, two rows a bucket at most; the
    others keep to themselves, so a case or key that holds most of all events is never
    in one task.
    """
    in_order = Window.partitionBy("case_id", "key", "bucket").orderBy("place")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_mention = F.col("value").isNotNull()
    segments = (
        _timeline(arrived, mentioned, bucket_rows)
        .withColumns(
            {
                "target": F.last("field_id", ignorenulls=True).over(so_far),
                "latest": F.last("field_id", ignorenulls=True).over(whole),
            }
        )
        .withColumn("is_open", F.col("target").isNull() | (F.col("target") == F.col("latest")))
        .groupBy("case_id", "key", "bucket", "target", "is_open")
        .agg(
            F.count("value").alias("times"),
            F.max(F.when(is_mention, F.struct("place", "value"))).alias("last"),
            F.min(F.when(is_mention, F.col("place"))).alias("first"),
        )
        .filter("is_open OR times > 0")
        .withColumn("own", F.when(~F.col("is_open"), F.col("bucket")))
    )
    # Within a bucket, what came before its first arrival goes first.
    carried = (
        Window.partitionBy("case_id", "key", "own")
        .orderBy("bucket", F.col("target").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        segments.withColumn("target", F.last("target", ignorenulls=True).over(carried))
        .filter("times > 0")
        .groupBy("case_id", "key", "own", "target")
        .agg(F.sum("times").alias("times"), F.max("last").alias("last"), F.min("first").alias("first"))
        .drop("own")
    )


def mention_targets(
    fields: DataFrame, reviews: DataFrame, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """What reviews of cases change, one row per field changed or entered."""
    return fold_mentions(arrivals(fields), mention_places(reviews), bucket_rows)


def apply_targets(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """Fields as the mentions in ``targets`` leave them, entered ones included.

    ``targets`` is read twice, so it should be a table. Changes meet the fields in a
    left join: as long as they are few, Spark may broadcast them and the fields stay
    where they are.
    """
    checked = targets.withColumn("value", F.col("last.value")).withColumn(
        "check", validate(F.col("key"), F.col("value"), F.lit(GENERIC_DOCUMENT_TYPE))
    )
    changes = checked.filter("target IS NOT NULL").select(
        F.col("target").alias("field_id"), F.struct("value", "check").alias("change")
    )
    change = F.col("change")
    when_changed = {
        "value": change["value"],
        "confidence": F.lit(REVIEWED_CONFIDENCE),
        "source": F.lit(VERIFIED_SOURCE),
        "validation_status": change["check"]["status"],
        "validation_message": change["check"]["message"],
        "extracted_by": F.lit(REVIEWER),
    }
    kept = fields.join(changes, "field_id", "left").select(
        *[
            F.when(change.isNotNull(), when_changed[name]).otherwise(F.col(name)).alias(name)
            if name in when_changed
            else F.col(name)
            for name in FIELD_COLUMNS
        ]
    )
    return kept.unionByName(_entered(checked.filter("target IS NULL")))


def apply_case_reviews(
    fields: DataFrame, reviews: DataFrame, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Fields of the cases after all reviews, reviewer-entered ones included.

    What the reviews change is worked out and written once; it is narrow.
    """
    return apply_targets(fields, materialise(mention_targets(fields, reviews, bucket_rows), "targets"))


def _entered(targets: DataFrame) -> DataFrame:
    """Fields that reviewers entered, no document having brought their key before."""
    no_text = F.lit(None).cast("string")
    # Entered and never changed afterwards: taken as it is.
    unchecked = F.col("times") == 1
    columns = {
        "case_id": F.col("case_id"),
        "document_id": no_text,
        "field_id": stable_id("fld", F.col("case_id"), F.lit(REVIEWER), F.col("key")),
        "event_seq": F.col("first.event_seq"),
        "field_seq": F.col("first.sub_seq"),
        "key": F.col("key"),
        "label": title_label(F.col("key")),
        "value": F.col("value"),
        "confidence": F.lit(REVIEWED_CONFIDENCE),
        "required": F.lit(True),
        "source": F.when(unchecked, ENTERED_SOURCE).otherwise(VERIFIED_SOURCE),
        "validation_status": F.when(unchecked, "valid").otherwise(F.col("check.status")),
        "validation_message": F.when(unchecked, ENTERED_MESSAGE).otherwise(F.col("check.message")),
        "bbox": F.lit(None).cast("array<bigint>"),
        "evidence": F.struct(
            no_text.alias("document_id"),
            F.lit(1).cast("long").alias("source_page"),
            F.lit(None).cast("array<bigint>").alias("bbox"),
            F.lit(ENTERED_EVIDENCE).alias("evidence_text"),
            no_text.alias("image_crop_uri"),
        ).cast(EVIDENCE),
        "extracted_by": F.lit(REVIEWER),
        "review_status": F.lit(DEFAULT_REVIEW_STATUS),
    }
    return targets.select(*[columns[name].alias(name) for name in FIELD_COLUMNS])


def document_changes(reviews: DataFrame) -> DataFrame:
    """The last mention per template document and key."""
    return (
        mentions(reviews, "document_id")
        .groupBy("document_id", "key")
        .agg(F.max(F.struct("event_seq", "mention_seq", "value")).alias("last"))
    )


def apply_document_changes(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of template documents after their last mentions; unknown keys are ignored."""
    latest = changes.select("document_id", "key", F.col("last.value").alias("new_value"))
    joined = fields.join(latest, ["document_id", "key"], "left").withColumn(
        "check", validate(F.col("key"), F.col("new_value"), F.col("document_type"))
    )
    changed = F.col("new_value").isNotNull()
    when_changed = {
        "value": F.col("new_value"),
        "confidence": F.lit(REVIEWED_CONFIDENCE),
        "validation_status": F.col("check.status"),
        "validation_message": F.col("check.message"),
    }
    return joined.select(
        *[
            F.when(changed, when_changed[name]).otherwise(F.col(name)).alias(name)
            if name in when_changed
            else F.col(name)
            for name in fields.columns
        ]
    )


def apply_document_reviews(fields: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fields of template documents after all reviews."""
    return apply_document_changes(fields, document_changes(reviews))


def review_decisions(reviews: DataFrame, subject: str = "case") -> DataFrame:
    """Reviews with the status and the audit action each leads to."""
    return reviews.withColumns(
        {
            "status_after": decided_status(F.col("decision")),
            "action": decided_action(F.col("decision"), subject),
        }
    )


def last_reviews(reviews: DataFrame, target: str = "case_id") -> DataFrame:
    """Per target its last review and where that stands.

    Reviews with one sequence number follow each other by time, then by content.
    """
    place = F.struct("event_seq", "reviewed_at", "reviewer", "decision", "note")
    review = F.struct("reviewer", "note", "reviewed_at", decided_status(F.col("decision")).alias("status_after"))
    return reviews.groupBy(target).agg(F.max(place).alias("place"), F.max_by(review, place).alias("review"))


def review_state(reviews: DataFrame, target: str = "case_id") -> DataFrame:
    """Reviewer, note and time of the last review per target, and the status it leads to."""
    return last_reviews(reviews, target).select(target, "review.*")


def apply_document_decisions(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Template documents with their last review; the score is left as it was."""
    joined = records.join(review_state(reviews, "document_id"), "document_id", "left")
    return joined.select(
        "document_id",
        "filename",
        "document_type",
        F.coalesce("status_after", "status").alias("status"),
        "overall_confidence",
        "created_at",
        F.coalesce("reviewed_at", "updated_at").alias("updated_at"),
        "reviewer",
        "note",
        "reviewed_at",
    )
