"""Audit rows, derived from the rows that caused them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.reviews import review_decisions
from dossier.sources.readers import stored_name

# Case creation comes before every other event.
FIRST_EVENT = -1

# Fixed value: the actor named for processing.
PROCESSING_ACTOR = "gemma-4-26b"


def _metadata(**entries: Column) -> Column:
    pairs = [part for name, value in entries.items() for part in (F.lit(name), value)]
    return F.create_map(*pairs).cast("map<string,string>")


def _row(target, event_seq, sub_seq: int, action, actor, note, at, **metadata: Column):
    return [
        target.alias("target_id"),
        event_seq.cast("long").alias("event_seq"),
        F.lit(sub_seq).alias("sub_seq"),
        action.alias("action"),
        actor.alias("actor"),
        note.alias("note"),
        _metadata(**metadata).alias("metadata"),
        at.alias("created_at"),
    ]


def case_created(cases: DataFrame) -> DataFrame:
    return cases.select(
        *_row(
            F.col("case_id"),
            F.lit(FIRST_EVENT),
            0,
            F.lit("case_created"),
            F.lit("api"),
            F.concat(F.lit("Created "), F.col("case_type"), F.lit(" case")),
            F.col("created_at"),
            customer_ref=F.col("integration_ref"),
        )
    )


def case_document_uploaded(documents: DataFrame) -> DataFrame:
    return documents.select(
        *_row(
            F.col("case_id"),
            F.col("event_seq"),
            0,
            F.lit("document_uploaded"),
            F.lit("uploader"),
            F.col("filename"),
            F.col("created_at"),
            stored_path=F.col("stored_name"),
            declared_document_type=F.col("declared_document_type"),
        )
    )


def case_document_processed(documents: DataFrame) -> DataFrame:
    """The actor is the model even where the rules did the work."""
    return documents.select(
        *_row(
            F.col("case_id"),
            F.col("event_seq"),
            1,
            F.lit("document_processed"),
            F.lit(PROCESSING_ACTOR),
            F.col("summary"),
            F.col("created_at"),
            document_id=F.col("document_id"),
            document_type=F.col("document_type"),
        )
    )


def reviewed(reviews: DataFrame, target: str, subject: str) -> DataFrame:
    return review_decisions(reviews, subject).select(
        *_row(
            F.col(target),
            F.col("event_seq"),
            0,
            F.col("action"),
            F.col("reviewer"),
            F.col("note"),
            F.col("reviewed_at"),
        )
    )


def exported(headers: DataFrame, at: Column) -> DataFrame:
    """The export's own row, behind the last event of each case."""
    return headers.select(
        *_row(
            F.col("case_id"),
            F.col("last_event") + 1,
            0,
            F.lit("export_generated"),
            F.lit("api"),
            F.lit("JSON export generated"),
            at,
        )
    )


def record_uploaded(records: DataFrame) -> DataFrame:
    stored = stored_name(F.col("filename"), F.col("created_at"))
    return records.select(
        *_row(
            F.col("document_id"),
            F.lit(FIRST_EVENT),
            0,
            F.lit("document_uploaded"),
            F.lit("uploader"),
            F.concat(F.lit("Stored "), stored),
            F.col("created_at"),
        )
    )


def record_read(records: DataFrame, template_table: DataFrame, provider: str) -> DataFrame:
    names = template_table.select("document_type", "template_name").distinct()
    return records.join(names, "document_type").select(
        *_row(
            F.col("document_id"),
            F.lit(FIRST_EVENT),
            1,
            F.lit("ocr_completed"),
            F.lit(provider),
            F.concat(F.lit("Template: "), F.col("template_name")),
            F.col("created_at"),
        )
    )


def case_audit(cases: DataFrame, documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """All audit rows of the cases; order by event_seq, sub_seq."""
    known = reviews.join(cases.select("case_id"), "case_id", "left_semi")
    return (
        case_created(cases)
        .unionByName(case_document_uploaded(documents))
        .unionByName(case_document_processed(documents))
        .unionByName(reviewed(known, "case_id", "case"))
    )


def document_audit(
    records: DataFrame, reviews: DataFrame, template_table: DataFrame, provider: str = "mock"
) -> DataFrame:
    """All audit rows of the documents read by template."""
    known = reviews.join(records.select("document_id"), "document_id", "left_semi")
    return (
        record_uploaded(records)
        .unionByName(record_read(records, template_table, provider))
        .unionByName(reviewed(known, "document_id", "review"))
    )
