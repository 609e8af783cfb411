"""Case status, listings and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.order import in_order
from dossier.functions.rounding import percent
from dossier.functions.scoring import decided_status
from dossier.functions.text import labelize
from dossier.operators.audit import FIRST_EVENT
from dossier.operators.reviews import review_state


_PLACE = ("event_seq", "kind", "at", "status_after")


def status_events(cases: DataFrame, uploads: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every event that sets a case's status. An upload reopens an approved case."""
    created = cases.select(
        "case_id",
        F.lit(FIRST_EVENT).cast("long").alias("event_seq"),
        F.lit(0).alias("kind"),
        F.lit("created").alias("status_after"),
        F.col("created_at").alias("at"),
    )
    uploaded = uploads.select(
        "case_id",
        "event_seq",
        F.lit(0).alias("kind"),
        F.lit("review_required").alias("status_after"),
        F.col("uploaded_at").alias("at"),
    )
    decided = reviews.select(
        "case_id",
        "event_seq",
        F.lit(1).alias("kind"),
        decided_status(F.col("decision")).alias("status_after"),
        F.col("reviewed_at").alias("at"),
    )
    return created.unionByName(uploaded).unionByName(decided)


def current_status(cases: DataFrame, uploads: DataFrame, reviews: DataFrame) -> DataFrame:
    """Status and last change per created case.

    Events with one sequence number: uploads come before reviews, then by time.
    """
    return (
        status_events(cases, uploads, reviews)
        .groupBy("case_id")
        .agg(
            F.max_by("status_after", F.struct(*_PLACE)).alias("status"),
            F.max_by("at", F.struct(*_PLACE)).alias("updated_at"),
            F.min("event_seq").alias("first_event"),
            F.max("event_seq").alias("last_event"),
        )
        .filter(F.col("first_event") == FIRST_EVENT)
        .drop("first_event")
    )


def case_headers(cases: DataFrame, uploads: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cases with their current status and last review."""
    last_review = review_state(reviews).drop("status_after")
    return (
        cases.drop("status", "updated_at")
        .join(current_status(cases, uploads, reviews), "case_id")
        .join(last_review, "case_id", "left")
    )


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows found, wanted keys not found)."""
    found = rows.join(wanted.select(key), key, "left_semi")
    missing = wanted.select(key).join(rows.select(key), key, "left_anti")
    return found, missing


def newest_first(rows: DataFrame, sequence: str) -> DataFrame:
    """By creation time, newest first, with the place in that order.

    Equal times keep their order of insertion.
    """
    return in_order(rows, F.desc("created_at"), F.asc(sequence))


def selected_case(cases: DataFrame, case_id: str | None = None) -> DataFrame:
    """The named case, else (none named, or no such case) the newest one."""
    order = [F.desc("created_at"), F.asc("case_seq")]
    if case_id is not None:
        order.insert(0, F.desc(F.col("case_id") == case_id))
    return cases.orderBy(*order).limit(1)


def first_document_page(documents: DataFrame) -> DataFrame:
    """First page of each case's first document; ``documents`` needs pages."""
    page = F.get("pages", F.lit(0))
    first = documents.select(
        "case_id",
        "event_seq",
        F.struct(
            "document_id",
            page["page_number"].alias("page_number"),
            page["width"].alias("width"),
            page["height"].alias("height"),
            page["ocr_confidence"].alias("ocr_confidence"),
        ).alias("page"),
    )
    return (
        first.groupBy("case_id").agg(F.min_by("page", F.struct("event_seq", "page.document_id")).alias("page"))
    ).select("case_id", "page.*")


def documents_per_case(cases: DataFrame, uploads: DataFrame) -> DataFrame:
    counted = uploads.groupBy("case_id").agg(F.count(F.lit(1)).alias("documents"))
    return cases.join(counted, "case_id", "left").withColumn(
        "documents", F.coalesce("documents", F.lit(0).cast("long"))
    )


def case_metrics(headers: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: cases, cases in review, cases approved, documents.

    Documents are counted per case before they meet the cases.
    """
    return documents_per_case(headers, documents).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("status") == "review_required").alias("review"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
    )


def case_cards(headers: DataFrame) -> DataFrame:
    """Display texts of the cases."""
    return headers.select(
        "case_id",
        "applicant_name",
        labelize(F.col("case_type")).alias("case_type_label"),
        labelize(F.col("status")).alias("status_label"),
        F.upper("risk_level").alias("risk_label"),
        F.date_format("updated_at", "MMM dd, hh:mm a").alias("updated_label"),
    )


def field_cards(fields: DataFrame) -> DataFrame:
    """Display texts of the fields."""
    return fields.select(
        "field_id",
        "label",
        percent(F.col("confidence")).alias("confidence_label"),
        labelize(F.col("source")).alias("source_label"),
    )
