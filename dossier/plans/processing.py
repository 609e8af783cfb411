"""Uploads to documents, fields and findings.

Only what is read off the text (type, rule hits, page score) travels on; the
text stays where it was scanned. The joins, with the cases and with the model
responses, therefore move narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.rows import exploded, with_computed
from dossier.functions.text import or_else, stable_id
from dossier.functions.validation import validate
from dossier.operators.blocks import all_text, document_pages, first_bbox
from dossier.operators.intake import check_domain
from dossier.operators.responses import (
    FAILURE_CODE,
    FAILURE_PREFIX,
    latest_responses,
    parse_responses,
)
from dossier.operators.rule_table import as_fields, table_fields
from dossier.operators.rules import (
    DEFAULT_RULES,
    REVIEW_FINDING,
    TextRule,
    fallback_summary,
    finding,
    infer_type,
    rule_fields,
    rule_hits,
)
from dossier.schemas import (
    DEFAULT_REVIEW_STATUS,
    FIELD_COLUMNS,
    MODEL_EXTRACTOR,
    PARSED,
)
from dossier.sources.readers import named


def document_signals(
    uploads: DataFrame,
    rules: Sequence[TextRule] = DEFAULT_RULES,
    keep_pages: bool = False,
) -> DataFrame:
    """What the text says about each document; one narrow pass over the uploads."""
    paged = with_computed(named(uploads), {"pages": document_pages()})
    texts = with_computed(
        paged.drop("content"), {"text": all_text(F.col("pages"))}
    ).withColumn("lowered", F.lower("text"))
    signals = texts.select(
        "document_id",
        "case_id",
        "filename",
        "stored_name",
        "declared_document_type",
        "uploaded_at",
        "event_seq",
        infer_type(F.col("declared_document_type"), F.col("lowered")).alias("inferred_type"),
        rule_hits(F.col("text"), F.col("lowered"), rules).alias("hits"),
        first_bbox(F.col("pages")).alias("first_bbox"),
        F.size("pages").alias("page_count"),
        "pages",
    )
    return signals if keep_pages else signals.drop("pages")


def unknown_case(uploads: DataFrame, cases: DataFrame) -> DataFrame:
    """Uploads that name a case nobody created; they are not processed."""
    return uploads.join(cases.select("case_id"), "case_id", "left_anti")


def process_documents(
    uploads: DataFrame,
    cases: DataFrame,
    responses: DataFrame | None = None,
    rules: Sequence[TextRule] = DEFAULT_RULES,
    keep_pages: bool = False,
) -> DataFrame:
    """One row per document of a known case, its fields and findings nested.

    Uploads that declare a foreign type are left out (``intake.check_domain`` gives
    them with the reason), and of several responses to a document the last counts.

    ``responses=None`` means the model step is switched off: every document is
    read by rules. ``keep_pages`` carries the text blocks along for exports.
    """
    uploads, _ = check_domain(uploads, "upload")
    known = case_types(uploads, cases)
    if responses is None:
        verdicts = known.select(
            "*", *[F.lit(None).cast(field.dataType).alias(field.name) for field in PARSED]
        )
    else:
        # Responses to other documents are dropped before they are parsed.
        wanted = responses.join(known.select("document_id"), "document_id", "left_semi")
        verdicts = known.join(parse_responses(latest_responses(wanted)), "document_id", "left")
    answered = document_signals(uploads, rules, keep_pages).join(verdicts, "document_id")
    return resolve(answered, rules, keep_pages)


def case_types(uploads: DataFrame, cases: DataFrame) -> DataFrame:
    """document_id and case_type of the uploads whose case is known.

    Cases may be very unequal in size, so only ids meet them. What was read off the text
    (and the pages, if kept) is shuffled once, by its own document's id.
    """
    return (
        uploads.select("document_id", "case_id")
        .join(cases.select("case_id", "case_type"), "case_id")
        .select("document_id", "case_type")
    )


def resolve(
    answered: DataFrame,
    rules: Sequence[TextRule] = DEFAULT_RULES,
    keep_pages: bool = False,
    by_rules: Column | None = None,
) -> DataFrame:
    """Documents from their signals, case type and verdict: the model's fields, or the rules'.

    ``by_rules``: the fields that rules found, where they are not read off the hits.
    """
    if by_rules is None:
        by_rules = rule_fields(F.col("hits"), F.col("first_bbox"), F.col("case_type"), rules)
    parsed = F.col("outcome") == "parsed"
    review_finding = finding(*REVIEW_FINDING)
    failure_finding = finding(
        "warning", FAILURE_CODE, F.concat(F.lit(FAILURE_PREFIX), F.col("failure"))
    )
    return answered.select(
        "document_id",
        "case_id",
        "event_seq",
        "filename",
        "stored_name",
        "declared_document_type",
        F.when(parsed, F.col("document_type"))
        .otherwise(F.col("inferred_type"))
        .alias("document_type"),
        F.lit("processed").alias("status"),
        "page_count",
        F.when(parsed, F.col("summary"))
        .otherwise(fallback_summary(F.col("inferred_type")))
        .alias("summary"),
        F.coalesce("outcome", F.lit("no_response")).alias("outcome"),
        F.when(parsed, F.col("fields"))
        .otherwise(by_rules)
        .alias("fields"),
        F.when(parsed, F.col("findings"))
        .when(F.col("outcome") == "failed", F.array(review_finding, failure_finding))
        .otherwise(F.array(review_finding))
        .alias("findings"),
        F.col("uploaded_at").alias("created_at"),
        F.col("uploaded_at").alias("updated_at"),
        *(["pages"] if keep_pages else []),
    )


def process_by_rule_table(uploads: DataFrame, cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents read by a table of rules (``rule_table``), the model step switched off."""
    uploads, _ = check_domain(uploads, "upload")
    known = case_types(uploads, cases)
    paged = with_computed(named(uploads).select("document_id", "content", "filename"), {"pages": document_pages()})
    texts = paged.select("document_id", all_text(F.col("pages")).alias("text"))
    found = table_fields(texts, known, rules)
    verdicts = known.select("*", *[F.lit(None).cast(field.dataType).alias(field.name) for field in PARSED])
    answered = document_signals(uploads, rules=()).join(verdicts, "document_id").join(found, "document_id", "left")
    return resolve(answered, by_rules=as_fields(F.col("found"), F.col("first_bbox")))


def document_fields(documents: DataFrame) -> DataFrame:
    """One validated row per field of the processed documents."""
    kept = ["case_id", "document_id", "event_seq", "document_type"]
    raw = exploded(documents, kept, "fields", "field_seq", "field").select(
        *kept, "field_seq", "field.*"
    )
    checked = raw.withColumn(
        "check", validate(F.col("key"), F.col("value"), F.col("document_type"))
    )
    return checked.select(
        *FIELD_COLUMNS[:2],
        stable_id("fld", F.col("document_id"), F.col("field_seq")).alias("field_id"),
        "event_seq",
        "field_seq",
        "key",
        "label",
        "value",
        "confidence",
        "required",
        "source",
        F.col("check.status").alias("validation_status"),
        F.col("check.message").alias("validation_message"),
        F.when(F.size("bbox") > 0, F.col("bbox"))
        .when(F.size("evidence_bbox") > 0, F.col("evidence_bbox"))
        .otherwise(F.col("bbox"))
        .alias("bbox"),
        F.struct(
            "document_id",
            "source_page",
            F.col("evidence_bbox").alias("bbox"),
            "evidence_text",
            F.lit(None).cast("string").alias("image_crop_uri"),
        ).alias("evidence"),
        or_else(F.col("extracted_by"), F.lit(MODEL_EXTRACTOR)).alias("extracted_by"),
        F.lit(DEFAULT_REVIEW_STATUS).alias("review_status"),
    )


def document_findings(documents: DataFrame) -> DataFrame:
    """One row per finding of the processed documents."""
    kept = ["case_id", "document_id", "event_seq"]
    return exploded(documents, kept, "findings", "finding_seq", "finding").select(
        *kept, "finding_seq", "finding.*"
    )
