"""Request rows for an external batch-inference step."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.rounding import round2
from dossier.schemas import MODEL_EXTRACTOR

# The instruction a model answers to, and the sampling options.
SYSTEM_TEXT = (
    "You are {engine} for Nepal financial KYC. "
    "Extract only evidence-backed data from OCR/page evidence. Return JSON only. "
    "Do not invent values. If a field is unclear, lower confidence and add a finding. "
    "Use Nepal financial institution context: KYC, KYB, onboarding, PAN/VAT, citizenship, "
    "National ID, account opening forms, cheque, bank statement, company registration, "
    "board resolution, tax clearance, nominee, signature, photo, and branch documents. "
    "JSON schema: {{document_type, summary, "
    "fields:[{{key,label,value,confidence,required,source_page,evidence_text,bbox}}], "
    "findings:[{{severity,code,message,field_key}}]}}."
)
TEMPERATURE = 0
MAX_TOKENS = 900

# How the model is addressed; not part of the data, so callers may change it.
DEFAULT_ENGINE = "a Gemma 4 26B reasoning engine"


def _two_places(value: Column) -> Column:
    return F.format_string("%.2f", round2(value))


def evidence_text(pages: Column) -> Column:
    """Page headings and numbered block lines of one document."""

    def block_line(block: Column, position: Column) -> Column:
        return F.concat(
            F.lit("["),
            (position + 1).cast("string"),
            F.lit("] bbox=["),
            F.array_join(block["bbox"].cast("array<string>"), ", "),
            F.lit("] conf="),
            _two_places(block["confidence"]),
            F.lit(" type="),
            block["block_type"],
            F.lit(": "),
            block["text"],
        )

    def page_lines(page: Column) -> Column:
        heading = F.concat(
            F.lit("PAGE "),
            page["page_number"].cast("string"),
            F.lit(" ("),
            page["width"].cast("string"),
            F.lit("x"),
            page["height"].cast("string"),
            F.lit(")"),
        )
        return F.concat(F.array(heading), F.transform(page["blocks"], block_line))

    return F.array_join(F.flatten(F.transform(pages, page_lines)), "\n")


def user_text(case_type: Column, declared_type: Column, pages: Column) -> Column:
    return F.concat(
        F.lit("Case type: "),
        case_type,
        F.lit("\nExpected document type: "),
        declared_type,
        F.lit("\n\nOCR evidence:\n"),
        evidence_text(pages),
    )


def prompt_requests(
    documents: DataFrame,
    model: str = MODEL_EXTRACTOR,
    engine: str = DEFAULT_ENGINE,
) -> DataFrame:
    """``document_id`` and the JSON ``body`` of one request per document.

    ``documents`` needs case_type, declared_document_type and pages.
    """
    system = F.struct(
        F.lit("system").alias("role"), F.lit(SYSTEM_TEXT.format(engine=engine)).alias("content")
    )
    user = F.struct(
        F.lit("user").alias("role"),
        F.array(
            F.struct(
                F.lit("text").alias("type"),
                user_text(
                    F.col("case_type"), F.col("declared_document_type"), F.col("pages")
                ).alias("text"),
            )
        ).alias("content"),
    )
    # The two messages differ in shape, so each is rendered on its own.
    body = F.concat(
        F.lit(f'{{"model":{json.dumps(model)},"messages":['),
        F.to_json(system),
        F.lit(","),
        F.to_json(user),
        F.lit(f'],"temperature":{TEMPERATURE},"max_tokens":{MAX_TOKENS}}}'),
    )
    return documents.select("document_id", body.alias("body"))
