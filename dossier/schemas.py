"""Schemas, allowed values and field defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# The allowed values of each enumerated column.
CASE_TYPES = (
    "individual_kyc",
    "business_kyb",
    "loan_onboarding",
    "document_digitization",
)
CASE_STATUSES = (
    "created",
    "processing",
    "review_required",
    "approved",
    "rejected",
    "exported",
)
RISK_LEVELS = ("low", "medium", "high")
DOCUMENT_TYPES = (
    "unknown",
    "citizenship",
    "national_id",
    "passport",
    "driving_license",
    "account_opening",
    "pan",
    "vat",
    "cheque",
    "bank_statement",
    "company_registration",
    "board_resolution",
    "tax_clearance",
)
DOCUMENT_STATUSES = (
    "uploaded",
    "processed",
    "auto_approved",
    "review_required",
    "manual_entry",
    "approved",
    "rejected",
)
VALIDATION_STATUSES = ("valid", "invalid", "missing", "warning")
REVIEW_STATUSES = ("pending", "needs_review", "verified", "rejected")

# What a record holds when its producer leaves a column out.
DEFAULT_CASE_TYPE = "individual_kyc"
DEFAULT_INSTITUTION = "demo-institution"
DEFAULT_RISK = "medium"
DEFAULT_EXTRACTOR = "deterministic-fallback"
DEFAULT_REVIEW_STATUS = "needs_review"
MODEL_EXTRACTOR = "gemma-4-26b-4bit"
# The document type reviewers' and rule values are checked against.
GENERIC_DOCUMENT_TYPE = "enterprise_kyc"

UPLOADS = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("declared_document_type", T.StringType()),
        T.StructField("uploaded_at", T.TimestampNTZType()),
        T.StructField("event_seq", T.LongType()),
    ]
)

OBSERVATIONS = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("obs_seq", T.LongType()),
        T.StructField("field_key", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

CASE_REQUESTS = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("case_type", T.StringType()),
        T.StructField("applicant_name", T.StringType()),
        T.StructField("customer_ref", T.StringType()),
        T.StructField("institution_id", T.StringType()),
        T.StructField("branch_code", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("case_seq", T.LongType()),
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("event_seq", T.LongType()),
        T.StructField("reviewer", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("field_updates", T.MapType(T.StringType(), T.StringType())),
        T.StructField("reviewed_at", T.TimestampNTZType()),
    ]
)

BLOCK = T.StructType(
    [
        T.StructField("block_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.LongType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
        T.StructField("ocr_confidence", T.DoubleType()),
    ]
)

EVIDENCE = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("source_page", T.LongType()),
        T.StructField("bbox", T.ArrayType(T.LongType())),
        T.StructField("evidence_text", T.StringType()),
        T.StructField("image_crop_uri", T.StringType()),
    ]
)

# A field as the rules or a response report it, before it is checked.
RAW_FIELD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.LongType())),
        T.StructField("source_page", T.LongType()),
        T.StructField("evidence_bbox", T.ArrayType(T.LongType())),
        T.StructField("evidence_text", T.StringType()),
        T.StructField("extracted_by", T.StringType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("severity", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("field_key", T.StringType()),
    ]
)

# What a parsed response adds to its document.
PARSED = T.StructType(
    [
        T.StructField("outcome", T.StringType()),
        T.StructField("failure", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("fields", T.ArrayType(RAW_FIELD)),
        T.StructField("findings", T.ArrayType(FINDING)),
    ]
)

TEMPLATES = T.StructType(
    [
        T.StructField("document_type", T.StringType(), False),
        T.StructField("template_name", T.StringType(), False),
        T.StructField("field_seq", T.IntegerType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("required", T.BooleanType(), False),
        T.StructField("bbox", T.ArrayType(T.LongType()), False),
    ]
)

# Columns of every table of extracted fields, in order.
FIELD_COLUMNS = (
    "case_id",
    "document_id",
    "field_id",
    "event_seq",
    "field_seq",
    "key",
    "label",
    "value",
    "confidence",
    "required",
    "source",
    "validation_status",
    "validation_message",
    "bbox",
    "evidence",
    "extracted_by",
    "review_status",
)

# Columns of audit rows, in order.
AUDIT = (
    "target_id string, event_seq bigint, sub_seq int, action string, actor string, note string, "
    "metadata map<string,string>, created_at timestamp_ntz"
)
