"""Format checks of field values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import WHITESPACE_CLASS, strip


class FormatRule(NamedTuple):
    keys: tuple[str, ...]
    pattern: str
    failed_status: str
    failed_message: str
    document_type: str | None = None


# Formats, statuses and messages, tried in this order.
# \p{Nd} is any decimal digit, Devanagari included.
FORMAT_RULES = (
    FormatRule(
        ("mobile", "phone"),
        r"9\p{Nd}{9}",
        "invalid",
        "Mobile number must be 10 digits and start with 9",
    ),
    FormatRule(
        ("email",),
        rf"[^@{WHITESPACE_CLASS}]+@[^@{WHITESPACE_CLASS}]+\.[^@{WHITESPACE_CLASS}]+",
        "invalid",
        "Email address is not valid",
    ),
    FormatRule(("pan",), r"\p{Nd}{9}", "warning", "PAN should be 9 digits when provided"),
    FormatRule(
        ("citizenship_number", "cheque_number"),
        r"[A-Za-z0-9\-/]+",
        "invalid",
        "Identifier contains unsupported characters",
    ),
    FormatRule(
        ("dob", "date"),
        r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}",
        "warning",
        "Date should use YYYY-MM-DD",
    ),
    FormatRule(
        ("amount",),
        r"\p{Nd}+(\.\p{Nd}{1,2})?",
        "warning",
        "Amount should be numeric",
        document_type="cheque",
    ),
)
MISSING = ("missing", "Required value is missing")
PASSED = ("valid", "OK")


def _outcome(status: str, message: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))


def validate(key: Column, value: Column, document_type: Column) -> Column:
    """struct<status, message> for one field value."""
    text = strip(value)
    checks = F.when(F.coalesce(text, F.lit("")) == "", _outcome(*MISSING))
    for rule in FORMAT_RULES:
        applies = key.isin(*rule.keys)
        if rule.document_type is not None:
            applies = applies & (document_type == rule.document_type)
        failed = ~text.rlike(rf"\A(?:{rule.pattern})\z")
        checks = checks.when(
            applies & failed, _outcome(rule.failed_status, rule.failed_message)
        )
    return checks.otherwise(_outcome(*PASSED))
