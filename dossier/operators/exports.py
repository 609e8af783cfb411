"""Cases and exports as rows.

An export is one table with a row per item: the header, a field, a finding, a
document with its pages, the review, an audit row. A row has the id it belongs to,
its section, its place in the timeline, and one filled struct named after the
section; ``with_payload`` turns that struct into JSON. The table looks the same for
a case of three events and of three million, and nothing is collected by case.

``nested_cases`` and ``nested_documents`` give the nested form for the ids a caller
names, as a request for one export does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators import audit as audit_rows
from dossier.operators.audit import FIRST_EVENT

JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}
PLACE = ["section", "event_seq", "sub_seq", "key"]

FIELD_MEMBERS = [
    "field_id",
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
    "document_id",
]
EXPORTED_FIELD_MEMBERS = ["key", "value", "confidence", "evidence"]
RECORD_FIELD_MEMBERS = ["key", "value", "confidence", "validation_status", "validation_message"]
FINDING_MEMBERS = ["severity", "code", "message", "field_key", "document_id"]
DOCUMENT_MEMBERS = [
    "filename",
    "declared_document_type",
    "document_type",
    "status",
    "page_count",
    "summary",
    "created_at",
    "updated_at",
]
AUDIT_MEMBERS = ["action", "actor", "note", "metadata", "created_at"]
REVIEW_MEMBERS = ["reviewer", "note", "reviewed_at"]
EXPORTED_HEADER_MEMBERS = [
    "case_type",
    "integration_ref",
    "institution_id",
    "branch_code",
    "status",
    "risk_level",
]
HEADER_MEMBERS = [*EXPORTED_HEADER_MEMBERS, "applicant_name", "created_at", "updated_at"]
RECORD_HEADER_MEMBERS = ["document_type", "status", "overall_confidence"]


def last_fields(fields: DataFrame, key: str = "case_id") -> DataFrame:
    """The last field per key; earlier ones with the same key are not exported."""
    kept = [name for name in fields.columns if name not in (key, "key")]
    order = [name for name in ("event_seq", "document_id", "field_seq") if name in kept]
    last = F.max_by(F.struct(*kept), F.struct(*order))
    return fields.groupBy(key, "key").agg(last.alias("last")).select(key, "key", "last.*")


def _section(
    rows: DataFrame, owner: str, name: str, places: tuple[Column, Column], key: Column, members: list
) -> DataFrame:
    event_seq, sub_seq = places
    return rows.select(
        owner,
        F.lit(name).alias("section"),
        F.coalesce(event_seq, F.lit(FIRST_EVENT)).cast("long").alias("event_seq"),
        sub_seq.cast("long").alias("sub_seq"),
        key.alias("key"),
        F.struct(*members).alias(name),
    )


def _union(sections: list[DataFrame]) -> DataFrame:
    first, *others = sections
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def _single(rows: DataFrame, owner: str, name: str, members: list[str]) -> DataFrame:
    """A section with one row per owner."""
    place = F.lit(FIRST_EVENT), F.lit(0)
    return _section(rows, owner, name, place, F.lit(None).cast("string"), members)


def _fields(fields: DataFrame, owner: str, name: str, members: list[str]) -> DataFrame:
    event_seq = F.col("event_seq") if "event_seq" in fields.columns else F.lit(FIRST_EVENT)
    return _section(fields, owner, name, (event_seq, F.col("field_seq")), F.col("key"), members)


def _findings(findings: DataFrame, name: str) -> DataFrame:
    place = F.col("event_seq"), F.col("finding_seq")
    return _section(findings, "case_id", name, place, F.col("code"), FINDING_MEMBERS)


def _documents(documents: DataFrame) -> DataFrame:
    members = [F.col("document_id").alias("id"), *DOCUMENT_MEMBERS]
    members += ["pages"] if "pages" in documents.columns else []
    place = F.col("event_seq"), F.lit(0)
    return _section(documents, "case_id", "documents", place, F.col("document_id"), members)


def _audit(audit: DataFrame, owner: str) -> DataFrame:
    named = audit.withColumnRenamed("target_id", owner)
    place = F.col("event_seq"), F.col("sub_seq")
    return _section(named, owner, "audit_events", place, F.col("action"), AUDIT_MEMBERS)


def assemble_cases(
    headers: DataFrame, documents: DataFrame, fields: DataFrame, findings: DataFrame, audit: DataFrame
) -> DataFrame:
    """Every item of every case: all its fields, not the last of each key only."""
    return _union(
        [
            _single(headers, "case_id", "header", HEADER_MEMBERS),
            _single(headers, "case_id", "review", REVIEW_MEMBERS),
            _documents(documents),
            _fields(fields, "case_id", "extracted_fields", FIELD_MEMBERS),
            _findings(findings, "validation_findings"),
            _audit(audit, "case_id"),
        ]
    )


def export_cases(
    headers: DataFrame,
    documents: DataFrame,
    fields: DataFrame,
    findings: DataFrame,
    audit: DataFrame,
    exported_at: Column,
) -> DataFrame:
    """The export of every case, this export's audit row included.

    That row is part of the export only; appending it to the audit table is a
    write of its own (``audit.exported`` and ``append_audit``).
    """
    with_export = audit.unionByName(audit_rows.exported(headers, exported_at))
    return _union(
        [
            _single(headers, "case_id", "header", EXPORTED_HEADER_MEMBERS),
            _single(headers, "case_id", "review", REVIEW_MEMBERS),
            _documents(documents),
            _fields(last_fields(fields), "case_id", "fields", EXPORTED_FIELD_MEMBERS),
            _findings(findings, "findings"),
            _audit(with_export, "case_id"),
        ]
    )


def export_documents(records: DataFrame, fields: DataFrame, audit: DataFrame) -> DataFrame:
    """The export of every document read by template; no audit row is written for it.

    ``records`` are reviewed records.
    """
    return _union(
        [
            _single(records, "document_id", "header", RECORD_HEADER_MEMBERS),
            _single(records, "document_id", "review", REVIEW_MEMBERS),
            _fields(last_fields(fields, "document_id"), "document_id", "fields", RECORD_FIELD_MEMBERS),
            _audit(audit, "document_id"),
        ]
    )


def _sections(rows: DataFrame) -> list[str]:
    return [name for name in rows.columns[1:] if name not in PLACE]


def with_payload(rows: DataFrame) -> DataFrame:
    """The owner's id, the place, and the filled section as JSON."""
    payloads = [F.to_json(name, JSON_OPTIONS) for name in _sections(rows)]
    return rows.select(rows.columns[0], *PLACE, F.coalesce(*payloads).alias("payload"))


def _lists(rows: DataFrame, ids: Sequence[str], single: tuple[str, ...]) -> DataFrame:
    owner = rows.columns[0]
    named = rows.filter(F.col(owner).isin(list(ids)))
    collected = []
    for name in _sections(rows):
        if name in single:
            collected.append(F.first(name, ignorenulls=True).alias(name))
            continue
        # Maps cannot be sorted, so the items are placed by number.
        placed = F.struct("event_seq", "sub_seq", F.coalesce("key", F.lit("")).alias("key"))
        items = F.collect_list(F.when(F.col(name).isNotNull(), F.struct(placed.alias("at"), F.col(name).alias("item"))))
        ordered = F.array_sort(items, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
        collected.append(F.transform(ordered, lambda x: x["item"]).alias(name))
    return named.groupBy(owner).agg(*collected)


def _map(name: str, value) -> Column:
    entries = F.transform(name, lambda item: F.struct(item["key"].alias("key"), value(item).alias("value")))
    return F.map_from_entries(entries)


def nested_cases(rows: DataFrame, case_ids: Sequence[str]) -> DataFrame:
    """The named cases' exports, one nested row each."""
    return _lists(rows, case_ids, ("header", "review")).select(
        "case_id",
        "header.*",
        _map("fields", lambda item: item["value"]).alias("fields"),
        _map("fields", lambda item: item["confidence"]).alias("confidence"),
        _map("fields", lambda item: item["evidence"]).alias("evidence"),
        "findings",
        "documents",
        "review",
        "audit_events",
    )


def nested_documents(rows: DataFrame, document_ids: Sequence[str]) -> DataFrame:
    """The named template documents' exports, one nested row each."""

    def verdict(item: Column) -> Column:
        return F.struct(
            item["validation_status"].alias("status"), item["validation_message"].alias("message")
        )

    return _lists(rows, document_ids, ("header", "review")).select(
        "document_id",
        "header.*",
        _map("fields", lambda item: item["value"]).alias("fields"),
        _map("fields", lambda item: item["confidence"]).alias("confidence"),
        _map("fields", verdict).alias("validation"),
        "review",
        "audit_events",
    )
