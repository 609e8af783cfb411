"""The queries: every operator over the whole given tables, flattened to scalars."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import Inputs
from dossier.functions.scoring import overall_confidence, route
from dossier.functions.validation import validate
from dossier.operators import audit, cases, exports, intake, prompts, reviews, rule_table
from dossier.operators import blocks as ocr
from dossier.operators import responses as model
from dossier.operators import template_fields as by_template
from dossier.plans import processing
from dossier.plans.records import read_by_template
from dossier.session import checkpoint_root, configure, materialise
from dossier.sources.readers import named, read_audit, read_observations, read_responses
from dossier.sources.templates import template_lookup, templates, without_template
from dossier.sources.writers import append_audit
from dossier.streaming import reviews as review_stream
from dossier.streaming import uploads as upload_stream

MOMENT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
EXPORTED_AT = "2026-06-01 00:00:00"


class Flows(Inputs):
    """The two flows over the bound inputs; nothing runs before it is asked for."""

    @cached_property
    def templates(self) -> DataFrame:
        return templates(self.spark)

    @cached_property
    def cases(self) -> DataFrame:
        accepted, _ = intake.check_domain(self.requests, "case")
        return intake.create_cases(accepted)

    @cached_property
    def known_reviews(self) -> DataFrame:
        return self.case_reviews.join(self.cases.select("case_id"), "case_id", "left_semi")

    @cached_property
    def known_uploads(self) -> DataFrame:
        return self.uploads.join(self.cases.select("case_id"), "case_id", "left_semi")

    @cached_property
    def pages(self) -> DataFrame:
        return ocr.with_pages(named(self.uploads))

    @cached_property
    def documents(self) -> DataFrame:
        return processing.process_documents(self.uploads, self.cases, self.responses)

    @cached_property
    def stored_documents(self) -> DataFrame:
        """Processed documents written once, for queries that use them repeatedly."""
        return materialise(self.documents, "documents")

    @cached_property
    def stored_paged_documents(self) -> DataFrame:
        """The same with their pages, which exports contain."""
        paged = processing.process_documents(self.uploads, self.cases, self.responses, keep_pages=True)
        return materialise(paged, "documents")

    @cached_property
    def rule_documents(self) -> DataFrame:
        return processing.process_documents(self.uploads, self.cases)

    @cached_property
    def parsed(self) -> DataFrame:
        return model.parse_responses(model.latest_responses(self.responses))

    @cached_property
    def reviewed_fields(self) -> DataFrame:
        fields = processing.document_fields(self.stored_documents)
        return reviews.apply_case_reviews(fields, self.known_reviews)

    @cached_property
    def headers(self) -> DataFrame:
        return cases.case_headers(self.cases, self.known_uploads, self.known_reviews)

    @cached_property
    def case_audit(self) -> DataFrame:
        return audit.case_audit(self.cases, self.stored_documents, self.case_reviews)

    @cached_property
    def template_fields(self) -> DataFrame:
        return by_template.template_fields(self.records, self.observations, self.templates)

    @cached_property
    def template_run(self):
        return read_by_template(self.records, self.observations, self.templates)

    @cached_property
    def reviewed_records(self) -> DataFrame:
        return reviews.apply_document_decisions(self.template_run.records, self.known_record_reviews)

    @cached_property
    def known_record_reviews(self) -> DataFrame:
        served = self.records.join(
            self.templates.select("document_type"), "document_type", "left_semi"
        )
        return self.document_reviews.join(served.select("document_id"), "document_id", "left_semi")

    @cached_property
    def record_audit(self) -> DataFrame:
        served = self.records.join(
            self.templates.select("document_type"), "document_type", "left_semi"
        )
        return audit.document_audit(served, self.document_reviews, self.templates)


def _box(name: str):
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name.split(".")[-1])


def _moment(name: str):
    return F.date_format(name, MOMENT).alias(name.split(".")[-1])


def _flat_fields(fields: DataFrame, *more) -> DataFrame:
    return fields.select(
        "case_id",
        "document_id",
        "field_seq",
        "key",
        "label",
        "value",
        "confidence",
        "required",
        "source",
        "validation_status",
        "validation_message",
        _box("bbox"),
        F.col("evidence.source_page").alias("source_page"),
        F.col("evidence.evidence_text").alias("evidence_text"),
        "extracted_by",
        "review_status",
        *more,
    )


def _joined(items: str, render, separator: str = "|"):
    return F.array_join(F.transform(items, render), separator)


# --- scans ---------------------------------------------------------------------


def observation_scan(f: Flows) -> DataFrame:
    folder = f"{_stream_folder(f.spark)}/observations"
    f.observations.write.parquet(folder)
    return read_observations(f.spark, folder)


def response_scan(f: Flows) -> DataFrame:
    folder = f"{_stream_folder(f.spark)}/responses"
    f.responses.write.json(folder)
    return read_responses(f.spark, folder, "json")


def generated_ids(f: Flows) -> DataFrame:
    """Ids of cases that come without one."""
    accepted, _ = intake.check_domain(f.requests.withColumn("case_id", F.lit(None).cast("string")), "case")
    return intake.create_cases(accepted).select("case_seq", "case_id")


# --- uploads and blocks -------------------------------------------------------


def decode_uploads(f: Flows) -> DataFrame:
    return named(f.uploads).select(
        "document_id", ocr.decode(F.col("content"), F.col("filename")).alias("text")
    )


def ocr_blocks(f: Flows) -> DataFrame:
    return ocr.block_table(f.pages).withColumn("bbox", _box("bbox"))


def block_numbering(f: Flows) -> DataFrame:
    return (
        ocr.block_table(f.pages)
        .groupBy("document_id", "page_number")
        .agg(
            F.count(F.lit(1)).alias("blocks"),
            F.max("block_index").alias("last_index"),
            F.min_by("text", "block_index").alias("first_text"),
            F.max_by("text", "block_index").alias("last_text"),
        )
    )


def page_confidence(f: Flows) -> DataFrame:
    return ocr.page_table(f.pages).select(
        "document_id", "page_number", "width", "height", "ocr_confidence"
    )


def document_text(f: Flows) -> DataFrame:
    return f.pages.select("document_id", ocr.all_text(F.col("pages")).alias("text"))


def block_overlay(f: Flows) -> DataFrame:
    boxes = ocr.block_table(f.pages).select(
        "document_id",
        "block_index",
        ocr.overlay(F.col("bbox"), F.lit(ocr.PAGE_WIDTH), F.lit(ocr.PAGE_HEIGHT)).alias("box"),
    )
    return boxes.select(
        "document_id",
        "block_index",
        F.col("box.left").alias("box_left"),
        F.col("box.top").alias("box_top"),
        F.col("box.width").alias("box_width"),
        F.col("box.height").alias("box_height"),
    )


def infer_document_type(f: Flows) -> DataFrame:
    return processing.document_signals(f.uploads).select(
        "document_id", "declared_document_type", "inferred_type"
    )


def unknown_case_uploads(f: Flows) -> DataFrame:
    return processing.unknown_case(f.uploads, f.cases).select("document_id", "case_id")


# --- rules and model responses ------------------------------------------------


def rule_extraction(f: Flows) -> DataFrame:
    return _flat_fields(processing.document_fields(f.rule_documents)).filter(F.col("value") != "")


def rule_table_extraction(f: Flows) -> DataFrame:
    """The same by the rules as a table."""
    documents = processing.process_by_rule_table(f.uploads, f.cases, rule_table.rule_table(f.spark))
    return _flat_fields(processing.document_fields(documents))


def missing_name_fields(f: Flows) -> DataFrame:
    return _flat_fields(processing.document_fields(f.rule_documents)).filter(F.col("value") == "")


def clean_model_responses(f: Flows) -> DataFrame:
    return model.latest_responses(f.responses).select(
        "document_id", model.clean_response(F.col("content")).alias("cleaned")
    )


def parse_model_fields(f: Flows) -> DataFrame:
    return (
        model.model_fields(f.parsed)
        .withColumn("bbox", _box("bbox"))
        .withColumn("evidence_bbox", _box("evidence_bbox"))
    )


def parse_model_findings(f: Flows) -> DataFrame:
    return model.model_findings(f.parsed)


def parse_model_failures(f: Flows) -> DataFrame:
    return model.model_failures(f.parsed)


def extraction_outcome(f: Flows) -> DataFrame:
    return f.documents.select(
        "document_id",
        "case_id",
        "filename",
        "outcome",
        "document_type",
        "summary",
        "status",
        "page_count",
    )


def extracted_fields(f: Flows) -> DataFrame:
    return processing.document_fields(f.documents).select(
        "document_id", "field_seq", "key", "value", "confidence", "source"
    )


def finalize_fields(f: Flows) -> DataFrame:
    return _flat_fields(processing.document_fields(f.documents))


def document_findings(f: Flows) -> DataFrame:
    return processing.document_findings(f.documents).drop("event_seq")


def prompt_evidence(f: Flows) -> DataFrame:
    return f.pages.select("document_id", prompts.evidence_text(F.col("pages")).alias("evidence"))


def prompt_requests(f: Flows) -> DataFrame:
    # Only ids meet the cases; each document's text is then shuffled once, by its own id.
    case_types = f.uploads.select("document_id", "case_id").join(
        f.cases.select("case_id", "case_type"), "case_id"
    )
    documents = f.uploads.drop("case_id").join(case_types, "document_id")
    return prompts.prompt_requests(ocr.with_pages(named(documents)))


# --- templates ----------------------------------------------------------------


def template_catalog(f: Flows) -> DataFrame:
    return template_lookup(f.records, f.templates).select(
        "document_id", "template_name", "field_seq", "key", "label", "required", _box("bbox")
    )


def template_rejects(f: Flows) -> DataFrame:
    return without_template(f.records, f.templates).select("document_id", "document_type")


def validate_fields(f: Flows) -> DataFrame:
    typed = f.observations.join(f.records.select("document_id", "document_type"), "document_id")
    checked = typed.withColumn(
        "check", validate(F.col("field_key"), F.col("text"), F.col("document_type"))
    )
    return checked.select("document_id", "obs_seq", "field_key", "check.status", "check.message")


def latest_observation(f: Flows) -> DataFrame:
    return by_template.latest_observations(f.observations)


def template_extraction(f: Flows) -> DataFrame:
    return f.template_fields.withColumn("bbox", _box("bbox"))


def raw_text_fallback(f: Flows) -> DataFrame:
    return by_template.raw_text_fields(f.template_fields, f.observations).drop("bbox", "field_seq")


def overall_confidence_(f: Flows) -> DataFrame:
    """Over the raw observations: the lowest confidence of those not marked optional."""
    required = ~F.col("field_key").isin("father_mother_name", "pan", "email")
    return f.observations.groupBy("document_id").agg(
        overall_confidence(F.col("confidence"), required).alias("overall_confidence")
    )


def confidence_routing(f: Flows) -> DataFrame:
    return f.observations.select("document_id", "obs_seq", route(F.col("confidence")).alias("route"))


def document_records(f: Flows) -> DataFrame:
    return f.template_run.records.select(
        "document_id", "filename", "document_type", "status", "overall_confidence", _moment("created_at")
    )


# --- cases, reviews, exports --------------------------------------------------


def case_intake(f: Flows) -> DataFrame:
    return f.cases.withColumns(
        {name: F.date_format(name, MOMENT) for name in ("created_at", "updated_at")}
    )


def intake_rejects(f: Flows) -> DataFrame:
    _, rejected = intake.check_domain(f.requests, "case")
    return rejected.select("case_id", "reason")


def upload_rejects(f: Flows) -> DataFrame:
    declared = F.when(F.endswith("document_id", F.lit("7")), "memo").when(
        ~F.endswith("document_id", F.lit("8")), F.col("declared_document_type")
    )
    _, rejected = intake.check_domain(f.uploads.withColumn("declared_document_type", declared), "upload")
    return rejected.select("document_id", "reason")


def review_rejects(f: Flows) -> DataFrame:
    blanked = f.case_reviews.withColumns(
        {
            "reviewer": F.when(F.col("event_seq") % 14 != 1, F.col("reviewer")),
            "decision": F.when(F.col("event_seq") % 14 != 3, F.col("decision")),
        }
    )
    _, rejected = intake.check_domain(blanked, "review")
    return rejected.select("case_id", "event_seq", "reason")


def duplicate_responses(f: Flows) -> DataFrame:
    return model.repeated_responses(f.responses)


def _looked_up(rows: DataFrame, wanted: DataFrame, key: str, shown: str) -> DataFrame:
    found, missing = cases.lookup(rows, wanted, key)
    nothing = missing.select(key, F.lit(None).cast("string").alias(shown), F.lit(False).alias("found"))
    return found.select(key, shown, F.lit(True).alias("found")).unionByName(nothing)


def case_lookup(f: Flows) -> DataFrame:
    return _looked_up(f.cases, f.uploads.select("case_id").distinct(), "case_id", "applicant_name")


def document_lookup(f: Flows) -> DataFrame:
    wanted = f.document_reviews.select("document_id").distinct()
    return _looked_up(f.template_run.records, wanted, "document_id", "filename")


def list_documents(f: Flows) -> DataFrame:
    rows = cases.newest_first(f.template_run.records, "document_id")
    return rows.select("place", "document_id", "filename", _moment("created_at"))


def review_decisions(f: Flows) -> DataFrame:
    return reviews.review_decisions(f.case_reviews).select(
        "case_id", "event_seq", "decision", "status_after", "action"
    )


def case_review_fields(f: Flows) -> DataFrame:
    return _flat_fields(f.reviewed_fields, "event_seq")


def case_review_state(f: Flows) -> DataFrame:
    return reviews.review_state(f.known_reviews).withColumn("reviewed_at", _moment("reviewed_at"))


def case_status(f: Flows) -> DataFrame:
    return cases.current_status(f.cases, f.uploads, f.case_reviews).select(
        "case_id", "status", _moment("updated_at")
    )


def document_review_fields(f: Flows) -> DataFrame:
    return reviews.apply_document_reviews(f.template_run.fields, f.document_reviews).select(
        "document_id", "key", "value", "confidence", "source", "validation_status", "validation_message"
    )


def document_review_state(f: Flows) -> DataFrame:
    return f.reviewed_records.select(
        "document_id", "status", "overall_confidence", "reviewer", "note", _moment("reviewed_at")
    )


def case_export_fields(f: Flows) -> DataFrame:
    return exports.last_fields(f.reviewed_fields).select(
        "case_id",
        "key",
        "value",
        "confidence",
        F.col("evidence.source_page").alias("source_page"),
        F.col("evidence.evidence_text").alias("evidence_text"),
        F.col("evidence.document_id").alias("evidence_document_id"),
    )


def _pages(pages: str):
    """All pages of a document as one text: sizes, score, and every block."""

    def page(p):
        blocks = F.transform(
            p["blocks"],
            lambda b: F.concat_ws(
                ";", b["text"], F.array_join(b["bbox"].cast("array<string>"), ","),
                b["confidence"].cast("string"), b["block_type"], b["language"],
            ),
        )
        sizes = [p[name].cast("string") for name in ("page_number", "width", "height", "ocr_confidence")]
        return F.concat_ws("|", *sizes, F.array_join(blocks, "|"))

    return F.array_join(F.transform(pages, page), "#")


def _metadata(metadata: str):
    entries = F.array_sort(F.map_entries(metadata))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), "|"
    )


_HEADER = {name: f"header.{name}" for name in ("case_type", "integration_ref", "institution_id", "branch_code", "risk_level")}
_REVIEW = {"reviewer": "review.reviewer", "review_note": "review.note"}
_AUDIT = {"action": "audit_events.action", "actor": "audit_events.actor", "note": "audit_events.note"}
_DOCUMENT = {
    "id": "documents.id", "filename": "documents.filename", "summary": "documents.summary",
    "declared_document_type": "documents.declared_document_type",
    "document_type": "documents.document_type", "document_status": "documents.status",
}


def _flat_export(rows: DataFrame, owner: str, members: dict[str, str], *more) -> DataFrame:
    """Export rows with every member as a scalar column."""
    return rows.select(
        owner, "section", "event_seq", "sub_seq", "key",
        *[F.col(path).alias(name) for name, path in (members | _REVIEW | _AUDIT).items()],
        _metadata("audit_events.metadata").alias("metadata"),
        _moment("review.reviewed_at"),
        F.date_format("audit_events.created_at", MOMENT).alias("audit_at"),
        *more,
    )


def _evidence(field: str):
    return [
        F.col(f"{field}.evidence.document_id").alias("evidence_document_id"),
        F.col(f"{field}.evidence.source_page").alias("source_page"),
        F.array_join(F.col(f"{field}.evidence.bbox").cast("array<string>"), ",").alias("evidence_bbox"),
        F.col(f"{field}.evidence.evidence_text").alias("evidence_text"),
        F.col(f"{field}.evidence.image_crop_uri").alias("image_crop_uri"),
    ]


def _finding(finding: str):
    names = {"severity": "severity", "code": "code", "message": "message", "field_key": "field_key"}
    named = {"finding_document_id": "document_id"} | names
    return [F.col(f"{finding}.{member}").alias(name) for name, member in named.items()]


def _document():
    return [
        F.col("documents.page_count").cast("long").alias("page_count"),
        _moment("documents.created_at"),
        _moment("documents.updated_at"),
    ]


def case_export(f: Flows) -> DataFrame:
    documents = f.stored_paged_documents
    exported = exports.export_cases(
        f.headers,
        documents,
        f.reviewed_fields,
        processing.document_findings(documents),
        f.case_audit,
        F.lit(EXPORTED_AT).cast("timestamp_ntz"),
    )
    members = _HEADER | _DOCUMENT | {"status": "header.status", "value": "fields.value", "confidence": "fields.confidence"}
    return _flat_export(
        exported, "case_id", members, *_evidence("fields"), *_finding("findings"), *_document(),
        _pages("documents.pages").alias("pages"),
    )


def case_assembly(f: Flows) -> DataFrame:
    assembled = exports.assemble_cases(
        f.headers,
        f.stored_documents,
        f.reviewed_fields,
        processing.document_findings(f.stored_documents),
        f.case_audit,
    )
    field = "extracted_fields"
    names = ("label", "value", "confidence", "required", "source", "validation_status", "validation_message")
    names += ("extracted_by", "review_status")
    members = _HEADER | _DOCUMENT | {name: f"{field}.{name}" for name in names}
    members |= {"status": "header.status", "applicant_name": "header.applicant_name"}
    members |= {"field_document_id": f"{field}.document_id"}
    return _flat_export(
        assembled, "case_id", members, *_evidence(field), *_finding("validation_findings"), *_document(),
        F.array_join(F.col(f"{field}.bbox").cast("array<string>"), ",").alias("bbox"),
        F.date_format("header.created_at", MOMENT).alias("case_created_at"),
        F.date_format("header.updated_at", MOMENT).alias("case_updated_at"),
    )


def document_export(f: Flows) -> DataFrame:
    fields = reviews.apply_document_reviews(f.template_run.fields, f.known_record_reviews)
    exported = exports.export_documents(f.reviewed_records, fields, f.record_audit)
    members = {name: f"header.{name}" for name in ("document_type", "status", "overall_confidence")}
    names = ("value", "confidence", "validation_status", "validation_message")
    return _flat_export(exported, "document_id", members | {name: f"fields.{name}" for name in names})


def _flat_audit(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select(
        "target_id",
        "event_seq",
        "sub_seq",
        "action",
        "actor",
        "note",
        _moment("created_at"),
        *[F.element_at("metadata", F.lit(name)).alias(name) for name in names],
    )


def audit_trail(f: Flows) -> DataFrame:
    rows = audit.case_audit(f.cases, f.stored_documents, f.case_reviews)
    return _flat_audit(
        rows,
        "customer_ref",
        "stored_path",
        "declared_document_type",
        "document_id",
        "document_type",
    )


def document_audit_trail(f: Flows) -> DataFrame:
    return _flat_audit(f.record_audit)


def audit_readback(f: Flows) -> DataFrame:
    """Two runs' rows appended, then read back in order."""
    path = _stream_folder(f.spark)
    append_audit(f.record_audit.filter("event_seq < 0"), path, "uploads")
    append_audit(f.record_audit.filter("event_seq >= 0"), path, "reviews")
    rows = read_audit(f.spark, path)
    return rows.select("place", "target_id", "event_seq", "sub_seq", "action", "actor", "note", _moment("created_at"))


# --- listings and figures -----------------------------------------------------


def case_metrics(f: Flows) -> DataFrame:
    status = cases.current_status(f.cases, f.uploads, f.case_reviews)
    return cases.case_metrics(status, f.uploads)


def documents_per_case(f: Flows) -> DataFrame:
    return cases.documents_per_case(f.cases, f.uploads).select("case_id", "documents")


def list_cases(f: Flows) -> DataFrame:
    return cases.newest_first(f.cases, "case_seq").select("place", "case_id", _moment("created_at"))


def selected_case(f: Flows) -> DataFrame:
    return cases.selected_case(f.cases).select("case_id", "applicant_name")


def first_document_page(f: Flows) -> DataFrame:
    return cases.first_document_page(f.pages)


def case_cards(f: Flows) -> DataFrame:
    headers = f.cases.drop("status", "updated_at").join(
        cases.current_status(f.cases, f.uploads, f.case_reviews), "case_id"
    )
    return cases.case_cards(headers)


def field_cards(f: Flows) -> DataFrame:
    fields = processing.document_fields(f.documents)
    placed = F.concat_ws("/", "document_id", F.col("field_seq").cast("string"))
    return cases.field_cards(fields.withColumn("field_id", placed))


# --- streams ------------------------------------------------------------------


def _stream_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _arriving(table: DataFrame, folder: str) -> DataFrame:
    """The table laid down as files and read back as a stream."""
    table.write.parquet(f"{folder}/arriving")
    return (
        table.sparkSession.readStream.schema(table.schema)
        .option("maxFilesPerTrigger", 4)
        .parquet(f"{folder}/arriving")
    )


def stream_blocks(f: Flows) -> DataFrame:
    folder = _stream_folder(f.spark)
    arriving = named(_arriving(f.uploads, folder))
    upload_stream.stream_blocks(arriving, f"{folder}/blocks", f"{folder}/state").awaitTermination()
    return f.spark.read.parquet(f"{folder}/blocks").withColumn("bbox", _box("bbox"))


def stream_fields(f: Flows) -> DataFrame:
    folder = _stream_folder(f.spark)
    upload_stream.stream_documents(
        _arriving(f.uploads, folder), f.cases, folder, f"{folder}/state", f.responses
    ).awaitTermination()
    return _flat_fields(upload_stream.streamed(f.spark, folder, "fields"))


def stream_late_responses(f: Flows) -> DataFrame:
    """Answers 0 to 120 minutes after their upload, of which 60 are waited for."""
    folder = _stream_folder(f.spark)
    at = F.col("uploaded_at").cast("timestamp")
    asked = f.uploads.select("document_id", at.alias("asked_at"))
    lag = F.pmod(F.xxhash64("document_id"), F.lit(7)) * 20
    answers = f.responses.join(asked, "document_id").withColumn(
        "responded_at", F.col("asked_at") + F.make_interval(mins=lag.cast("int"))
    ).drop("asked_at")
    # The last event moves both watermarks past everything; its case is unknown.
    end = F.lit("2034-01-01 00:00:00")
    last_upload = f.uploads.limit(1).withColumns(
        {"document_id": F.lit("end"), "case_id": F.lit("end"), "uploaded_at": end.cast("timestamp_ntz")}
    )
    last_answer = answers.limit(1).withColumns({"document_id": F.lit("end"), "responded_at": end.cast("timestamp")})
    uploads = _in_time(f.uploads, last_upload, "uploaded_at", folder, "uploads")
    answers = _in_time(answers, last_answer, "responded_at", folder, "answers")
    upload_stream.stream_answered_documents(
        uploads, answers, f.cases, folder, f"{folder}/state", wait="60 minutes"
    ).awaitTermination()
    return _flat_fields(upload_stream.corrected(f.spark, folder, "fields"))


def _in_time(table: DataFrame, last: DataFrame, at: str, folder: str, name: str) -> DataFrame:
    """The table as a stream in order of time, in two files, and then ``last``."""
    table.repartitionByRange(2, at).write.parquet(f"{folder}/{name}")
    last.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    files = table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    return files.parquet(f"{folder}/{name}")


def stream_chain(f: Flows) -> DataFrame:
    """Uploads, reviews, uploads, reviews: half of each at a time, whatever their order."""
    folder = _stream_folder(f.spark)
    fields = f"{folder}/uploaded/fields"
    early = F.pmod(F.xxhash64("document_id"), F.lit(2)) == 0
    for first in (True, False):
        for rows, name in ((f.uploads, "uploads"), (f.known_reviews, "reviews")):
            half = early if name == "uploads" else F.pmod(F.xxhash64("event_seq"), F.lit(2)) == 0
            rows.filter(half == first).write.mode("append").parquet(f"{folder}/{name}")
        uploads, found = (
            f.spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}")
            for rows, name in ((f.uploads, "uploads"), (f.known_reviews, "reviews"))
        )
        upload_stream.stream_documents(
            uploads, f.cases, f"{folder}/uploaded", f"{folder}/state-of-uploads", f.responses
        ).awaitTermination()
        review_stream.stream_reviews(
            found, fields, f"{folder}/reviewed", f"{folder}/state-of-reviews", tables=("changes",)
        ).awaitTermination()
    streamed = upload_stream.streamed(f.spark, f"{folder}/uploaded", "fields")
    return _flat_fields(review_stream.reviewed_fields(f.spark, streamed, f"{folder}/reviewed"), "event_seq")


def stream_findings(f: Flows) -> DataFrame:
    folder = _stream_folder(f.spark)
    upload_stream.stream_documents(
        _arriving(f.uploads, folder), f.cases, folder, f"{folder}/state", f.responses
    ).awaitTermination()
    return upload_stream.streamed(f.spark, folder, "findings").drop("event_seq")


def _reviewed(f: Flows, *tables: str) -> tuple[str, DataFrame]:
    """Folder of a stream of reviews that keeps these tables, and the fields it began with."""
    folder = _stream_folder(f.spark)
    fields = materialise(processing.document_fields(f.documents), "fields") if "changes" in tables else None
    review_stream.stream_reviews(
        _arriving(f.known_reviews, folder), fields, folder, f"{folder}/state-of-query", tables=tables
    ).awaitTermination()
    return folder, fields


def stream_reviews(f: Flows) -> DataFrame:
    folder, fields = _reviewed(f, "changes")
    return _flat_fields(review_stream.reviewed_fields(f.spark, fields, folder), "event_seq")


def stream_status(f: Flows) -> DataFrame:
    state = review_stream.last_decisions(f.spark, _reviewed(f, "decisions")[0])
    return state.select("case_id", "reviewer", "note", _moment("reviewed_at"), "status_after")


def stream_audit(f: Flows) -> DataFrame:
    return _flat_audit(review_stream.review_audit(f.spark, _reviewed(f, "audit")[0]))


def stream_document_reviews(f: Flows) -> DataFrame:
    folder = _stream_folder(f.spark)
    fields = materialise(f.template_run.fields, "fields")
    arriving = _arriving(f.document_reviews, folder)
    review_stream.stream_reviews(
        arriving, fields, folder, f"{folder}/state-of-query", target="document_id", tables=("changes",)
    ).awaitTermination()
    return review_stream.reviewed_fields(f.spark, fields, folder, "document_id").select(
        "document_id", "key", "value", "confidence", "source", "validation_status", "validation_message"
    )


QUERIES = {
    "observation_scan": observation_scan,
    "response_scan": response_scan,
    "generated_ids": generated_ids,
    "decode_uploads": decode_uploads,
    "ocr_blocks": ocr_blocks,
    "block_numbering": block_numbering,
    "page_confidence": page_confidence,
    "document_text": document_text,
    "block_overlay": block_overlay,
    "infer_document_type": infer_document_type,
    "unknown_case_uploads": unknown_case_uploads,
    "rule_extraction": rule_extraction,
    "rule_table_extraction": rule_table_extraction,
    "missing_name_fields": missing_name_fields,
    "duplicate_responses": duplicate_responses,
    "clean_model_responses": clean_model_responses,
    "parse_model_fields": parse_model_fields,
    "parse_model_findings": parse_model_findings,
    "parse_model_failures": parse_model_failures,
    "extraction_outcome": extraction_outcome,
    "extracted_fields": extracted_fields,
    "finalize_fields": finalize_fields,
    "document_findings": document_findings,
    "prompt_evidence": prompt_evidence,
    "prompt_requests": prompt_requests,
    "template_catalog": template_catalog,
    "template_rejects": template_rejects,
    "validate_fields": validate_fields,
    "latest_observation": latest_observation,
    "template_extraction": template_extraction,
    "raw_text_fallback": raw_text_fallback,
    "overall_confidence": overall_confidence_,
    "confidence_routing": confidence_routing,
    "document_records": document_records,
    "case_intake": case_intake,
    "intake_rejects": intake_rejects,
    "upload_rejects": upload_rejects,
    "review_rejects": review_rejects,
    "case_lookup": case_lookup,
    "document_lookup": document_lookup,
    "list_documents": list_documents,
    "review_decisions": review_decisions,
    "case_review_fields": case_review_fields,
    "case_review_state": case_review_state,
    "case_status": case_status,
    "document_review_fields": document_review_fields,
    "document_review_state": document_review_state,
    "case_export_fields": case_export_fields,
    "case_export": case_export,
    "case_assembly": case_assembly,
    "document_export": document_export,
    "audit_trail": audit_trail,
    "document_audit_trail": document_audit_trail,
    "audit_readback": audit_readback,
    "case_metrics": case_metrics,
    "documents_per_case": documents_per_case,
    "list_cases": list_cases,
    "selected_case": selected_case,
    "first_document_page": first_document_page,
    "case_cards": case_cards,
    "field_cards": field_cards,
    "stream_blocks": stream_blocks,
    "stream_fields": stream_fields,
    "stream_findings": stream_findings,
    "stream_late_responses": stream_late_responses,
    "stream_chain": stream_chain,
    "stream_reviews": stream_reviews,
    "stream_status": stream_status,
    "stream_audit": stream_audit,
    "stream_document_reviews": stream_document_reviews,
}


def _bound(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(Flows(configure(spark), sf_dir))

    return run


def queries() -> dict:
    return {name: _bound(query) for name, query in QUERIES.items()}
