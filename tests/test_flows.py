"""The flows end to end, with the inputs and results the behaviour is pinned by."""

import json
import re
from datetime import datetime

from pyspark.sql import functions as F

from dossier.operators import audit, cases, exports, intake, reviews
from dossier.plans.processing import (
    document_fields,
    document_findings,
    process_documents,
    unknown_case,
)
from dossier.plans.records import read_by_template
from dossier.schemas import CASE_REQUESTS, OBSERVATIONS, RESPONSES, REVIEWS, UPLOADS
from dossier.sources.readers import (
    read_case_requests,
    read_observations,
    read_responses,
    read_reviews,
    audit_rows,
    read_audit,
    read_uploads,
)
from dossier.functions.order import in_order
from dossier.session import discard, exists, materialise
from dossier.sources.templates import templates
from dossier.sources.writers import append_audit, clustered_files, read_clustered, write_clustered, write_exports

T0 = datetime(2026, 5, 27, 10, 0, 0, 123456)

# Observations whose results are pinned; the cheque is a sample of our own.
SEEN = {
    "citizenship": [
        ("name", "Sita Sharma", 0.96), ("dob", "1992-04-13", 0.92), ("citizenship_number", "27-01-78-12345", 0.91),
        ("address", "Kathmandu-10", 0.93), ("father_mother_name", "Hari Sharma", 0.84),
    ],
    "account_opening": [
        ("customer_name", "Sita Sharma", 0.94), ("mobile", "98410O0000", 0.77), ("address", "Kathmandu-10", 0.91),
        ("account_type", "Savings", 0.93), ("pan", "123456789", 0.89), ("email", "sita.sharma at example.com", 0.62),
    ],
    "cheque": [
        ("cheque_number", "77310", 0.97), ("date", "2025-11-02", 0.91), ("amount", "310.50", 0.88),
        ("payee", "Ram Thapa", 0.84),
    ],
}


def _records(spark, seen, types=None):
    rows = [(name, f"{name}.png", (types or {}).get(name, name), T0) for name in seen]
    documents = spark.createDataFrame(
        rows, "document_id string, filename string, document_type string, created_at timestamp_ntz"
    )
    observed = [
        (name, seq, key, text, confidence)
        for name, found in seen.items()
        for seq, (key, text, confidence) in enumerate(found)
    ]
    return documents, spark.createDataFrame(observed, OBSERVATIONS)


def test_template_flow(spark):
    seen = SEEN | {"passport": []}
    documents, observations = _records(spark, seen)
    run = read_by_template(documents, observations)
    got = {r.document_id: (r.status, r.overall_confidence) for r in run.records.collect()}
    assert got == {
        "citizenship": ("review_required", 0.91),
        "account_opening": ("manual_entry", 0.77),
        "cheque": ("review_required", 0.84),
    }
    fields = {(r.document_id, r.key): r for r in run.fields.collect()}
    assert fields["citizenship", "name"].value == "Sita Sharma"
    assert fields["citizenship", "citizenship_number"].validation_status == "valid"
    assert fields["account_opening", "email"].validation_status == "invalid"
    assert [r.document_id for r in run.rejected.collect()] == ["passport"]
    rows = audit.document_audit(
        run.records, spark.createDataFrame([], REVIEWS).withColumnRenamed("case_id", "document_id"), templates(spark)
    )
    actions = [
        r.action for r in rows.filter("target_id = 'citizenship'").orderBy("event_seq", "sub_seq").collect()
    ]
    assert actions == ["document_uploaded", "ocr_completed"]


def test_last_observation_and_raw_text(spark):
    seen = {
        "twice": [("amount", "1", 0.5), ("payee", "x", 0.9), ("amount", "2", 0.875)],
        "unmapped": [("raw_text", "line one", 0.5), (None, "line two", 0.5)],
        "blank": [("memo", "", 0.5), ("memo", "", 0.5)],
        "nothing": [("memo", "", 0.5)],
    }
    documents, observations = _records(spark, seen, dict.fromkeys(seen, "cheque"))
    fields = {(r.document_id, r.key): r for r in read_by_template(documents, observations).fields.collect()}
    assert (fields["twice", "amount"].value, fields["twice", "amount"].confidence) == ("2", round(0.875, 2))
    assert fields["twice", "date"].validation_status == "missing"
    raw = fields["unmapped", "raw_text"]
    assert (raw.value, raw.confidence, raw.required, raw.source) == ("line one\nline two", 0.5, False, "ocr")
    assert fields["blank", "raw_text"].value == "\n"
    assert ("nothing", "raw_text") not in fields and ("twice", "raw_text") not in fields


def test_document_review_and_export(spark):
    documents, observations = _records(spark, {"account_opening": SEEN["account_opening"]})
    run = read_by_template(documents, observations)
    found = spark.createDataFrame(
        [
            ("account_opening", 4, "pilot.officer", "approve", "Verified against source form.",
             {"mobile": "9841000000", "email": "sita.sharma@example.com", "no_such": "x"}, T0),
        ],
        REVIEWS,
    ).withColumnRenamed("case_id", "document_id")
    fields = reviews.apply_document_reviews(run.fields, found)
    records = reviews.apply_document_decisions(run.records, found)
    rows = audit.document_audit(run.records, found, templates(spark))
    exported = exports.export_documents(records, fields, rows)
    (text,) = exports.nested_documents(exported, ["account_opening", "other"]).toJSON().collect()
    exported = json.loads(text)
    assert (exported["status"], exported["overall_confidence"]) == ("approved", 0.77)
    assert exported["fields"]["mobile"] == "9841000000" and exported["confidence"]["mobile"] == 1.0
    assert exported["validation"]["email"] == {"status": "valid", "message": "OK"}
    assert "no_such" not in exported["fields"]
    assert exported["review"]["reviewer"] == "pilot.officer"
    assert [e["action"] for e in exported["audit_events"]][-1] == "review_approved"


def _case_tables(spark):
    requests = spark.createDataFrame(
        [
            ("c1", "individual_kyc", "Sita Sharma", "CBS-1001", "demo-bank", "KTM-001", T0, 1),
            ("c2", None, "Hari", None, None, None, T0, 2),
            ("c3", "retail", "x", None, None, None, T0, 3),
            ("c4", None, None, None, None, None, T0, 4),
        ],
        CASE_REQUESTS,
    )
    uploads = spark.createDataFrame(
        [
            ("c1", "d1", "citizenship.txt", bytearray(b"Name: Sita Sharma\nCitizenship No: 27-01-78-12345"), "citizenship", T0, 10),
            ("c2", "d2", "", bytearray(b"\x80\xff"), "unknown", T0, 11),
            ("c2", "d3", "x", bytearray(b"a cheque"), "unknown", T0, 12),
            ("c9", "d4", "x", bytearray(b"lost"), "unknown", T0, 13),
        ],
        UPLOADS,
    )
    found = spark.createDataFrame(
        [
            ("c1", 20, "checker.one", "approve", "Verified with source document.", {"mobile": "9841000000"}, T0),
            ("c2", 5, "checker.two", "approve", "early", {}, T0),
        ],
        REVIEWS,
    )
    return requests, uploads, found


def test_case_flow(spark, tmp_path):
    requests, uploads, found = _case_tables(spark)
    accepted, rejected = intake.check_domain(requests, "case")
    assert {r.case_id: r.reason for r in rejected.collect()} == {
        "c3": "case_type is not allowed", "c4": "applicant_name is required"
    }
    known = intake.create_cases(accepted)
    c2 = known.filter("case_id = 'c2'").first()
    bare = requests.filter("case_seq = 1").withColumn("case_id", F.lit(None).cast("string"))
    ids = [intake.create_cases(bare).first().case_id for _ in range(2)]
    assert ids[0] == ids[1] and ids[0].startswith("case_") and len(ids[0]) == 21
    assert (c2.case_type, c2.institution_id, c2.risk_level, c2.status) == ("individual_kyc", "demo-institution", "medium", "created")
    assert [r.document_id for r in unknown_case(uploads, known).collect()] == ["d4"]

    documents = process_documents(uploads, known, keep_pages=True)
    fields = {(r.document_id, r.key): r for r in document_fields(documents).collect()}
    assert set(fields) == {("d1", "full_name"), ("d1", "citizenship_number"), ("d2", "full_name"), ("d3", "full_name")}
    assert fields["d1", "full_name"].value == "Sita Sharma" and fields["d1", "full_name"].evidence.source_page == 1
    assert fields["d2", "full_name"].validation_status == "missing" and fields["d2", "full_name"].confidence == 0.2
    assert fields["d1", "full_name"].bbox == [80, 100, 920, 134]

    after = reviews.apply_case_reviews(document_fields(documents), found)
    headers = cases.case_headers(known, uploads, found)
    rows = audit.case_audit(known, documents, found)
    at = F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")
    exported = exports.export_cases(headers, documents, after, document_findings(documents), rows, at)
    write_exports(exports.nested_cases(exported, ["c1", "c2", "c9"]), str(tmp_path / "exports"))
    lines = spark.read.text(str(tmp_path / "exports")).collect()
    payload = {p["case_id"]: p for p in (json.loads(line.value) for line in lines)}
    assert set(payload) == {"c1", "c2"}
    c1, c2 = payload["c1"], payload["c2"]
    assert (c1["status"], c1["integration_ref"], c1["fields"]["mobile"]) == ("approved", "CBS-1001", "9841000000")
    assert c1["evidence"]["full_name"]["source_page"] == 1 and c1["review"]["reviewer"] == "checker.one"
    assert [e["action"] for e in c1["audit_events"]] == [
        "case_created", "document_uploaded", "document_processed", "case_approved", "export_generated"
    ]
    assert c1["audit_events"][0]["metadata"] == {"customer_ref": "CBS-1001"}
    assert c1["documents"][0]["pages"][0]["blocks"][0]["bbox"] == [80, 100, 920, 134]
    # An upload after the approval reopens the case; null members are present.
    assert c2["status"] == "review_required" and c2["branch_code"] is None
    assert c2["documents"][0]["filename"] == "20260527100000123456-"
    assert "20260527100000123456-. Full OCR" in c2["documents"][0]["pages"][0]["blocks"][0]["text"]
    assert c2["fields"] == {"full_name": ""} and c2["evidence"]["full_name"]["document_id"] == "d3"

    assert c1["documents"][0]["id"] == "d1"
    payloads = exports.with_payload(exported).filter("case_id = 'c1'").orderBy("section", "event_seq", "sub_seq")
    sections = [(r.section, json.loads(r.payload)) for r in payloads.collect()]
    assert [name for name, _ in sections] == ["audit_events"] * 5 + ["documents"] + ["fields"] * 3 + [
        "findings", "header", "review"
    ]
    assert dict(sections)["header"]["branch_code"] == "KTM-001"

    # A run that is repeated replaces its own rows.
    for _ in range(2):
        append_audit(rows, str(tmp_path / "audit"), "run-1")
    append_audit(audit.exported(headers, at), str(tmp_path / "audit"), "run-2")
    assert spark.read.parquet(str(tmp_path / "audit")).count() == rows.count() + 2

    back = read_audit(spark, str(tmp_path / "audit")).orderBy("place").collect()
    assert [r.place for r in back] == list(range(1, rows.count() + 3))
    times = [(r.created_at, r.target_id, r.event_seq, r.sub_seq) for r in back]
    assert times == sorted(times) and back[-1].action == "export_generated"
    days = sorted({r.day for r in back})
    some = read_audit(spark, str(tmp_path / "audit"), since=str(days[0]), until=str(days[0]), run_ids=["run-1"])
    assert {(r.day, r.run_id) for r in some.collect()} == {(days[0], "run-1")}
    mine = read_audit(spark, str(tmp_path / "audit"), targets=rows.filter("target_id = 'c2'").select("target_id"))
    assert {r.target_id for r in mine.collect()} == {"c2"}


def test_audit_scan_is_pruned(spark, tmp_path):
    at = F.lit("2026-05-27 10:00:00").cast("timestamp_ntz")
    created = spark.createDataFrame([("c", "loan_onboarding", "ref")], "case_id string, case_type string, integration_ref string")
    for run, days in (("a", 0), ("b", 1)):
        append_audit(audit.case_created(created.withColumn("created_at", at + F.expr(f"INTERVAL {days} DAYS"))), str(tmp_path), run)
    scanned = audit_rows(spark, str(tmp_path), since="2026-05-28", run_ids=["b"])
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "day#" in filters and "run_id#" in filters
    assert [r.run_id for r in scanned.collect()] == ["b"]


def test_one_case_is_in_few_files(spark, tmp_path):
    rows = spark.range(4000).select(
        F.format_string("case%03d", F.col("id") % 200).alias("case_id"), F.col("id").alias("event_seq")
    )
    path = str(tmp_path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    write_clustered(rows.unionByName(spark.range(3000).select(F.lit("case050").alias("case_id"), F.col("id").alias("event_seq"))),
                    path, "case_id", "event_seq")
    spark.conf.unset("spark.sql.adaptive.enabled")
    written = len(list((tmp_path / "rows").glob("*.parquet")))
    assert written == 4 and len(clustered_files(spark, path, ["case199"])) == 1
    # A case with a third of all rows is spread over files.
    assert 1 < len(clustered_files(spark, path, ["case050"])) < written
    for wanted in (["case199"], ["case050", "case001"]):
        got = read_clustered(spark, path, "case_id", wanted)
        assert {f.rsplit("/", 1)[1] for f in got.inputFiles()} == {f.rsplit("/", 1)[1] for f in clustered_files(spark, path, wanted)}
        assert got.count() == sum(20 + 3000 * (case == "case050") for case in wanted)
    assert read_clustered(spark, path, "case_id", ["zzz"]).count() == 0


def test_places_in_order(spark):
    rows = spark.range(0, 1000, 1, 7).select("id", F.pmod(F.hash("id"), F.lit(13)).alias("rank"))
    got = [(r.rank, r.id) for r in in_order(rows, F.desc("rank"), "id").orderBy("place").collect()]
    assert got == sorted(got, key=lambda pair: (-pair[0], pair[1]))
    assert in_order(rows, "rank", "id").agg(F.sum("place")).first()[0] == 1000 * 1001 // 2
    assert in_order(rows.limit(0), "rank", "id").count() == 0


def test_response_or_fallback(spark):
    requests, uploads, _ = _case_tables(spark)
    known = intake.create_cases(intake.check_domain(requests, "case")[0])
    answers = spark.createDataFrame(
        [
            ("d1", '{"document_type":"unknown","fields":[{"key":"mobile","value":"12","bbox":[]}]}', None),
            ("d2", "oops", None),
        ],
        RESPONSES,
    )
    documents = process_documents(uploads, known, answers)
    got = {r.document_id: (r.outcome, r.document_type, r.summary) for r in documents.collect()}
    assert got == {
        "d1": ("parsed", "unknown", ""),
        "d2": ("failed", "unknown", "Processed unknown for Nepal financial KYC."),
        "d3": ("no_response", "cheque", "Processed cheque for Nepal financial KYC."),
    }
    fields = {r.document_id: r for r in document_fields(documents).collect()}
    assert (fields["d1"].key, fields["d1"].validation_status, fields["d1"].extracted_by) == ("mobile", "invalid", "gemma-4-26b-4bit")
    codes = {}
    for row in document_findings(documents).orderBy("finding_seq").collect():
        codes.setdefault(row.document_id, []).append(row.code)
    assert codes == {
        "d2": ["human_review_required", "gemma_unavailable"], "d3": ["human_review_required"]
    }


def test_foreign_and_missing_types(spark):
    requests, uploads, _ = _case_tables(spark)
    known = intake.create_cases(intake.check_domain(requests, "case")[0])
    declared = F.when(F.col("document_id") == "d1", "memo").when(F.col("document_id") == "d2", "pan")
    documents = process_documents(uploads.withColumn("declared_document_type", declared), known)
    got = {r.document_id: (r.declared_document_type, r.document_type) for r in documents.collect()}
    assert got == {"d2": ("pan", "pan"), "d3": ("unknown", "cheque")}


def test_two_responses_are_one_document(spark):
    requests, uploads, _ = _case_tables(spark)
    known = intake.create_cases(intake.check_domain(requests, "case")[0])
    answers = spark.createDataFrame([("d1", "{}", None), ("d1", "oops", None), ("dx", "{}", None)], RESPONSES)
    assert process_documents(uploads, known, answers).count() == 3


def test_all_of_a_long_document_is_exported(spark):
    lines = [(f"{n}", "raw_text", n) for n in range(25)]
    rows = spark.createDataFrame([("long", n, key, text, 0.5) for text, key, n in lines] + [("short", 0, "x", "s", 0.5)], OBSERVATIONS)
    documents = spark.createDataFrame(
        [("long", "l.png", "cheque", T0), ("short", "s.png", "cheque", T0)],
        "document_id string, filename string, document_type string, created_at timestamp_ntz",
    )
    run = read_by_template(documents, rows)
    none = spark.createDataFrame([], REVIEWS).withColumnRenamed("case_id", "document_id")
    records = reviews.apply_document_decisions(run.records, none)
    exported = exports.export_documents(records, run.fields, audit.document_audit(run.records, none, templates(spark)))
    raw = {r.document_id: r.fields.value for r in exported.filter("section = 'fields' AND key = 'raw_text'").collect()}
    assert raw == {"long": "\n".join(text for text, _, _ in lines), "short": "s"}


def test_large_case_is_exported_like_a_small_one(spark):
    requests, _, found = _case_tables(spark)
    known = intake.create_cases(intake.check_domain(requests, "case")[0])
    uploads = spark.range(600).select(
        F.when(F.col("id") < 597, "c1").otherwise("c2").alias("case_id"),
        F.format_string("d%03d", "id").alias("document_id"),
        F.lit("f").alias("filename"),
        F.lit("Sita Sharma").cast("binary").alias("content"),
        F.lit("unknown").alias("declared_document_type"),
        F.lit(T0).cast("timestamp_ntz").alias("uploaded_at"),
        (F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000).alias("event_seq"),
    )
    documents = process_documents(uploads, known)
    headers = cases.case_headers(known, uploads, found)
    rows = audit.case_audit(known, documents, found)
    at = F.lit(T0).cast("timestamp_ntz")
    exported = exports.export_cases(headers, documents, document_fields(documents), document_findings(documents), rows, at)
    got = {(r.case_id, r.section): r["count"] for r in exported.groupBy("case_id", "section").count().collect()}
    assert got["c1", "documents"] == 597 and got["c1", "audit_events"] == 1 + 2 * 597 + 1 + 1
    assert got["c2", "documents"] == 3 and got["c1", "header"] == got["c2", "header"] == 1
    assert got["c1", "fields"] == 1
    (big,) = exports.nested_cases(exported, ["c1"]).collect()
    assert [d.id for d in big.documents] == [f"d{n:03d}" for n in range(597)]
    assert big.evidence["full_name"].document_id == "d596"


def test_materialised_tables_can_be_dropped(spark):
    written = materialise(spark.range(5).toDF("n"), "numbers")
    folder = written.inputFiles()[0].rsplit("/", 1)[0]
    assert written.count() == 5 and exists(spark, folder)
    discard(written)
    assert not exists(spark, folder)


def test_table_readers(spark, tmp_path):
    requests, _, found = _case_tables(spark)
    tables = {
        "requests": (requests, read_case_requests),
        "reviews": (found, read_reviews),
        "responses": (spark.createDataFrame([("d1", "{}", None)], RESPONSES), read_responses),
        "observations": (spark.createDataFrame([("d1", 1, "k", "t", 0.5)], OBSERVATIONS), read_observations),
    }
    for name, (rows, read) in tables.items():
        rows.write.parquet(str(tmp_path / name))
        again = read(spark, str(tmp_path / name))
        assert again.columns == rows.columns and again.count() == rows.count()


def test_read_uploads(spark, tmp_path):
    folder = tmp_path / "case_id=c7" / "declared_document_type=pan"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"PAN 123456789")
    plain = tmp_path / "case_id=008" / "declared_document_type=unknown"
    plain.mkdir(parents=True)
    (plain / "b.txt").write_bytes(b"x")
    got = {r.filename: r for r in read_uploads(spark, str(tmp_path)).collect()}
    assert (got["a.txt"].case_id, got["a.txt"].declared_document_type) == ("c7", "pan")
    assert (got["b.txt"].case_id, got["b.txt"].declared_document_type) == ("008", "unknown")
    assert bytes(got["a.txt"].content) == b"PAN 123456789" and got["a.txt"].event_seq > 0
    plan = read_uploads(spark, str(tmp_path)).filter("case_id = 'c7'")
    assert [r.filename for r in plan.collect()] == ["a.txt"]
    filters = re.search(r"PartitionFilters: \[(.*?)\]", plan._jdf.queryExecution().toString())
    assert "case_id" in filters[1]


def test_listings(spark):
    requests, uploads, found = _case_tables(spark)
    known = intake.create_cases(intake.check_domain(requests, "case")[0])
    assert [r.case_id for r in cases.newest_first(known, "case_seq").orderBy("place").collect()] == ["c1", "c2"]
    assert cases.selected_case(known).first().case_id == "c1"
    assert cases.selected_case(known, "c2").first().case_id == "c2"
    assert cases.selected_case(known, "zz").first().case_id == "c1"
    status = cases.current_status(known, uploads, found)
    assert tuple(cases.case_metrics(status, uploads).first()) == (2, 1, 1, 3)
    assert {r.case_id: r.documents for r in cases.documents_per_case(known, uploads).collect()} == {"c1": 1, "c2": 2}
    wanted = spark.createDataFrame([("c1",), ("zz",)], "case_id string")
    hit, missing = cases.lookup(known, wanted, "case_id")
    assert [r.case_id for r in hit.collect()] == ["c1"] and [r.case_id for r in missing.collect()] == ["zz"]


def test_upload_and_review_checks(spark):
    _, uploads, found = _case_tables(spark)
    odd = uploads.withColumn("declared_document_type", F.when(F.col("document_id") == "d1", "memo").otherwise("pan"))
    ok, rejected = intake.check_domain(odd, "upload")
    assert ok.count() == 3 and rejected.first().reason == "declared_document_type is not allowed"
    anonymous = found.withColumn("reviewer", F.lit(None).cast("string"))
    assert {r.reason for r in intake.check_domain(anonymous, "review")[1].collect()} == {"reviewer is required"}
