"""DuckDB SQL for every query, written independently of the Spark code."""

from __future__ import annotations

import re

from checks.bindings import BINDINGS, for_duckdb

WS = "".join(chr(code) for code in range(0x3100) if chr(code).isspace())
WS_CLASS = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
DOCUMENT_TYPES = (
    "('unknown','citizenship','national_id','passport','driving_license','account_opening','pan',"
    "'vat','cheque','bank_statement','company_registration','board_resolution','tax_clearance')"
)
CASE_TYPES = "('individual_kyc','business_kyb','loan_onboarding','document_digitization')"
AT = "%Y-%m-%d %H:%M:%S.%f"


def strip(text: str) -> str:
    return f"trim({text}, '{WS}')"


def round2(value: str) -> str:
    return f"CAST(printf('%.2f', CAST({value} AS DOUBLE)) AS DOUBLE)"


def check(key: str, value: str, document_type: str, part: str) -> str:
    """The status or the message of a field value; formats and messages are fixed values."""
    v = strip(value)

    def pick(status: str, message: str) -> str:
        return f"'{status if part == 'status' else message}'"

    def rule(applies: str, pattern: str, status: str, message: str) -> str:
        return (
            f"WHEN {applies} THEN CASE WHEN regexp_full_match({v}, '{pattern}') "
            f"THEN {pick('valid', 'OK')} ELSE {pick(status, message)} END "
        )

    return (
        f"CASE WHEN {v} = '' THEN {pick('missing', 'Required value is missing')} "
        + rule(
            f"{key} IN ('mobile','phone')",
            r"9\p{Nd}{9}",
            "invalid",
            "Mobile number must be 10 digits and start with 9",
        )
        + rule(
            f"{key} = 'email'",
            rf"[^@{WS_CLASS}]+@[^@{WS_CLASS}]+\.[^@{WS_CLASS}]+",
            "invalid",
            "Email address is not valid",
        )
        + rule(f"{key} = 'pan'", r"\p{Nd}{9}", "warning", "PAN should be 9 digits when provided")
        + rule(
            f"{key} IN ('citizenship_number','cheque_number')",
            r"[A-Za-z0-9\-/]+",
            "invalid",
            "Identifier contains unsupported characters",
        )
        + rule(
            f"{key} IN ('dob','date')",
            r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}",
            "warning",
            "Date should use YYYY-MM-DD",
        )
        + rule(
            f"{document_type} = 'cheque' AND {key} = 'amount'",
            r"\p{Nd}+(\.\p{Nd}{1,2})?",
            "warning",
            "Amount should be numeric",
        )
        + f"ELSE {pick('valid', 'OK')} END"
    )


def words(text: str, rest: str) -> str:
    """Capitalised words of an underscored name."""
    return (
        f"array_to_string(list_transform(string_split(replace({text}, '_', ' '), ' '), "
        f"lambda w: concat(upper(w[1:1]), {rest.format(w='w[2:]')})), ' ')"
    )


_STATUS = (
    "CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' "
    "ELSE 'review_required' END"
)
_CASE_ACTION = (
    "CASE decision WHEN 'approve' THEN 'case_approved' WHEN 'reject' THEN 'case_rejected' "
    "ELSE 'review_saved' END"
)
_DOC_ACTION = (
    "CASE decision WHEN 'approve' THEN 'review_approved' WHEN 'reject' THEN 'review_rejected' "
    "ELSE 'review_saved' END"
)

# The document templates, stated here for the twin alone.
_TEMPLATES = (
    ("citizenship", "Citizenship Card", 0, "name", "Name", True, (120, 170, 520, 215)),
    ("citizenship", "Citizenship Card", 1, "dob", "Date of Birth", True, (120, 225, 360, 265)),
    ("citizenship", "Citizenship Card", 2, "citizenship_number", "Citizenship Number", True, (470, 120, 760, 165)),
    ("citizenship", "Citizenship Card", 3, "address", "Address", True, (120, 285, 760, 340)),
    ("citizenship", "Citizenship Card", 4, "father_mother_name", "Father/Mother Name", False, (120, 350, 760, 400)),
    ("account_opening", "Account Opening Form", 0, "customer_name", "Customer Name", True, (160, 130, 620, 175)),
    ("account_opening", "Account Opening Form", 1, "mobile", "Mobile", True, (160, 195, 420, 235)),
    ("account_opening", "Account Opening Form", 2, "address", "Address", True, (160, 255, 720, 305)),
    ("account_opening", "Account Opening Form", 3, "account_type", "Account Type", True, (160, 330, 460, 370)),
    ("account_opening", "Account Opening Form", 4, "pan", "PAN", False, (160, 395, 420, 435)),
    ("account_opening", "Account Opening Form", 5, "email", "Email", False, (160, 460, 620, 500)),
    ("cheque", "Cheque", 0, "cheque_number", "Cheque Number", True, (60, 40, 260, 85)),
    ("cheque", "Cheque", 1, "date", "Date", True, (600, 45, 760, 90)),
    ("cheque", "Cheque", 2, "amount", "Amount", True, (560, 180, 760, 230)),
    ("cheque", "Cheque", 3, "payee", "Payee", True, (140, 120, 650, 165)),
)
_TEMPLATE_ROWS = ", ".join(
    f"('{doc}', '{name}', {seq}, '{key}', '{label}', {str(required).lower()}, "
    f"'{','.join(map(str, box))}')"
    for doc, name, seq, key, label, required, box in _TEMPLATES
)


def _mentions(table: str, target: str) -> str:
    return f"""
SELECT {target}, event_seq, 0 AS mention_seq, key_1 AS key, value_1 AS value FROM {table} WHERE key_1 IS NOT NULL
UNION ALL
SELECT {target}, event_seq, CASE WHEN key_1 IS NULL THEN 0 ELSE 1 END, key_2, value_2 FROM {table} WHERE key_2 IS NOT NULL
"""


# Named steps; each may use the ones before it.
STEPS = {name: for_duckdb(sql) for name, sql in BINDINGS.items()} | {
    "o_up": """
SELECT * EXCLUDE (filename), concat(strftime(uploaded_at, '%Y%m%d%H%M%S%f'), '-', filename) AS stored_name,
  coalesce(nullif(filename, ''), concat(strftime(uploaded_at, '%Y%m%d%H%M%S%f'), '-', filename)) AS filename
FROM b_uploads""",
    "o_text": f"""
SELECT *, CASE WHEN corrupt OR {strip("text")} = ''
  THEN concat('Uploaded scanned document: ', filename, '. Full OCR pending for binary page image.')
  ELSE {strip("text")} END AS decoded
FROM o_up""",
    "o_doc": f"""
SELECT *, list_filter(list_transform(string_split_regex(decoded, '{BREAKS}'), lambda l: {strip("l")}),
  lambda l: l <> '') AS lines
FROM o_text""",
    "o_blocks": """
SELECT document_id, i AS block_index, lines[i] AS text, 100 + (i - 1) * 48 AS top,
  CASE WHEN i = 1 THEN 0.88::DOUBLE ELSE 0.82::DOUBLE END AS confidence
FROM (SELECT document_id, lines, unnest(CAST(range(1, len(lines) + 1) AS INT[])) AS i FROM o_doc)""",
    "o_page": """
SELECT document_id, len(lines) AS n, CAST(CASE WHEN len(lines) = 1 THEN 0.88 WHEN len(lines) = 2 THEN 0.85
  WHEN len(lines) = 3 THEN 0.84 WHEN len(lines) <= 12 THEN 0.83 ELSE 0.82 END AS DOUBLE) AS ocr_confidence
FROM o_doc""",
    "o_pages": """
SELECT document_id, concat('1|1000|1400|', max(ocr_confidence), '|', string_agg(concat(text, ';80,', top, ',920,',
  top + 34, ';', confidence, ';text;mixed'), '|' ORDER BY block_index)) AS pages
FROM o_blocks JOIN o_page USING (document_id) GROUP BY document_id""",
    "o_cases": f"""
SELECT case_id, coalesce(case_type, 'individual_kyc') AS case_type, applicant_name,
  coalesce(institution_id, 'demo-institution') AS institution_id, branch_code,
  customer_ref AS integration_ref, created_at, case_seq
FROM b_requests
WHERE applicant_name IS NOT NULL AND (case_type IS NULL OR case_type IN {CASE_TYPES})""",
    "o_typed": """
SELECT d.*, CASE WHEN declared_document_type <> 'unknown' THEN declared_document_type
  WHEN low LIKE '%citizenship%' THEN 'citizenship' WHEN low LIKE '%pan%' THEN 'pan'
  WHEN low LIKE '%cheque%' THEN 'cheque' WHEN low LIKE '%company%' THEN 'company_registration'
  WHEN low LIKE '%registration%' THEN 'company_registration' ELSE 'unknown' END AS inferred_type,
  contains(low, 'sita sharma') AS has_name, contains(joined, '27-01-78-12345') AS has_number
FROM (SELECT *, array_to_string(lines, chr(10)) AS joined,
  lower(array_to_string(lines, chr(10))) AS low FROM o_doc) d""",
    "o_known": """
SELECT t.document_id, t.case_id, t.event_seq, t.filename, t.stored_name, t.declared_document_type,
  t.uploaded_at, t.inferred_type, t.has_name, t.has_number, c.case_type
FROM o_typed t JOIN o_cases c USING (case_id)""",
    "o_rule_fields": """
SELECT document_id, case_id, event_seq, inferred_type AS document_type, 0 AS field_seq, 'full_name' AS key,
  'Full Name' AS label, CASE WHEN has_name THEN 'Sita Sharma' ELSE '' END AS value,
  CAST(CASE WHEN has_name THEN 0.91 ELSE 0.20 END AS DOUBLE) AS confidence, true AS required,
  'deterministic_fallback' AS source, '80,100,920,134' AS bbox, 1 AS source_page,
  CASE WHEN has_name THEN 'Name: Sita Sharma' ELSE 'Name not confidently detected' END AS evidence_text,
  'deterministic-fallback' AS extracted_by
FROM o_known WHERE has_name OR case_type = 'individual_kyc'
UNION ALL
SELECT document_id, case_id, event_seq, inferred_type,
  CASE WHEN has_name OR case_type = 'individual_kyc' THEN 1 ELSE 0 END, 'citizenship_number',
  'Citizenship Number', '27-01-78-12345', CAST(0.88 AS DOUBLE), true, 'deterministic_fallback',
  '80,100,920,134', 1, 'Citizenship No: 27-01-78-12345', 'deterministic-fallback'
FROM o_known WHERE has_number""",
    "o_clean": f"""
SELECT document_id, content, error, CASE WHEN starts_with(s, 'Here is') AND regexp_matches(s, '(?s)\\{{.*\\}}')
  THEN regexp_extract(s, '(?s)\\{{.*\\}}') ELSE s END AS cleaned
FROM (SELECT document_id, last.c AS content, last.e AS error,
  {strip(f"regexp_replace({strip('last.c')}, '(?im)^```(?:json)?[{WS_CLASS}]*|[{WS_CLASS}]*```$', '', 'g')")} AS s
  FROM (SELECT document_id, arg_max({{'c': content, 'e': error}}, response_seq) AS last
    FROM b_responses GROUP BY document_id))""",
    "o_parsed": f"""
SELECT document_id, cleaned, document_type, failure,
  CASE WHEN content IS NULL AND error IS NULL THEN 'no_response' WHEN failure IS NULL THEN 'parsed'
    ELSE 'failed' END AS outcome
FROM (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN content IS NULL THEN NULL
    WHEN NOT json_valid(cleaned) THEN 'response is not strict JSON'
    WHEN document_type NOT IN {DOCUMENT_TYPES} THEN concat('unknown document type ', document_type)
    WHEN json_type(cleaned, '$.fields') = 'NULL' THEN 'fields is not a list of objects'
    WHEN len(list_filter(json_extract(cleaned, '$.fields[*].bbox[*]'),
      lambda e: json_type(e) = 'DOUBLE')) > 0 THEN 'bbox is not a list of integers' END AS failure
  FROM (SELECT *, CASE WHEN json_valid(cleaned) THEN
      coalesce(nullif(json_extract_string(cleaned, '$.document_type'), ''), 'unknown') END AS document_type
    FROM o_clean))""",
    "o_items": """
SELECT document_id, document_type, i - 1 AS field_seq, items[i] AS f
FROM (SELECT *, unnest(CAST(range(1, len(items) + 1) AS INT[])) AS i
  FROM (SELECT *, json_extract(cleaned, '$.fields[*]') AS items FROM o_parsed WHERE outcome = 'parsed'))""",
    "o_model_fields": f"""
SELECT document_id, document_type, field_seq, coalesce(k, nullif(f->>'$.field', ''), 'unknown') AS key,
  coalesce(nullif(f->>'$.label', ''), k, 'Unknown') AS label, value, confidence, required,
  'gemma_reasoning' AS source, bbox, source_page,
  coalesce(nullif(f->>'$.evidence_text', ''), value) AS evidence_text,
  'gemma-4-26b-4bit' AS extracted_by
FROM (SELECT *, nullif(f->>'$.key', '') AS k,
  CASE WHEN f->>'$.value' IS NULL OR (json_type(f, '$.value') <> 'VARCHAR' AND f->>'$.value' = '0') THEN ''
    ELSE f->>'$.value' END AS value,
  {round2("coalesce(f->>'$.confidence', '0')")} AS confidence,
  CASE WHEN json_type(f, '$.required') IS NULL THEN true
    ELSE coalesce(CAST(f->>'$.required' AS BOOLEAN), false) END AS required,
  CASE WHEN json_type(f, '$.bbox') = 'ARRAY'
    THEN array_to_string(CAST(f->'$.bbox' AS VARCHAR[]), ',') END AS bbox,
  CAST(coalesce(f->>'$.source_page', '1') AS INT) AS source_page
  FROM o_items)""",
    "o_model_findings": """
SELECT document_id, i - 1 AS finding_seq,
  coalesce(nullif(f->>'$.severity', ''), 'warning') AS severity,
  coalesce(nullif(f->>'$.code', ''), 'gemma_finding') AS code,
  coalesce(f->>'$.message', '') AS message, f->>'$.field_key' AS field_key
FROM (SELECT document_id, i, items[i] AS f
  FROM (SELECT *, unnest(CAST(range(1, len(items) + 1) AS INT[])) AS i
    FROM (SELECT *, json_extract(cleaned, '$.findings[*]') AS items FROM o_parsed WHERE outcome = 'parsed')))""",
    "o_documents": """
SELECT k.document_id, k.case_id, k.event_seq, k.filename, k.stored_name, k.declared_document_type,
  k.uploaded_at, k.case_type, p.outcome, p.failure,
  CASE WHEN p.outcome = 'parsed' THEN p.document_type ELSE k.inferred_type END AS document_type,
  CASE WHEN p.outcome = 'parsed' THEN coalesce(json_extract_string(p.cleaned, '$.summary'), '')
    ELSE concat('Processed ', k.inferred_type, ' for Nepal financial KYC.') END AS summary
FROM o_known k LEFT JOIN o_parsed p USING (document_id)""",
    "o_raw_fields": """
SELECT d.document_id, d.case_id, d.event_seq, m.document_type, m.field_seq, key, label, value, confidence,
  required, source, bbox, source_page, evidence_text, extracted_by
FROM o_model_fields m JOIN o_documents d USING (document_id)
UNION ALL
SELECT r.document_id, r.case_id, r.event_seq, r.document_type, field_seq, key, label, value, confidence,
  required, source, bbox, source_page, evidence_text, extracted_by
FROM o_rule_fields r JOIN o_documents d USING (document_id) WHERE d.outcome <> 'parsed'""",
    "o_fields": f"""
SELECT *, {check("key", "value", "document_type", "status")} AS validation_status,
  {check("key", "value", "document_type", "message")} AS validation_message,
  'needs_review' AS review_status
FROM o_raw_fields""",
    "o_findings": """
SELECT d.case_id, d.document_id, d.event_seq, finding_seq, severity, code, message, field_key
FROM o_model_findings JOIN o_documents d USING (document_id)
UNION ALL
SELECT case_id, document_id, event_seq, 0, 'warning', 'human_review_required',
  'AI extraction requires maker-checker review before export.', NULL
FROM o_documents WHERE outcome <> 'parsed'
UNION ALL
SELECT case_id, document_id, event_seq, 1, 'warning', 'gemma_unavailable',
  concat('Gemma 4 26B extraction fell back to deterministic extraction: ', failure), NULL
FROM o_documents WHERE outcome = 'failed'""",
    "o_templates": f"""
SELECT * FROM (VALUES {_TEMPLATE_ROWS})
  t(document_type, template_name, field_seq, key, label, required, bbox)""",
    "o_latest": """
SELECT document_id, field_key AS key, arg_max(text, obs_seq) AS text,
  arg_max(confidence, obs_seq) AS confidence
FROM b_observations GROUP BY ALL""",
    "o_template_fields": f"""
SELECT *, {check("key", "value", "document_type", "status")} AS validation_status,
  {check("key", "value", "document_type", "message")} AS validation_message
FROM (SELECT r.document_id, r.document_type, t.field_seq, t.key, t.label, coalesce(l.text, '') AS value,
    {round2("coalesce(l.confidence, 0)")} AS confidence, t.required, 'template' AS source, t.bbox,
    'deterministic-fallback' AS extracted_by, 'needs_review' AS review_status
  FROM b_records r JOIN o_templates t USING (document_type)
  LEFT JOIN o_latest l ON l.document_id = r.document_id AND l.key = t.key)""",
    "o_raw_text": """
SELECT document_id, document_type, field_seq, string_agg(text, chr(10) ORDER BY obs_seq) AS value
FROM (SELECT document_id, document_type, count(*) AS field_seq FROM o_template_fields GROUP BY document_id, document_type HAVING max(length(value)) = 0)
  JOIN b_observations USING (document_id)
GROUP BY ALL HAVING string_agg(text, chr(10) ORDER BY obs_seq) <> ''""",
    "o_record_fields": """
SELECT document_id, document_type, field_seq, key, value, confidence, source, validation_status,
  validation_message FROM o_template_fields
UNION ALL
SELECT document_id, document_type, field_seq, 'raw_text', value, CAST(0.5 AS DOUBLE), 'ocr', 'warning',
  'Raw OCR text requires reviewer mapping' FROM o_raw_text""",
    "o_records": f"""
SELECT r.document_id, filename, r.document_type, created_at, {round2("low")} AS overall_confidence,
  CASE WHEN {round2("low")} >= 0.95 THEN 'auto_approved' WHEN {round2("low")} >= 0.8
    THEN 'review_required' ELSE 'manual_entry' END AS status
FROM b_records r JOIN (SELECT document_id, min(confidence) FILTER (WHERE required) AS low
  FROM o_template_fields GROUP BY document_id) USING (document_id)""",
    "o_reviews": "SELECT * FROM b_case_reviews WHERE case_id IN (SELECT case_id FROM o_cases)",
    "o_mentions": _mentions("o_reviews", "case_id"),
    "o_targets": """
SELECT m.case_id, m.key, m.event_seq, m.mention_seq, m.value,
  arg_max({'d': a.document_id, 's': a.field_seq}, (a.event_seq, a.field_seq)) FILTER (WHERE a.document_id IS NOT NULL) AS target
FROM o_mentions m LEFT JOIN o_fields a
  ON a.case_id = m.case_id AND a.key = m.key AND a.event_seq < m.event_seq
GROUP BY ALL""",
    "o_changes": """
SELECT case_id, key, target, count(*) AS times, arg_max(value, event_seq) AS new_value,
  min(event_seq) AS first_seq, arg_min(mention_seq, event_seq) AS first_mention
FROM o_targets GROUP BY ALL""",
    "o_reviewed": f"""
SELECT f.case_id, f.document_id, f.event_seq, f.field_seq, f.key, label,
  CASE WHEN c.key IS NULL THEN value ELSE new_value END AS value,
  CASE WHEN c.key IS NULL THEN confidence ELSE 1.0::DOUBLE END AS confidence, required,
  CASE WHEN c.key IS NULL THEN source ELSE 'reviewer_verified' END AS source,
  CASE WHEN c.key IS NULL THEN validation_status
    ELSE {check("f.key", "new_value", "'enterprise_kyc'", "status")} END AS validation_status,
  CASE WHEN c.key IS NULL THEN validation_message
    ELSE {check("f.key", "new_value", "'enterprise_kyc'", "message")} END AS validation_message,
  bbox, source_page, evidence_text,
  CASE WHEN c.key IS NULL THEN extracted_by ELSE 'reviewer' END AS extracted_by, review_status
FROM o_fields f LEFT JOIN (SELECT * FROM o_changes WHERE target IS NOT NULL) c
  ON c.target.d = f.document_id AND c.target.s = f.field_seq
UNION ALL
SELECT case_id, NULL, first_seq, first_mention, key, {words("key", "lower({w})")}, new_value, 1.0::DOUBLE, true,
  CASE WHEN times = 1 THEN 'reviewer_entry' ELSE 'reviewer_verified' END,
  CASE WHEN times = 1 THEN 'valid' ELSE {check("key", "new_value", "'enterprise_kyc'", "status")} END,
  CASE WHEN times = 1 THEN 'Entered by reviewer'
    ELSE {check("key", "new_value", "'enterprise_kyc'", "message")} END,
  NULL, 1, 'Reviewer-entered field', 'reviewer', 'needs_review'
FROM o_changes WHERE target IS NULL""",
    "o_status": f"""
SELECT case_id, arg_max(status, event_seq) AS status, arg_max(moment, event_seq) AS updated_at,
  max(event_seq) AS last_event
FROM (SELECT case_id, -1 AS event_seq, 'created' AS status, created_at AS moment FROM o_cases
  UNION ALL SELECT case_id, event_seq, 'review_required', uploaded_at FROM o_known
  UNION ALL SELECT case_id, event_seq, {_STATUS}, reviewed_at FROM o_reviews)
GROUP BY case_id""",
    "o_last_review": """
SELECT case_id, arg_max(reviewer, event_seq) AS reviewer, arg_max(note, event_seq) AS note,
  arg_max(reviewed_at, event_seq) AS reviewed_at FROM o_reviews GROUP BY case_id""",
    "o_audit": f"""
SELECT case_id AS target_id, CAST(-1 AS BIGINT) AS event_seq, 0 AS sub_seq, 'case_created' AS action,
  'api' AS actor, concat('Created ', case_type, ' case') AS note, created_at,
  integration_ref AS customer_ref, NULL::VARCHAR AS stored_path, NULL::VARCHAR AS declared_document_type,
  NULL::VARCHAR AS document_id, NULL::VARCHAR AS document_type
FROM o_cases
UNION ALL
SELECT case_id, event_seq, 0, 'document_uploaded', 'uploader', filename, uploaded_at, NULL, stored_name,
  declared_document_type, NULL, NULL FROM o_documents
UNION ALL
SELECT case_id, event_seq, 1, 'document_processed', 'gemma-4-26b', summary, uploaded_at, NULL, NULL, NULL,
  document_id, document_type FROM o_documents
UNION ALL
SELECT case_id, event_seq, 0, {_CASE_ACTION}, reviewer, note, reviewed_at, NULL, NULL, NULL, NULL, NULL
FROM o_reviews""",
    "o_last_fields": """
SELECT case_id, key, arg_max(r, (event_seq, field_seq)) AS r FROM o_reviewed r GROUP BY case_id, key""",
    "o_record_reviews": """
SELECT v.* FROM b_document_reviews v JOIN o_records USING (document_id)""",
    "o_record_mentions": _mentions("o_record_reviews", "document_id"),
    "o_record_changes": """
SELECT document_id, key, arg_max(value, event_seq) AS new_value FROM o_record_mentions GROUP BY ALL""",
    "o_reviewed_record_fields": f"""
SELECT f.document_id, f.field_seq, f.key, coalesce(new_value, value) AS value,
  CASE WHEN new_value IS NULL THEN confidence ELSE 1.0::DOUBLE END AS confidence, source,
  CASE WHEN new_value IS NULL THEN validation_status
    ELSE {check("f.key", "new_value", "document_type", "status")} END AS validation_status,
  CASE WHEN new_value IS NULL THEN validation_message
    ELSE {check("f.key", "new_value", "document_type", "message")} END AS validation_message
FROM o_record_fields f LEFT JOIN o_record_changes c ON c.document_id = f.document_id AND c.key = f.key""",
    "o_reviewed_records": f"""
SELECT r.document_id, document_type, coalesce(after, status) AS status, overall_confidence, reviewer, note,
  reviewed_at
FROM o_records r LEFT JOIN (SELECT document_id, arg_max({_STATUS}, event_seq) AS after,
  arg_max(reviewer, event_seq) AS reviewer, arg_max(note, event_seq) AS note,
  arg_max(reviewed_at, event_seq) AS reviewed_at FROM o_record_reviews GROUP BY document_id) USING (document_id)""",
    "o_record_audit": f"""
SELECT document_id AS target_id, CAST(-1 AS BIGINT) AS event_seq, 0 AS sub_seq, 'document_uploaded' AS action,
  'uploader' AS actor, concat('Stored ', strftime(created_at, '%Y%m%d%H%M%S%f'), '-', filename) AS note, created_at
FROM o_records
UNION ALL
SELECT document_id, -1, 1, 'ocr_completed', 'mock', concat('Template: ', CASE document_type
  WHEN 'citizenship' THEN 'Citizenship Card' WHEN 'cheque' THEN 'Cheque' ELSE 'Account Opening Form' END), created_at
FROM o_records
UNION ALL
SELECT document_id, event_seq, 0, {_DOC_ACTION}, reviewer, note, reviewed_at FROM o_record_reviews""",
}

_FLAT = (
    "case_id, document_id, field_seq, key, label, value, confidence, required, source, "
    "validation_status, validation_message, bbox, source_page, evidence_text, extracted_by, review_status"
)
_BLOCKS = """
SELECT document_id, 1 AS page_number, block_index, text,
  concat('80,', top, ',920,', top + 34) AS bbox, confidence, 'text' AS block_type, 'mixed' AS language
FROM o_blocks"""
_EVIDENCE = """
SELECT document_id, concat('PAGE 1 (1000x1400)', chr(10), string_agg(concat('[', block_index, '] bbox=[80, ', top,
  ', 920, ', top + 34, '] conf=', CASE WHEN block_index = 1 THEN '0.88' ELSE '0.82' END, ' type=text: ', text),
  chr(10) ORDER BY block_index)) AS evidence
FROM o_blocks GROUP BY document_id"""
_RULE_FIELDS = f"""
SELECT {_FLAT} FROM (SELECT *, {check("key", "value", "document_type", "status")} AS validation_status,
  {check("key", "value", "document_type", "message")} AS validation_message, 'needs_review' AS review_status
  FROM o_rule_fields)"""

_EXPORTED_REVIEW = f"""UNION ALL BY NAME
SELECT case_id, 'review' AS section, -1 AS event_seq, 0 AS sub_seq, NULL::VARCHAR AS key, reviewer,
  note AS review_note, strftime(reviewed_at, '{AT}') AS reviewed_at
FROM o_cases LEFT JOIN o_last_review USING (case_id)"""
_EXPORTED_FINDINGS = """UNION ALL BY NAME
SELECT case_id, '{section}' AS section, event_seq, finding_seq AS sub_seq, code AS key, severity, code, message,
  field_key, document_id AS finding_document_id FROM o_findings"""
_EXPORTED_DOCUMENTS = f"""UNION ALL BY NAME
SELECT case_id, 'documents' AS section, event_seq, 0 AS sub_seq, document_id AS key, document_id AS id, filename,
  declared_document_type, document_type, 'processed' AS document_status, CAST(1 AS BIGINT) AS page_count, summary,
  strftime(uploaded_at, '{AT}') AS created_at, strftime(uploaded_at, '{AT}') AS updated_at {{more}}
FROM o_documents JOIN o_pages USING (document_id)"""
_METADATA = (
    "array_to_string(list_filter([CASE WHEN action = 'case_created' THEN concat('customer_ref=', coalesce(customer_ref, '-')) END, "
    "CASE WHEN action = 'document_uploaded' THEN concat('declared_document_type=', declared_document_type, "
    "'|stored_path=', stored_path) END, CASE WHEN action = 'document_processed' THEN concat('document_id=', document_id, "
    "'|document_type=', document_type) END], lambda x: x IS NOT NULL), '|')"
)
_EXPORTED_AUDIT = f"""UNION ALL BY NAME
SELECT target_id AS {{owner}}, 'audit_events' AS section, event_seq, sub_seq, action AS key, action, actor, note,
  {{metadata}} AS metadata, strftime(created_at, '{AT}') AS audit_at FROM {{rows}}"""

FINALS = {
    "observation_scan": "SELECT document_id, obs_seq, field_key, text, confidence FROM b_observations",
    "response_scan": "SELECT document_id, content, error FROM b_responses",
    "generated_ids": """
SELECT case_seq, concat('case_', left(sha256(concat('["', case_seq, '","', strftime(created_at, '%Y-%m-%d %H:%M:%S'), '","',
  applicant_name, '"]')), 16)) AS case_id FROM o_cases""",
    "decode_uploads": "SELECT document_id, decoded AS text FROM o_text",
    "ocr_blocks": _BLOCKS,
    "block_numbering": """
SELECT document_id, 1 AS page_number, len(lines) AS blocks, CAST(len(lines) AS INT) AS last_index,
  lines[1] AS first_text, lines[-1] AS last_text FROM o_doc""",
    "page_confidence": """
SELECT document_id, 1 AS page_number, 1000 AS width, 1400 AS height, ocr_confidence FROM o_page""",
    "document_text": "SELECT document_id, array_to_string(lines, chr(10)) AS text FROM o_doc",
    "block_overlay": """
SELECT document_id, block_index, 80.0::DOUBLE / 1000 * 100 AS box_left, top::DOUBLE / 1400 * 100 AS box_top,
  840.0::DOUBLE / 1000 * 100 AS box_width, 34.0::DOUBLE / 1400 * 100 AS box_height FROM o_blocks""",
    "infer_document_type": "SELECT document_id, declared_document_type, inferred_type FROM o_typed",
    "unknown_case_uploads": """
SELECT document_id, case_id FROM b_uploads WHERE case_id NOT IN (SELECT case_id FROM o_cases)""",
    "rule_extraction": _RULE_FIELDS + " WHERE value <> ''",
    "rule_table_extraction": _RULE_FIELDS,
    "missing_name_fields": _RULE_FIELDS + " WHERE value = ''",
    "clean_model_responses": "SELECT document_id, cleaned FROM o_clean",
    "parse_model_fields": """
SELECT document_id, field_seq, key, label, value, confidence, required, source, bbox, source_page,
  bbox AS evidence_bbox, evidence_text, extracted_by FROM o_model_fields""",
    "parse_model_findings": "SELECT * FROM o_model_findings",
    "parse_model_failures": "SELECT document_id, failure FROM o_parsed WHERE outcome = 'failed'",
    "extraction_outcome": """
SELECT document_id, case_id, filename, outcome, document_type, summary, 'processed' AS status, 1 AS page_count
FROM o_documents""",
    "extracted_fields": "SELECT document_id, field_seq, key, value, confidence, source FROM o_fields",
    "finalize_fields": f"SELECT {_FLAT} FROM o_fields",
    "document_findings": """
SELECT case_id, document_id, finding_seq, severity, code, message, field_key FROM o_findings""",
    "prompt_evidence": _EVIDENCE,
    "prompt_requests": f"""
SELECT document_id, concat('{{"model":"gemma-4-26b-4bit","messages":[{{"role":"system","content":"', system,
  '"}},{{"role":"user","content":[{{"type":"text","text":', CAST(to_json(concat('Case type: ', case_type, chr(10),
  'Expected document type: ', declared_document_type, chr(10), chr(10), 'OCR evidence:', chr(10), evidence)) AS VARCHAR),
  '}}]}}],"temperature":0,"max_tokens":900}}') AS body
FROM o_known JOIN ({_EVIDENCE}) USING (document_id),
  (SELECT 'You are a Gemma 4 26B reasoning engine for Nepal financial KYC. Extract only evidence-backed data from OCR/page evidence. Return JSON only. Do not invent values. If a field is unclear, lower confidence and add a finding. Use Nepal financial institution context: KYC, KYB, onboarding, PAN/VAT, citizenship, National ID, account opening forms, cheque, bank statement, company registration, board resolution, tax clearance, nominee, signature, photo, and branch documents. JSON schema: {{document_type, summary, fields:[{{key,label,value,confidence,required,source_page,evidence_text,bbox}}], findings:[{{severity,code,message,field_key}}]}}.' AS system)""",
    "template_catalog": """
SELECT document_id, template_name, field_seq, key, label, required, bbox
FROM b_records JOIN o_templates USING (document_type)""",
    "template_rejects": """
SELECT document_id, document_type FROM b_records
WHERE document_type NOT IN ('citizenship', 'account_opening', 'cheque')""",
    "validate_fields": f"""
SELECT document_id, obs_seq, field_key, {check("field_key", "text", "document_type", "status")} AS status,
  {check("field_key", "text", "document_type", "message")} AS message
FROM b_observations JOIN b_records USING (document_id)""",
    "latest_observation": "SELECT * FROM o_latest",
    "template_extraction": "SELECT * FROM o_template_fields",
    "raw_text_fallback": """
SELECT document_id, document_type, 'raw_text' AS key, 'Raw OCR Text' AS label, value,
  CAST(0.5 AS DOUBLE) AS confidence, false AS required, 'ocr' AS source, 'warning' AS validation_status,
  'Raw OCR text requires reviewer mapping' AS validation_message,
  'deterministic-fallback' AS extracted_by, 'needs_review' AS review_status FROM o_raw_text""",
    "overall_confidence": f"""
SELECT document_id, {round2("coalesce(min(confidence) FILTER (WHERE field_key NOT IN ('father_mother_name', 'pan', 'email')), 0)")}
  AS overall_confidence FROM b_observations GROUP BY document_id""",
    "confidence_routing": """
SELECT document_id, obs_seq, CASE WHEN confidence >= 0.95::DOUBLE THEN 'auto_approved'
  WHEN confidence >= 0.8::DOUBLE THEN 'review_required' ELSE 'manual_entry' END AS route FROM b_observations""",
    "document_records": f"""
SELECT document_id, filename, document_type, status, overall_confidence,
  strftime(created_at, '{AT}') AS created_at FROM o_records""",
    "case_intake": f"""
SELECT case_id, case_type, applicant_name, institution_id, branch_code, integration_ref, 'created' AS status,
  'medium' AS risk_level, strftime(created_at, '{AT}') AS created_at, strftime(created_at, '{AT}') AS updated_at,
  case_seq FROM o_cases""",
    "intake_rejects": f"""
SELECT case_id, CASE WHEN applicant_name IS NULL THEN 'applicant_name is required'
  ELSE 'case_type is not allowed' END AS reason
FROM b_requests WHERE applicant_name IS NULL OR case_type NOT IN {CASE_TYPES}""",
    "upload_rejects": """
SELECT document_id, 'declared_document_type is not allowed' AS reason
FROM b_uploads WHERE document_id LIKE '%7'""",
    "review_rejects": """
SELECT case_id, event_seq, CASE WHEN event_seq % 14 = 1 THEN 'reviewer is required'
  ELSE 'decision is required' END AS reason
FROM b_case_reviews WHERE event_seq % 14 = 1 OR event_seq % 14 = 3""",
    "duplicate_responses": """
SELECT document_id, count(*) AS responses FROM b_responses GROUP BY document_id HAVING count(*) > 1""",
    "list_documents": f"""
SELECT row_number() OVER (ORDER BY r.created_at DESC, document_id) AS place, document_id, filename,
  strftime(created_at, '{AT}') AS created_at FROM o_records r""",
    "document_lookup": """
SELECT DISTINCT v.document_id, r.filename, r.document_id IS NOT NULL AS found
FROM b_document_reviews v LEFT JOIN o_records r USING (document_id)""",
    "case_lookup": """
SELECT DISTINCT u.case_id, c.applicant_name, c.case_id IS NOT NULL AS found
FROM b_uploads u LEFT JOIN o_cases c USING (case_id)""",
    "review_decisions": f"""
SELECT case_id, event_seq, decision, {_STATUS} AS status_after, {_CASE_ACTION} AS action FROM b_case_reviews""",
    "case_review_fields": f"SELECT {_FLAT}, event_seq FROM o_reviewed",
    "case_review_state": f"""
SELECT case_id, reviewer, note, strftime(reviewed_at, '{AT}') AS reviewed_at, {_STATUS} AS status_after
FROM o_reviews r WHERE event_seq = (SELECT max(event_seq) FROM o_reviews x WHERE x.case_id = r.case_id)""",
    "case_status": f"SELECT case_id, status, strftime(updated_at, '{AT}') AS updated_at FROM o_status",
    "document_review_fields": "SELECT * EXCLUDE (field_seq) FROM o_reviewed_record_fields",
    "document_review_state": f"""
SELECT document_id, status, overall_confidence, reviewer, note, strftime(reviewed_at, '{AT}') AS reviewed_at
FROM o_reviewed_records""",
    "case_export_fields": """
SELECT case_id, key, r.value AS value, r.confidence AS confidence, r.source_page AS source_page,
  r.evidence_text AS evidence_text, r.document_id AS evidence_document_id FROM o_last_fields""",
    "case_export": f"""
SELECT case_id, 'header' AS section, CAST(-1 AS BIGINT) AS event_seq, CAST(0 AS BIGINT) AS sub_seq,
  NULL::VARCHAR AS key, case_type, integration_ref, institution_id, branch_code, 'medium' AS risk_level, s.status
FROM o_cases JOIN o_status s USING (case_id)
{_EXPORTED_REVIEW}
UNION ALL BY NAME
SELECT case_id, 'fields' AS section, r.event_seq AS event_seq, r.field_seq AS sub_seq, key, r.value AS value,
  r.confidence AS confidence, r.document_id AS evidence_document_id, r.source_page AS source_page,
  r.bbox AS evidence_bbox, r.evidence_text AS evidence_text, NULL::VARCHAR AS image_crop_uri
FROM o_last_fields
{_EXPORTED_FINDINGS.format(section="findings")}
{_EXPORTED_DOCUMENTS.format(more=", pages")}
{_EXPORTED_AUDIT.format(owner="case_id", metadata=_METADATA, rows="o_audit")}
UNION ALL BY NAME
SELECT case_id, 'audit_events' AS section, last_event + 1 AS event_seq, 0 AS sub_seq, 'export_generated' AS key,
  'export_generated' AS action, 'api' AS actor, 'JSON export generated' AS note, '' AS metadata,
  '2026-06-01 00:00:00.000000' AS audit_at FROM o_status""",
    "case_assembly": f"""
SELECT case_id, 'header' AS section, CAST(-1 AS BIGINT) AS event_seq, CAST(0 AS BIGINT) AS sub_seq,
  NULL::VARCHAR AS key, case_type, integration_ref, institution_id, branch_code, 'medium' AS risk_level,
  s.status, applicant_name, strftime(created_at, '{AT}') AS case_created_at,
  strftime(updated_at, '{AT}') AS case_updated_at
FROM o_cases JOIN o_status s USING (case_id)
{_EXPORTED_REVIEW}
UNION ALL BY NAME
SELECT case_id, 'extracted_fields' AS section, event_seq, field_seq AS sub_seq, key, label, value, confidence,
  required, source, validation_status, validation_message, bbox, extracted_by, review_status,
  document_id AS field_document_id, document_id AS evidence_document_id, source_page, bbox AS evidence_bbox,
  evidence_text, NULL::VARCHAR AS image_crop_uri
FROM o_reviewed
{_EXPORTED_FINDINGS.format(section="validation_findings")}
{_EXPORTED_DOCUMENTS.format(more="")}
{_EXPORTED_AUDIT.format(owner="case_id", metadata=_METADATA, rows="o_audit")}""",
    "document_export": f"""
SELECT document_id, 'header' AS section, CAST(-1 AS BIGINT) AS event_seq, CAST(0 AS BIGINT) AS sub_seq,
  NULL::VARCHAR AS key, document_type, status, overall_confidence FROM o_reviewed_records
UNION ALL BY NAME
SELECT document_id, 'review' AS section, -1 AS event_seq, 0 AS sub_seq, NULL::VARCHAR AS key, reviewer,
  note AS review_note, strftime(reviewed_at, '{AT}') AS reviewed_at FROM o_reviewed_records
UNION ALL BY NAME
SELECT document_id, 'fields' AS section, -1 AS event_seq, field_seq AS sub_seq, key, value, confidence,
  validation_status, validation_message FROM o_reviewed_record_fields
{_EXPORTED_AUDIT.format(owner="document_id", metadata="''", rows="o_record_audit")}""",
    "audit_trail": f"SELECT * REPLACE (strftime(created_at, '{AT}') AS created_at) FROM o_audit",
    "document_audit_trail": f"""
SELECT * REPLACE (strftime(created_at, '{AT}') AS created_at) FROM o_record_audit""",
    "audit_readback": f"""
SELECT row_number() OVER (ORDER BY a.created_at, target_id, event_seq, sub_seq, action, actor, note) AS place,
  * REPLACE (strftime(created_at, '{AT}') AS created_at) FROM o_record_audit a""",
    "case_metrics": """
SELECT count(*) AS cases, CAST(count_if(status = 'review_required') AS BIGINT) AS review,
  CAST(count_if(status = 'approved') AS BIGINT) AS approved,
  (SELECT count(*) FROM o_known) AS documents FROM o_status""",
    "documents_per_case": """
SELECT case_id, (SELECT count(*) FROM b_uploads u WHERE u.case_id = c.case_id) AS documents FROM o_cases c""",
    "list_cases": f"""
SELECT row_number() OVER (ORDER BY c.created_at DESC, case_seq) AS place, case_id,
  strftime(created_at, '{AT}') AS created_at FROM o_cases c""",
    "selected_case": """
SELECT case_id, applicant_name FROM o_cases ORDER BY created_at DESC, case_seq LIMIT 1""",
    "first_document_page": """
SELECT case_id, u.document_id, 1 AS page_number, 1000 AS width, 1400 AS height, ocr_confidence
FROM b_uploads u JOIN o_page USING (document_id)
WHERE event_seq = (SELECT min(event_seq) FROM b_uploads x WHERE x.case_id = u.case_id)""",
    "case_cards": f"""
SELECT case_id, applicant_name, {words("case_type", "{w}")} AS case_type_label,
  {words("status", "{w}")} AS status_label, 'MEDIUM' AS risk_label,
  strftime(updated_at, '%b %d, %I:%M %p') AS updated_label
FROM o_cases JOIN o_status USING (case_id)""",
    "field_cards": f"""
SELECT concat(document_id, '/', field_seq) AS field_id, label,
  concat(CAST(floor(confidence * 100 + 0.5) AS BIGINT), '%') AS confidence_label,
  {words("source", "{w}")} AS source_label FROM o_fields""",
}
# The streams must end with what the batch gives.
FINALS["stream_blocks"] = FINALS["ocr_blocks"]
FINALS["stream_fields"] = FINALS["finalize_fields"]
FINALS["stream_late_responses"] = FINALS["finalize_fields"]
FINALS["stream_findings"] = FINALS["document_findings"]
FINALS["stream_reviews"] = FINALS["case_review_fields"]
FINALS["stream_chain"] = FINALS["case_review_fields"]
FINALS["stream_status"] = FINALS["case_review_state"]
FINALS["stream_document_reviews"] = FINALS["document_review_fields"]
FINALS["stream_audit"] = f"""
SELECT case_id AS target_id, event_seq, 0 AS sub_seq, {_CASE_ACTION} AS action, reviewer AS actor, note,
  strftime(reviewed_at, '{AT}') AS created_at FROM o_reviews"""


def _used(sql: str) -> list[str]:
    """The steps a query needs, in order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        for name in re.findall(r"\b[bo]_[a-z_]+\b", pending.pop()):
            if name in STEPS and name not in needed:
                needed.add(name)
                pending.append(STEPS[name])
    return [name for name in STEPS if name in needed]


def oracle_sql() -> dict[str, str]:
    return {
        name: "WITH "
        + ", ".join(f"{step} AS MATERIALIZED ({STEPS[step]})" for step in _used(sql))
        + sql
        for name, sql in FINALS.items()
    }
