"""How the given tables stand in for the library's inputs.

Each binding is one SELECT over whole tables that both Spark and DuckDB run;
``{minutes(..)}`` and ``{json(..)}`` mark the expressions they spell differently. None of the
given tables holds identity documents, so header lines, keys and values are
derived from their columns; no row is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "customer", "orders", "events")

UPLOADS = """
SELECT concat('doc_', doc_id) AS document_id,
  concat('case_', CAST(floor(doc_id / 5.0) AS BIGINT)) AS case_id,
  CASE WHEN source = 'src3' THEN '' ELSE concat('upload-', doc_id, '.txt') END AS filename,
  concat(CASE doc_id % 8
         WHEN 0 THEN concat('Name: Sita Sharma', chr(10), 'Citizenship No: 27-01-78-12345', chr(10))
         WHEN 1 THEN concat('PAN card', chr(10))
         WHEN 2 THEN concat('Cheque leaf', chr(10))
         WHEN 3 THEN concat('Company profile', chr(10))
         WHEN 4 THEN concat('Registration certificate', chr(13), chr(10))
         WHEN 5 THEN concat('  SITA SHARMA', chr(9), chr(10), chr(10))
         WHEN 6 THEN concat('No: 27-01-78-12345', chr(11))
         ELSE '' END, text) AS text,
  source = 'src7' AS corrupt,
  CASE WHEN doc_id % 5 = 0 THEN 'citizenship' ELSE 'unknown' END AS declared_document_type,
  {minutes(doc_id)} AS uploaded_at,
  doc_id * 20 AS event_seq
FROM documents
"""

CASE_REQUESTS = """
SELECT concat('case_', c_custkey) AS case_id,
  CASE WHEN c_acctbal < 0 THEN 'retail'
    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'individual_kyc'
    WHEN c_mktsegment = 'BUILDING' THEN 'business_kyb'
    WHEN c_mktsegment = 'FURNITURE' THEN 'loan_onboarding'
    WHEN c_mktsegment = 'MACHINERY' THEN 'document_digitization' END AS case_type,
  CASE WHEN c_nationkey = 7 THEN NULL ELSE c_name END AS applicant_name,
  concat('CBS-', c_custkey) AS customer_ref,
  CASE WHEN c_nationkey > 8 THEN concat('inst-', c_nationkey) END AS institution_id,
  CASE WHEN c_nationkey < 20 THEN concat('BR-', c_nationkey) END AS branch_code,
  {minutes(CAST(floor(c_custkey / 4.0) AS BIGINT))} AS created_at,
  c_custkey AS case_seq
FROM customer
"""

RECORDS = """
SELECT concat('rec_', o_orderkey) AS document_id,
  concat('form-', o_orderkey, '.png') AS filename,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'citizenship' WHEN '2-HIGH' THEN 'account_opening'
    WHEN '5-LOW' THEN 'vat' ELSE 'cheque' END AS document_type,
  {minutes(o_orderkey)} AS created_at
FROM orders
"""

# One SELECT per place in the list of observations; a null text is no observation.
_OBSERVATION = """
SELECT concat('rec_', k) AS document_id, CAST({seq} AS BIGINT) AS obs_seq, field_key, text,
  CAST({confidence} AS DOUBLE) AS confidence
FROM (SELECT k, c, {key} AS field_key, {text} AS text FROM o) s{seq}
WHERE text IS NOT NULL
"""


def _by_type(citizenship: str, account_opening: str, cheque: str) -> str:
    return (
        f"CASE t WHEN '1-URGENT' THEN {citizenship} WHEN '2-HIGH' THEN {account_opening} "
        f"WHEN '5-LOW' THEN 'unread' WHEN '4-NOT SPECIFIED' THEN "
        f"CASE WHEN s = 'P' THEN 'line' ELSE {cheque} END ELSE {cheque} END"
    )


_KEYS = (
    _by_type("'name'", "'customer_name'", "'cheque_number'"),
    _by_type("'dob'", "'mobile'", "'date'"),
    _by_type("'citizenship_number'", "'address'", "'amount'"),
    _by_type("'address'", "'account_type'", "'payee'"),
    _by_type("'father_mother_name'", "'pan'", "'amount'"),
    _by_type("'dob'", "'email'", "'memo'"),
)
_TEXTS = (
    _by_type(
        "concat('Customer ', cust)",
        "concat('Customer ', cust)",
        "concat(lpad(CAST(k AS STRING), 8, '0'), CASE WHEN s = 'F' THEN '*' ELSE '' END)",
    ),
    _by_type(
        "'27/05/2026'",
        "CASE s WHEN 'F' THEN '98410O0000' ELSE concat(' 98', lpad(CAST(k AS STRING), 8, '0'), chr(10)) END",
        "CASE s WHEN 'F' THEN '27/05/2026' ELSE day END",
    ),
    _by_type(
        "concat('27-01-', k, CASE s WHEN 'F' THEN ' ?' ELSE '' END)",
        "concat('Kathmandu-', cust)",
        "concat(CASE WHEN s = 'F' THEN 'Rs ' ELSE '' END, price)",
    ),
    _by_type("concat('Lalitpur-', cust)", "'Savings'", "CASE s WHEN 'P' THEN NULL ELSE concat('Customer ', cust) END"),
    _by_type(
        "CASE s WHEN 'O' THEN ' ' ELSE concat('Parent ', cust) END",
        "CASE s WHEN 'O' THEN lpad(CAST(k AS STRING), 9, '0') ELSE CAST(k AS STRING) END",
        "CASE s WHEN 'O' THEN '25000.00' END",
    ),
    _by_type(
        "CASE s WHEN 'F' THEN NULL ELSE day END",
        "concat('user', k, CASE s WHEN 'P' THEN ' at ' ELSE '@' END, 'example.com')",
        "'memo'",
    ),
)
_CONFIDENCES = ("c", "0.96 * c + 0.04", "0.99", "0.97", "0.95", "c")

OBSERVATIONS = (
    """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS s, o_orderpriority AS t,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
    CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS price,
    CAST(750 + (o_orderkey * 7) % 251 AS DOUBLE) / 1000 AS c
  FROM orders)
"""
    + " UNION ALL ".join(
        _OBSERVATION.format(
            seq=seq, confidence=_CONFIDENCES[seq - 1], key=_KEYS[seq - 1], text=_TEXTS[seq - 1]
        )
        for seq in range(1, 7)
    )
)

_DECISION = """CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject'
    WHEN 'signup' THEN 'APPROVE' ELSE 'save' END"""
_VALUE = """CASE WHEN event_id % 3 = 0 THEN 'bad value!'
    ELSE concat('98', lpad(CAST(event_id AS STRING), 8, '0')) END"""

CASE_REVIEWS = f"""
SELECT concat('case_', user_id) AS case_id, event_id * 2 + 1 AS event_seq,
  concat('reviewer_', event_id % 7) AS reviewer,
  {_DECISION} AS decision,
  concat('note ', event_id) AS note,
  CASE event_id % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'full_name' WHEN 2 THEN 'citizenship_number'
    WHEN 3 THEN concat('extra_', user_id, '_', event_id) END AS key_1,
  {_VALUE} AS value_1,
  CASE WHEN event_type = 'purchase' THEN 'pan' WHEN event_type = 'error' AND event_id % 5 <> 1
    THEN 'full_name' END AS key_2,
  props AS value_2,
  ts AS reviewed_at
FROM events
"""

DOCUMENT_REVIEWS = f"""
SELECT concat('rec_', user_id * 100 + event_id % 100) AS document_id,
  event_id * 2 + 1 AS event_seq,
  concat('reviewer_', event_id % 7) AS reviewer,
  {_DECISION} AS decision,
  concat('note ', event_id) AS note,
  CASE event_id % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'amount' WHEN 2 THEN 'citizenship_number'
    WHEN 3 THEN 'name' END AS key_1,
  {_VALUE} AS value_1,
  CASE WHEN event_type = 'purchase' THEN 'date' WHEN event_type = 'error' THEN 'no_such_key' END AS key_2,
  '2026-05-27' AS value_2,
  ts AS reviewed_at
FROM events
"""

RESPONSES = """
SELECT concat('doc_', doc_id) AS document_id,
  CASE doc_id % 13
    WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```')
    WHEN 1 THEN concat('Here is the JSON: ', body, ' done')
    WHEN 2 THEN concat(body, ' trailing')
    WHEN 3 THEN concat('{"document_type": "invoice", "summary": ', told, ', "fields": []}')
    WHEN 4 THEN concat('{"document_type": "pan", "fields": null, "summary": ', told, '}')
    WHEN 5 THEN concat('I could not read this: ', text)
    WHEN 6 THEN CAST(NULL AS STRING)
    WHEN 7 THEN concat('{"fields": [{"field": "x", "value": 0, "confidence": 0, "required": null, "evidence_text": ', told, '}]}')
    WHEN 9 THEN concat('{"fields": [{"key": "mobile", "value": "9841000000", "evidence_text": ', told, ', "bbox": [1.5, 2, 3, 4]}]}')
    WHEN 10 THEN concat('{"document_type":"cheque","fields":[{"key":"amount","label":"","value":"', doc_id,
      '.5","confidence":"0.9","source_page":"2","bbox":[]},{"key":"amount","value":"Rs ', doc_id,
      '","required":false,"evidence_text":', told, '}],"findings":""}')
    WHEN 11 THEN concat('{"document_type": "", "summary": ', told, ', "fields": {}, "findings": []}')
    ELSE body END AS content,
  CASE WHEN doc_id % 13 = 6 THEN concat('timeout after ', text) ELSE CAST(NULL AS STRING) END AS error,
  1 AS response_seq
FROM (SELECT doc_id, text, {json(text)} AS told, concat('{"document_type":"citizenship","summary":"s","fields":[{"key":"full_name","value":"N', doc_id,
  '","confidence":', CAST(CAST(doc_id % 1000 AS DECIMAL(10,3)) / 1000 AS DECIMAL(10,3)),
  ',"source_page":1,"evidence_text":', {json(text)}, ',"bbox":[1,2,3,4]}],"findings":[{"code":"needs_review","field_key":"full_name"}]}') AS body
  FROM documents) d
UNION ALL
SELECT concat('doc_', doc_id), concat('{"document_type":"vat","summary":', {json(text)}, '}'), NULL, 0
FROM documents WHERE doc_id % 17 = 3
"""

BINDINGS = {
    "b_uploads": UPLOADS,
    "b_requests": CASE_REQUESTS,
    "b_records": RECORDS,
    "b_observations": OBSERVATIONS,
    "b_case_reviews": CASE_REVIEWS,
    "b_document_reviews": DOCUMENT_REVIEWS,
    "b_responses": RESPONSES,
}

_JSON = re.compile(r"\{json\((\w+)\)\}")
_MINUTES = re.compile(r"\{minutes\((.*?)\)\}(?= AS )", re.DOTALL)


def for_duckdb(sql: str) -> str:
    sql = _JSON.sub(r"CAST(to_json(\1) AS VARCHAR)", sql)
    return _MINUTES.sub(r"TIMESTAMP '2024-01-01 00:00:00' + to_minutes(\1)", sql)


def for_spark(sql: str) -> str:
    sql = _JSON.sub(r"substr(to_json(array(\1)), 2, length(to_json(array(\1))) - 2)", sql)
    return _MINUTES.sub(
        r"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(\1 AS INT))", sql
    )


class Inputs:
    """The library's inputs, bound to one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _bind(self, name: str) -> DataFrame:
        sql = for_spark(BINDINGS[name])
        used = [table for table in TABLES if re.search(rf"\bFROM {table}\b", sql)]
        for table in used:
            view = f"given_{table}"
            self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").createOrReplaceTempView(view)
            sql = re.sub(rf"\bFROM {table}\b", f"FROM {view}", sql)
        return self.spark.sql(sql)

    @property
    def uploads(self) -> DataFrame:
        bytes_ = F.col("text").cast("binary")
        broken = F.concat(bytes_, F.unhex(F.lit("80FF")))
        return self._bind("b_uploads").select(
            "case_id",
            "document_id",
            "filename",
            F.when(F.col("corrupt"), broken).otherwise(bytes_).alias("content"),
            "declared_document_type",
            "uploaded_at",
            "event_seq",
        )

    @property
    def requests(self) -> DataFrame:
        return self._bind("b_requests")

    @property
    def records(self) -> DataFrame:
        return self._bind("b_records")

    @property
    def observations(self) -> DataFrame:
        return self._bind("b_observations")

    def _reviews(self, name: str) -> DataFrame:
        bound = self._bind(name)
        entries = F.array(
            F.struct(F.col("key_1").alias("key"), F.col("value_1").alias("value")),
            F.struct(F.col("key_2").alias("key"), F.col("value_2").alias("value")),
        )
        named = F.filter(entries, lambda entry: entry["key"].isNotNull())
        return bound.withColumn("field_updates", F.map_from_entries(named)).drop(
            "key_1", "value_1", "key_2", "value_2"
        )

    @property
    def case_reviews(self) -> DataFrame:
        return self._reviews("b_case_reviews")

    @property
    def document_reviews(self) -> DataFrame:
        return self._reviews("b_document_reviews")

    @property
    def responses(self) -> DataFrame:
        return self._bind("b_responses")
