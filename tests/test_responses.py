from dossier.operators.responses import clean_response, latest_responses, parse_responses, repeated_responses
from dossier.schemas import RESPONSES
from pyspark.sql import functions as F

FENCED = """```json
    {
      "document_type": "passport",
      "summary": "Two pages, one stamp",
      "fields": [{"key": "passport_no", "label": "Passport No", "value": "PB0917", "confidence": 0.77,
        "source_page": 2, "evidence_text": "No. PB0917", "bbox": [11, 22, 333, 44]}],
      "findings": [{"severity": "info", "code": "stamp_blurred",
        "message": "Entry stamp cannot be read", "field_key": "entry_date"}]
    }
    ```"""

# response -> accepted?
RESPONSES_SEEN = {
    FENCED: True,
    '{"document_type":"citizenship"} trailing': False,
    '{"document_type":"citizenship"}] , [': False,
    '{"document_type":"invoice"}': False,
    '{"document_type":5}': False,
    '{"document_type":false,"fields":{},"findings":""}': True,
    '{"fields":null}': False,
    '{"fields":0}': False,
    '{"fields":{"a":1}}': False,
    '{"fields":[1]}': False,
    '{"findings":null}': False,
    '{"findings":["x"]}': False,
    '{"findings":[{"field_key":3}]}': False,
    '{"findings":[{"field_key":null}]}': True,
    '{"fields":[{"bbox":[1.5,2,3,4]}]}': False,
    '{"fields":[{"bbox":[1,null]}]}': False,
    '{"fields":[{"bbox":[1.0,2,3,4]}]}': True,
    '{"fields":[{"bbox":{"x":1}}]}': True,
    '{"fields":[{"confidence":"high"}]}': False,
    '{"fields":[{"confidence":"0.9f"}]}': False,
    '{"fields":[{"confidence":[1]}]}': False,
    '{"fields":[{"confidence":" 0.9 "}]}': True,
    '{"fields":[{"source_page":"2.7"}]}': False,
    '{"fields":[{"source_page":2.7}]}': True,
    '{"fields":[{"source_page":1e12}]}': True,
    '{"fields":[{"source_page":1e20}]}': False,
    '{"fields":[{"source_page":9223372036854775807}]}': True,
    '{"fields":[{"source_page":9223372036854775808}]}': False,
    '{"fields":[{"bbox":[9223372036854775808]}]}': False,
    '{"fields":[{"bbox":[1e300]}]}': False,
    "[1]": False,
    "": False,
    "not json": False,
    "{'a': 1}": False,
}


def _parse(spark, contents):
    rows = [(str(n), content, None) for n, content in enumerate(contents)]
    parsed = parse_responses(spark.createDataFrame(rows, RESPONSES)).collect()
    return {contents[int(row.document_id)]: row for row in parsed}


def test_all_or_nothing(spark):
    parsed = _parse(spark, list(RESPONSES_SEEN))
    for content, accepted in RESPONSES_SEEN.items():
        row = parsed[content]
        assert (row.outcome == "parsed") == accepted, (content, row.failure)
        assert (row.failure is None) == accepted
    row = parsed[FENCED]
    field, finding = row.fields[0], row.findings[0]
    assert (row.document_type, row.summary) == ("passport", "Two pages, one stamp")
    assert (field.key, field.value, field.confidence, field.source_page) == ("passport_no", "PB0917", 0.77, 2)
    assert field.bbox == [11, 22, 333, 44] and field.evidence_bbox == field.bbox
    assert (finding.code, finding.field_key) == ("stamp_blurred", "entry_date")


def test_defaults_and_truth(spark):
    contents = [
        '{"fields":[{}]}',
        '{"fields":[{"field":"x","value":0,"confidence":0,"required":null}]}',
        '{"fields":[{"key":"k","value":true,"required":"false","confidence":true,"source_page":true}]}',
        '{"fields":[{"key":"","label":"","value":1.50,"confidence":1.005,"evidence_text":"","bbox":[]}]}',
        '{"fields":[{"value":"0","confidence":-3,"required":0,"label":7}]}',
    ]
    parsed = _parse(spark, contents)
    got = [parsed[c].fields[0] for c in contents]

    def short(f):
        return (f.key, f.label, f.value, f.confidence, f.required, f.source_page, f.evidence_text, f.bbox)

    assert [short(f) for f in got] == [
        ("unknown", "Unknown", "", 0.0, True, 1, "", None),
        ("x", "Unknown", "", 0.0, False, 1, "", None),
        ("k", "k", "True", 1.0, True, 1, "True", None),
        ("unknown", "Unknown", "1.5", 1.0, True, 1, "1.5", []),
        ("unknown", "7", "0", -3.0, False, 1, "0", None),
    ]


def test_numbers_read_as_python_prints_them(spark):
    printed = {
        "25000.00": "25000.0", "1.0": "1.0", "12345678.5": "12345678.5", "1e-5": "1e-05", "[1, 2]": "[1, 2]",
        "25000": "25000", "1e5": "100000.0", "0.00012": "0.00012", "1e16": "1e+16", "-2.50": "-2.5",
        "12345678901234567890": "12345678901234567890", "[true, null]": "[True, None]",
    }
    contents = {f'{{"fields":[{{"value":{json}}}]}}': text for json, text in printed.items()}
    parsed = _parse(spark, list(contents))
    assert {c: parsed[c].fields[0].value for c in contents} == contents


def test_digits_of_other_scripts_and_wide_integers(spark):
    content = '{"fields":[{"source_page":"٣","confidence":"९","bbox":[1,2,3,9999999999]},{"source_page":3000000000}]}'
    first, second = _parse(spark, [content])[content].fields
    assert (first.source_page, first.confidence, first.bbox[3]) == (3, 9.0, 9999999999)
    assert second.source_page == 3000000000


def test_last_response_counts(spark):
    rows = [("a", "{}", None, 1), ("a", '{"summary":"s"}', None, 2), ("b", None, "timeout", 1)]
    given = spark.createDataFrame(rows, "document_id string, content string, error string, response_seq int")
    got = {r.document_id: (r.content, r.error) for r in latest_responses(given).collect()}
    assert got == {"a": ('{"summary":"s"}', None), "b": (None, "timeout")}
    assert [tuple(r) for r in repeated_responses(given).collect()] == [("a", 2)]
    assert latest_responses(given.drop("response_seq")).count() == 2


def test_repeated_keys_keep_the_last(spark):
    content = '{"document_type":"pan","document_type":"vat","fields":[{"key":"a","key":"b"}]}'
    row = _parse(spark, [content])[content]
    assert (row.document_type, row.fields[0].key) == ("vat", "b")


def test_errors_and_silence(spark):
    rows = [("e", None, "timeout"), ("n", None, None)]
    got = {r.document_id: r for r in parse_responses(spark.createDataFrame(rows, RESPONSES)).collect()}
    assert (got["e"].outcome, got["e"].failure) == ("failed", "timeout")
    assert (got["n"].outcome, got["n"].failure) == ("no_response", None)


def test_cleaning(spark):
    expected = {
        "  {} ": "{}",
        "```json\n{}\n```": "{}",
        "```JSON\n{}```": "{}",
        "Here is it: {\"a\": {}} bye": '{"a": {}}',
        "Here is nothing": "Here is nothing",
        "Here is } {": "Here is } {",
        "There {}": "There {}",
        "{\"a\": \"```\"}": "{\"a\": \"```\"}",
    }
    rows = spark.createDataFrame([(t,) for t in expected], "t string")
    for row in rows.select("t", clean_response(F.col("t")).alias("c")).collect():
        assert row.c == expected[row.t], row.t


def test_whole_numbers_keep_all_digits(spark):
    big = 9007199254740993
    content = f'{{"fields":[{{"source_page":{big},"bbox":[{big},-{big},9223372036854775807]}},{{"source_page":"{big}"}}]}}'
    row = _parse(spark, [content])[content]
    assert [field.source_page for field in row.fields] == [big, big]
    assert row.fields[0].bbox == [big, -big, 9223372036854775807]


def test_responses_without_text(spark):
    """Shapes that hold no text of the document."""
    rows = [("0", None, None), ("1", None, "timeout"), ("2", '{"document_type": "invoice", "fields": []}', None)]
    got = {r.document_id: (r.outcome, r.failure) for r in parse_responses(spark.createDataFrame(rows, RESPONSES)).collect()}
    assert got == {"0": ("no_response", None), "1": ("failed", "timeout"), "2": ("failed", "unknown document type invoice")}
