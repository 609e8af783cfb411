"""Model responses: cleaning and all-or-nothing parsing.

A response is parsed inside its own row into ``array<struct>`` columns. One
malformed member rejects the whole response, so the verdict is a column too
and nothing is exploded before it is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.rounding import float_text, round2
from dossier.functions.rows import exploded, with_computed
from dossier.functions.text import WHITESPACE_CLASS, ascii_digits, strip
from dossier.operators.rules import finding
from dossier.schemas import DOCUMENT_TYPES, MODEL_EXTRACTOR

# Code fences at a line's start or end, and defaults of absent members.
FENCES = rf"(?imd)^```(?:json)?[{WHITESPACE_CLASS}]*|[{WHITESPACE_CLASS}]*```$"
PREAMBLE = "Here is"
SOURCE = "gemma_reasoning"
DEFAULT_KEY = "unknown"
DEFAULT_LABEL = "Unknown"
DEFAULT_SEVERITY = "warning"
DEFAULT_CODE = "gemma_finding"
FAILURE_CODE = "gemma_unavailable"
FAILURE_PREFIX = "Gemma 4 26B extraction fell back to deterministic extraction: "

# JSON text of the values Python counts as false.
_FALSY = r'^(?:null|""|false|\[\]|\{\}|-?0(?:\.0+)?(?:[eE][+-]?\d+)?)$'
# A list that holds neither text nor objects.
_PLAIN_LIST = r'^\[[^"{]*\]$'
# Text that Python's float() and int() read as a number, digits being ASCII ones.
_FLOAT_TEXT = r"(?i)\A[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)\z"
_INT_TEXT = r"\A[+-]?\d+\z"
_FIELD_MEMBERS = (
    "key",
    "field",
    "label",
    "value",
    "confidence",
    "required",
    "source_page",
    "evidence_text",
    "bbox",
)
_FINDING_MEMBERS = ("severity", "code", "message", "field_key")


def clean_response(content: Column) -> Column:
    """Strip blanks, code fences and a chatty preamble around the JSON object."""
    bare = strip(F.regexp_replace(strip(content), FENCES, ""))
    start = F.instr(bare, "{")
    end = F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    trimmed = F.substr(bare, start, end - start + 1)
    has_object = (start > 0) & F.contains(bare, F.lit("}")) & (end > start)
    return F.when(F.startswith(bare, F.lit(PREAMBLE)) & has_object, trimmed).otherwise(bare)


def strict_json(text: Column) -> Column:
    """The text as a variant, null unless it is exactly one JSON value.

    ``try_parse_json`` stops at the end of the first value and ignores what
    follows. Parsed as the first element of an array that must end with the
    text's own digest, text with anything after its value cannot pass.
    """
    digest = F.md5(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    whole = F.try_variant_get(pair, "$[1]", "string") == digest
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def _members(item: Column, names: tuple[str, ...]) -> Column:
    """struct of the named members, each as struct<json, text, type>.

    ``json`` is the member's compact JSON text, null when absent; its first
    character tells the type. ``text`` is its value as a string, ``type`` the type
    of a number: the JSON text no longer tells 1 from 1.0.
    """

    def member(name: str) -> Column:
        path = f"$.{name}"
        value = F.try_variant_get(item, path, "variant")
        json = F.to_json(value)
        return F.struct(
            json.alias("json"),
            F.try_variant_get(item, path, "string").alias("text"),
            F.when(json.rlike(r"^-?\d"), F.schema_of_variant(value)).alias("type"),
        ).alias(name)

    return F.struct(*[member(name) for name in names])


def _kind(member: Column) -> Column:
    return F.left(member["json"], F.lit(1))


def _truthy(member: Column) -> Column:
    """Python's truth of the member; absent counts as false."""
    return member["json"].isNotNull() & ~member["json"].rlike(_FALSY)


def _text_or(member: Column, fallback) -> Column:
    """``str(member or fallback)``: ``True``, floats and lists as Python prints them."""
    is_float = (member["type"] == "DOUBLE") | (
        # Whole numbers of more than 18 digits are decimals as well.
        member["type"].startswith("DECIMAL")
        & ~((F.length(member["text"]) > 18) & ~F.contains(member["text"], F.lit(".")))
    )
    listed = F.replace(member["json"], F.lit(","), F.lit(", "))
    for json, python in (("true", "True"), ("false", "False"), ("null", "None")):
        listed = F.replace(listed, F.lit(json), F.lit(python))
    text = (
        F.when(member["json"] == "true", "True")
        .when(is_float, float_text(member["text"].try_cast("double")))
        .when(member["json"].rlike(_PLAIN_LIST), listed)
        .otherwise(member["text"])
    )
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(_truthy(member), text).otherwise(fallback)


def _number(member: Column) -> Column:
    return F.when(member["json"] == "true", 1.0).otherwise(
        ascii_digits(strip(member["text"])).try_cast("double")
    )


def _whole(member: Column) -> Column:
    """``int(...)`` of the member as a long: all digits of whole numbers, cut-off fractions."""
    text = ascii_digits(strip(member["text"]))
    return F.when(text.rlike(_INT_TEXT), text.try_cast("decimal(38,0)").try_cast("long")).otherwise(
        _number(member).try_cast("long")
    )


def _unconvertible(member: Column, text_pattern: str) -> Column:
    """A list, an object, or text that does not read as a number."""
    bad_text = (_kind(member) == '"') & ~ascii_digits(strip(member["text"])).rlike(text_pattern)
    return _truthy(member) & (_kind(member).isin("[", "{") | bad_text)


def _items(payload: Column, member: Column, name: str) -> Column:
    """The list's items as array<variant>; anything else counts as empty."""
    listed = F.try_variant_get(payload, f"$.{name}", "array<variant>")
    return F.when(_kind(member) == "[", listed).otherwise(F.array().cast("array<variant>"))


def _read_field(item: Column) -> Column:
    return F.struct(
        (F.left(F.to_json(item), F.lit(1)) == "{").alias("is_object"),
        _members(item, _FIELD_MEMBERS).alias("has"),
        F.try_variant_get(item, "$.bbox", "array<double>").alias("edges"),
        # The same with all digits.
        F.try_variant_get(item, "$.bbox", "array<decimal(38,18)>").alias("exact"),
    )


def _read_finding(item: Column) -> Column:
    return F.struct(
        (F.left(F.to_json(item), F.lit(1)) == "{").alias("is_object"),
        _members(item, _FINDING_MEMBERS).alias("has"),
    )


def _field_fault(read: Column) -> Column:
    """Why the field cannot be accepted, null when it can."""
    has = read["has"]
    page, box = has["source_page"], has["bbox"]
    too_large = _truthy(page) & _whole(page).isNull()
    # Fractions too small for the exact form are seen in the other one.
    whole_numbers = F.forall(read["edges"], lambda edge: edge.isNotNull() & (edge == F.floor(edge)))
    exactly_whole = F.forall(
        read["exact"], lambda edge: (edge == F.floor(edge)) & edge.try_cast("bigint").isNotNull()
    )
    return (
        F.when(~read["is_object"], "a field is not an object")
        .when(
            _unconvertible(page, _INT_TEXT) | too_large, "source_page is not an integer"
        )
        .when(_unconvertible(has["confidence"], _FLOAT_TEXT), "confidence is not a number")
        .when(
            (_kind(box) == "[") & ~F.coalesce(whole_numbers & exactly_whole, F.lit(False)),
            "bbox is not a list of integers",
        )
    )


def _finding_fault(read: Column) -> Column:
    field_key = read["has"]["field_key"]
    return F.when(~read["is_object"], "a finding is not an object").when(
        ~_kind(field_key).isin('"', "n"), "field_key is not text"
    )


def _list_fault(member: Column, name: str, items: Column, item_fault) -> Column:
    listed = (
        member["json"].isNull() | (_kind(member) == "[") | member["json"].isin("{}", '""')
    )
    faults = F.array_compact(F.transform(items, item_fault))
    return F.when(~listed, f"{name} is not a list of objects").otherwise(
        F.get(faults, F.lit(0))
    )


def _unrounded_field(read: Column) -> Column:
    has = read["has"]
    page, confidence, required = has["source_page"], has["confidence"], has["required"]
    bbox = F.when(_kind(has["bbox"]) == "[", read["exact"].try_cast("array<bigint>"))
    value = _text_or(has["value"], "")
    return F.struct(
        _text_or(has["key"], _text_or(has["field"], DEFAULT_KEY)).alias("key"),
        _text_or(has["label"], _text_or(has["key"], DEFAULT_LABEL)).alias("label"),
        value.alias("value"),
        F.when(_truthy(confidence), _number(confidence)).otherwise(0.0).alias("confidence"),
        (required["json"].isNull() | _truthy(required)).alias("required"),
        bbox.alias("bbox"),
        F.when(_truthy(page), _whole(page)).otherwise(1).alias("source_page"),
        _text_or(has["evidence_text"], value).alias("evidence_text"),
    )


def _field(unrounded: Column) -> Column:
    return F.struct(
        unrounded["key"].alias("key"),
        unrounded["label"].alias("label"),
        unrounded["value"].alias("value"),
        round2(unrounded["confidence"]).alias("confidence"),
        unrounded["required"].alias("required"),
        F.lit(SOURCE).alias("source"),
        unrounded["bbox"].alias("bbox"),
        unrounded["source_page"].alias("source_page"),
        unrounded["bbox"].alias("evidence_bbox"),
        unrounded["evidence_text"].alias("evidence_text"),
        F.lit(MODEL_EXTRACTOR).alias("extracted_by"),
    )


def _finding(read: Column) -> Column:
    has = read["has"]
    return finding(
        _text_or(has["severity"], DEFAULT_SEVERITY),
        _text_or(has["code"], DEFAULT_CODE),
        _text_or(has["message"], ""),
        has["field_key"]["text"],
    )


def latest_responses(responses: DataFrame) -> DataFrame:
    """One response per document: that with the highest ``response_seq``, if there is one.

    Equal numbers, or none, leave it to the content which response counts, so that a
    rerun gives the same answer.
    """
    given = "response_seq" in responses.columns
    number = F.col("response_seq") if given else F.lit(0)
    place = F.struct(number, F.xxhash64("content", "error"), "content")
    last = F.max_by(F.struct("content", "error"), place)
    return responses.groupBy("document_id").agg(last.alias("last")).select("document_id", "last.*")


def repeated_responses(responses: DataFrame) -> DataFrame:
    """Documents with several responses, and how many they have."""
    counted = responses.groupBy("document_id").agg(F.count(F.lit(1)).alias("responses"))
    return counted.filter(F.col("responses") > 1)


def parse_responses(responses: DataFrame, *kept: str) -> DataFrame:
    """What each response says, or why it cannot be used.

    Columns: document_id, outcome (``parsed``, ``failed``, ``no_response``),
    failure, document_type, summary, fields, findings, and those ``kept``.
    """
    payload, top = F.col("payload"), F.col("top")
    opened = with_computed(
        responses.select("document_id", "content", "error", *kept),
        {"payload": strict_json(clean_response(F.col("content")))},
    )
    listed = with_computed(
        opened,
        {"top": _members(payload, ("document_type", "summary", "fields", "findings"))},
    )
    read = with_computed(
        listed,
        {
            "named_type": _text_or(top["document_type"], "unknown"),
            "read_fields": F.transform(_items(payload, top["fields"], "fields"), _read_field),
            "read_findings": F.transform(
                _items(payload, top["findings"], "findings"), _read_finding
            ),
        },
    )
    fault = F.coalesce(
        F.col("error"),
        F.when(payload.isNull(), "response is not strict JSON"),
        F.when(F.left(F.to_json(payload), F.lit(1)) != "{", "response is not an object"),
        F.when(
            ~F.col("named_type").isin(*DOCUMENT_TYPES),
            F.concat(F.lit("unknown document type "), F.col("named_type")),
        ),
        _list_fault(top["fields"], "fields", F.col("read_fields"), _field_fault),
        _list_fault(top["findings"], "findings", F.col("read_findings"), _finding_fault),
    )
    answered = F.col("content").isNotNull() | F.col("error").isNotNull()
    judged = with_computed(
        read.withColumn("answered", answered), {"failure": F.when(answered, fault)}
    ).withColumn(
        "outcome",
        F.when(~F.col("answered"), "no_response")
        .when(F.col("failure").isNotNull(), "failed")
        .otherwise("parsed"),
    )
    parsed = F.col("outcome") == "parsed"
    fields = F.transform(F.transform(F.col("read_fields"), _unrounded_field), _field)
    return judged.select(
        "document_id",
        "outcome",
        "failure",
        F.when(parsed, F.col("named_type")).alias("document_type"),
        F.when(parsed, _text_or(top["summary"], "")).alias("summary"),
        F.when(parsed, fields).alias("fields"),
        F.when(parsed, F.transform("read_findings", _finding)).alias("findings"),
        *kept,
    )


def model_fields(parsed: DataFrame) -> DataFrame:
    """One row per field of the accepted responses."""
    return exploded(parsed, ["document_id"], "fields", "field_seq", "field").select(
        "document_id", "field_seq", "field.*"
    )


def model_findings(parsed: DataFrame) -> DataFrame:
    """One row per finding of the accepted responses."""
    return exploded(parsed, ["document_id"], "findings", "finding_seq", "finding").select(
        "document_id", "finding_seq", "finding.*"
    )


def model_failures(parsed: DataFrame) -> DataFrame:
    """Responses that cannot be used, with the reason."""
    return parsed.filter(F.col("outcome") == "failed").select("document_id", "failure")
