"""Fields read by template from recognised texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.rounding import round2
from dossier.functions.scoring import overall_confidence, route
from dossier.functions.validation import validate
from dossier.schemas import DEFAULT_EXTRACTOR, DEFAULT_REVIEW_STATUS

# Fixed values of the raw-text field.
RAW_KEY = "raw_text"
RAW_LABEL = "Raw OCR Text"
RAW_CONFIDENCE = 0.50
RAW_STATUS = "warning"
RAW_MESSAGE = "Raw OCR text requires reviewer mapping"


def latest_observations(observations: DataFrame) -> DataFrame:
    """The last observation per document and key.

    A plain aggregate: repeats are reduced before the shuffle, so a document
    with very many of them does not pile up in one task.
    """
    return (
        observations.groupBy(
            "document_id", F.coalesce("field_key", F.lit("None")).alias("key")
        )
        .agg(F.max_by(F.struct("text", "confidence"), F.struct("obs_seq", "text", "confidence")).alias("last"))
        .select("document_id", "key", "last.text", "last.confidence")
    )


def template_fields(
    documents: DataFrame, observations: DataFrame, template_table: DataFrame
) -> DataFrame:
    """Every template field of every document, observed or not.

    ``documents`` needs document_id and document_type.
    """
    keys = template_table.select(F.col("key").alias("field_key"))
    wanted = observations.join(keys, "field_key", "left_semi")
    expected = documents.select("document_id", "document_type").join(
        template_table, "document_type"
    )
    filled = (
        expected.join(latest_observations(wanted), ["document_id", "key"], "left")
        .withColumn("value", F.coalesce("text", F.lit("")))
        .withColumn(
            "check", validate(F.col("key"), F.col("value"), F.col("document_type"))
        )
    )
    return filled.select(
        "document_id",
        "document_type",
        "field_seq",
        "key",
        "label",
        "value",
        round2(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        "required",
        F.lit("template").alias("source"),
        F.col("check.status").alias("validation_status"),
        F.col("check.message").alias("validation_message"),
        F.col("bbox").cast("array<bigint>").alias("bbox"),
        F.lit(DEFAULT_EXTRACTOR).alias("extracted_by"),
        F.lit(DEFAULT_REVIEW_STATUS).alias("review_status"),
    )


def raw_text_fields(fields: DataFrame, observations: DataFrame) -> DataFrame:
    """One raw-text field per document none of whose template fields has a value.

    Only those documents' texts are shuffled. The field stands behind the template's
    own fields and holds all lines of its document, which is as long as the document.
    """
    unread = (
        fields.groupBy("document_id", "document_type")
        .agg(
            F.bool_or(F.col("value") != "").alias("read"),
            F.count(F.lit(1)).cast("int").alias("field_seq"),
        )
        .filter(~F.col("read"))
        .select("document_id", "document_type", "field_seq")
    )
    lines = observations.join(unread, "document_id")
    texts = lines.groupBy("document_id", "document_type", "field_seq").agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("obs_seq", F.coalesce("text", F.lit("")).alias("text")))
                ),
                lambda line: line["text"],
            ),
            "\n",
        ).alias("value")
    )
    return texts.filter(F.col("value") != "").select(
        "document_id",
        "document_type",
        "field_seq",
        F.lit(RAW_KEY).alias("key"),
        F.lit(RAW_LABEL).alias("label"),
        "value",
        F.lit(RAW_CONFIDENCE).alias("confidence"),
        F.lit(False).alias("required"),
        F.lit("ocr").alias("source"),
        F.lit(RAW_STATUS).alias("validation_status"),
        F.lit(RAW_MESSAGE).alias("validation_message"),
        F.lit(None).cast("array<bigint>").alias("bbox"),
        F.lit(DEFAULT_EXTRACTOR).alias("extracted_by"),
        F.lit(DEFAULT_REVIEW_STATUS).alias("review_status"),
    )


def score_documents(fields: DataFrame) -> DataFrame:
    """Overall confidence and route per document."""
    scored = fields.groupBy("document_id").agg(
        overall_confidence(F.col("confidence"), F.col("required")).alias("overall_confidence")
    )
    return scored.withColumn("status", route(F.col("overall_confidence")))


def document_records(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents read by template with their score and status.

    ``documents`` needs document_id, filename, document_type and created_at.
    """
    return documents.join(score_documents(fields), "document_id").select(
        "document_id",
        "filename",
        "document_type",
        "status",
        "overall_confidence",
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
