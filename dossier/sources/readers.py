"""Scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import schemas
from dossier.functions.order import in_order
from dossier.functions.text import stable_id


# Partition columns are named as text: an id of digits stays as it is.
_UPLOADED_FILES = (
    "path string, modificationTime timestamp, length long, content binary, "
    "case_id string, declared_document_type string"
)


def read_uploads(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Files under ``case_id=<id>/declared_document_type=<type>/`` as uploads.

    Both are partition columns, so a filter on them leaves other folders unread; an
    upload without a declared type lies under ``unknown``. The sequence number of an upload is its modification time in microseconds.
    """
    reader = spark.readStream if streaming else spark.read
    files = reader.format("binaryFile").schema(_UPLOADED_FILES).load(path)
    uploaded_at = F.col("modificationTime")
    return files.select(
        "case_id",
        stable_id("doc", F.col("path")).alias("document_id"),
        F.regexp_extract("path", "[^/]+$", 0).alias("filename"),
        "content",
        F.coalesce("declared_document_type", F.lit("unknown")).alias("declared_document_type"),
        uploaded_at.cast("timestamp_ntz").alias("uploaded_at"),
        F.unix_micros(uploaded_at).alias("event_seq"),
    )


def _read(spark: SparkSession, path: str, schema, format_: str) -> DataFrame:
    return spark.read.schema(schema).format(format_).load(path)


def read_observations(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    """Recognised texts per document, in ``obs_seq`` order."""
    return _read(spark, path, schemas.OBSERVATIONS, format_)


def read_responses(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    """One model response (or the error that came instead) per document."""
    return _read(spark, path, schemas.RESPONSES, format_)


def read_case_requests(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.CASE_REQUESTS, format_)


def read_reviews(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.REVIEWS, format_)


def audit_rows(
    spark: SparkSession,
    path: str,
    since: str | None = None,
    until: str | None = None,
    run_ids: Sequence[str] = (),
) -> DataFrame:
    """Audit rows as ``writers.append_audit`` laid them down.

    ``since`` and ``until`` (days, both included) and ``run_ids`` leave other folders
    unread.
    """
    rows = spark.read.schema(f"{schemas.AUDIT}, run_id string, day date").parquet(path)
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("day") <= F.lit(until).cast("date"))
    if run_ids:
        rows = rows.filter(F.col("run_id").isin(*run_ids))
    return rows


def read_audit(spark: SparkSession, path: str, *, targets: DataFrame | None = None, **scanned) -> DataFrame:
    """``audit_rows``, of the target_ids in ``targets`` if given, with their ``place``.

    Rows come by time; those of one time by target and event, so the places do not
    depend on files or runs.
    """
    rows = audit_rows(spark, path, **scanned)
    if targets is not None:
        rows = rows.join(targets.select("target_id").distinct(), "target_id", "left_semi")
    return in_order(rows, "created_at", "target_id", "event_seq", "sub_seq", "action", "actor", "note")


def named(uploads: DataFrame) -> DataFrame:
    """Adds the ``stored_name`` of an upload; it also serves for an empty filename.

    An upload that declares no type is of type ``unknown``.

    The stored name is the upload time to the microsecond, a dash, the filename.
    """
    stored = stored_name(F.col("filename"), F.col("uploaded_at"))
    filled = {"stored_name": stored}
    if "declared_document_type" in uploads.columns:
        filled["declared_document_type"] = F.coalesce("declared_document_type", F.lit("unknown"))
    return uploads.withColumns(filled).withColumn(
        "filename", F.coalesce(F.nullif("filename", F.lit("")), "stored_name")
    )


def stored_name(filename: Column, at: Column) -> Column:
    moment = F.date_format(at, "yyyyMMddHHmmssSSSSSS")
    return F.concat(moment, F.lit("-"), F.coalesce(filename, F.lit("None")))
