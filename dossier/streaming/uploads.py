"""Uploads, and answers to them, processed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from dossier.operators.blocks import block_table, with_pages
from dossier.operators.intake import check_domain
from dossier.operators.responses import parse_responses
from dossier.plans.processing import (
    document_fields,
    document_findings,
    document_signals,
    process_documents,
    resolve,
)
from dossier.schemas import PARSED
from dossier.streaming.layout import BUCKETS, bucket, bucket_numbers, read_log, write_bucketed


def stream_blocks(
    uploads: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append the text blocks of arriving uploads to ``path``.

    Blocks are numbered inside the row, so there is no state to keep.
    """
    return (
        block_table(with_pages(uploads))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_documents(
    uploads: DataFrame,
    cases: DataFrame,
    path: str,
    checkpoint: str,
    responses: DataFrame | None = None,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Process arriving uploads with the batch code, one folder per micro-batch.

    A document arrives in one row, so a micro-batch needs nothing from earlier
    ones. A micro-batch that runs again overwrites its own folders, so a replay
    leaves the tables as they were. The log of fields is laid out in buckets of cases,
    for a stream of reviews to read as it grows (``reviews.stream_reviews``).
    """
    spark = uploads.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        _write_documents(spark, process_documents(batch, cases, responses), path, batch_id, buckets)

    return (
        uploads.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _write_documents(spark: SparkSession, found: DataFrame, path: str, batch_id: int, buckets: int) -> None:
    """A batch's documents with their findings and, last and in buckets of cases, fields."""
    folder = f"{path}/documents/batch={batch_id}"
    found.write.mode("overwrite").parquet(folder)
    documents = spark.read.schema(found.schema).parquet(folder)
    document_findings(documents).write.mode("overwrite").parquet(f"{path}/findings/batch={batch_id}")
    fields = document_fields(documents).withColumn("bucket", bucket("case_id", buckets))
    write_bucketed(fields, f"{path}/fields/batch={batch_id}")


def stream_answered_documents(
    uploads: DataFrame,
    responses: DataFrame,
    cases: DataFrame,
    path: str,
    checkpoint: str,
    wait: str = "1 hour",
    delay: str = "10 minutes",
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Process uploads when they are answered, or after ``wait`` without an answer.

    ``responses`` is a stream too, with the time of each answer in ``responded_at``. A
    stream-stream outer join holds what was read off a document, not its text, until an
    answer to it comes or the watermark (``delay`` behind the newest event) has passed
    ``wait``; such a document is read by rules. Every answer is logged as well, past the
    join: one that comes later still, or a better one, corrects the document. A batch
    looks up the log's buckets of its own documents only.
    """
    spark = uploads.sparkSession
    accepted, _ = check_domain(uploads, "upload")
    signals = document_signals(accepted).withColumn("asked_at", F.col("uploaded_at").cast("timestamp"))
    answers = responses.withColumn("responded_at", F.col("responded_at").cast("timestamp"))
    told = answers.select(F.col("document_id").alias("told_id"), "responded_at").withWatermark("responded_at", delay)
    window = f"responded_at BETWEEN asked_at - INTERVAL {wait} AND asked_at + INTERVAL {wait}"
    joined = signals.withWatermark("asked_at", delay).join(
        told, F.expr(f"document_id = told_id AND {window}"), "left_outer"
    )
    # Uploads to unknown cases go on until here, so that they move the watermark too.
    known = joined.join(cases.select("case_id", "case_type"), "case_id")
    names = [name for name in signals.columns if name not in ("document_id", "asked_at")]
    ready = known.select("document_id", F.struct(*names, "case_type").alias("signals"), F.lit("signals").alias("kind"))
    # Answers are read as they come; of several to a document the last one counts.
    place = F.struct("response_seq", F.xxhash64("content", "error").alias("content"))
    read = parse_responses(answers.withColumn("place", place), "place")
    verdict = F.struct(*PARSED.names).alias("verdict")
    logged = read.select("document_id", verdict, "place", F.lit("answer").alias("kind"))
    rows = ready.unionByName(logged, allowMissingColumns=True)
    schema = StructType(list(rows.drop("kind").schema.fields))
    log = f"{path}/arrived"

    def process(batch: DataFrame, batch_id: int) -> None:
        # Written once: evaluating the batch again would run the join again.
        write_bucketed(
            batch.withColumn("bucket", bucket("document_id", buckets)), f"{log}/batch={batch_id}", "kind", "bucket"
        )
        found = read_log(spark, log, schema, "kind", "bucket").filter(F.col("batch") <= batch_id)
        own = found.filter(F.col("batch") == batch_id)
        numbers = bucket_numbers(own)
        if not numbers:
            return
        touched = found.filter(F.col("bucket").isin(numbers))
        touched = touched.join(own.select("document_id").distinct(), "document_id", "left_semi")
        # A document met by several answers was handed on several times.
        asked = touched.filter("kind = 'signals'").groupBy("document_id").agg(F.any_value("signals").alias("signals"))
        last = F.max_by("verdict", "place").alias("verdict")
        verdicts = touched.filter("kind = 'answer'").groupBy("document_id").agg(last)
        answered = asked.join(verdicts, "document_id", "left").select("document_id", "signals.*", "verdict.*")
        _write_documents(spark, resolve(answered), path, batch_id, buckets)

    return (
        rows.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def streamed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``documents``, ``fields`` or ``findings`` written so far."""
    return spark.read.parquet(f"{path}/{name}").drop("batch", "bucket")


def corrected(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The same, each document as the last batch that had it left it."""
    last = spark.read.parquet(f"{path}/documents").groupBy("document_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.join(last, ["document_id", "batch"], "left_semi").drop("batch", "bucket")
