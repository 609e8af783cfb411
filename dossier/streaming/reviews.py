"""Reviews applied as they arrive: fields, last decision and audit rows.

What reviews have changed is kept as state (``layout``): per field the number, the last
and the first of its mentions, and per target its last decision. All of these can be
merged, so a batch folds its own mentions only and merges them with the state of the
buckets it touches. The order of reviews is their ``event_seq``, not their arrival, and
late reviews need neither a watermark nor the reviews before them. The fields themselves
are not rewritten; they meet the state when they are read.

Fields may go on arriving: given the folder of an upload stream's log, each batch reads
it up to the last complete batch. A field that arrives late, with mentions of its key
behind it already applied, takes these over: only for such keys is the log of reviews
read again, from their buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from dossier.operators.audit import reviewed as audit_rows
from dossier.operators.reviews import (
    apply_document_changes,
    apply_targets,
    arrivals,
    document_changes,
    fold_mentions,
    last_reviews,
    mention_places,
)
from dossier.session import discard, exists, materialise
from dossier.streaming.layout import (
    BUCKETS,
    State,
    bucket,
    bucket_numbers,
    last_batch,
    read_log,
    write_bucketed,
)

# What the reviews of one kind are about, and what audit actions call it.
SUBJECTS = {"case_id": "case", "document_id": "review"}
# What a stream keeps; a job that shows only some of it need not keep the rest.
TABLES = ("changes", "decisions", "audit")

# What the fold reads of fields.
ARRIVED = "case_id string, document_id string, field_id string, event_seq bigint, field_seq int, key string"
_PLACE = "struct<event_seq:bigint,kind:int,document_id:string,sub_seq:int>"
CHANGES = {
    "case_id": (
        f"case_id string, key string, target string, times bigint, last struct<place:{_PLACE},value:string>, "
        f"first {_PLACE}"
    ),
    "document_id": "document_id string, key string, last struct<event_seq:bigint,mention_seq:int,value:string>",
}
_DECISION = (
    "place struct<event_seq:bigint,reviewed_at:timestamp_ntz,reviewer:string,decision:string,note:string>, "
    "review struct<reviewer:string,note:string,reviewed_at:timestamp_ntz,status_after:string>"
)


def lay_out(fields: DataFrame, log: str, buckets: int = BUCKETS) -> None:
    """Write what the fold reads of ``fields`` as the only batch of a log, in buckets of cases."""
    names = StructType.fromDDL(ARRIVED).names
    write_bucketed(fields.select(*names, bucket("case_id", buckets).alias("bucket")), f"{log}/batch=0")


def known_fields(spark: SparkSession, log: str, upto: int, numbers: list[int] | None = None) -> DataFrame:
    """What the fold reads of a log of fields up to a batch; of the given buckets only."""
    held = read_log(spark, log, StructType.fromDDL(ARRIVED)).filter(F.col("batch") <= upto)
    return held if numbers is None else held.filter(F.col("bucket").isin(numbers))


def _kept(rows: DataFrame, spare: list[DataFrame]) -> DataFrame:
    """The rows as a table that is deleted at the end of the batch."""
    spare.append(materialise(rows, "batch"))
    return spare[-1]


def _late_keys(state: State, log: str, upto: int, spare: list[DataFrame]) -> DataFrame | None:
    """Keys of fields new to the log that came before a mention already applied."""
    above, newest = state.facts.get("fields", -1), state.facts.get("newest", {})
    if upto <= above or not newest:
        return None
    entries = [F.lit(part) for number, seq in newest.items() for part in (int(number), seq)]
    # Nothing in a bucket is late that is younger than the newest mention there.
    young = F.col("event_seq") > F.element_at(F.create_map(*entries), F.col("bucket").cast("int"))
    fresh = known_fields(state.spark, log, upto).filter(F.col("batch") > above)
    fresh = _kept(arrivals(fresh.filter(~young), "bucket"), spare)
    numbers = bucket_numbers(fresh)
    if not numbers:
        return None
    applied = state.read("changes", CHANGES["case_id"], numbers)
    ends = applied.groupBy("case_id", "key").agg(F.max("last.place").alias("end"))
    late = fresh.join(ends, ["case_id", "key"]).filter("place < end")
    return _kept(late.select("case_id", "key", "bucket").distinct(), spare)


def _merge_cases(
    state: State, new: DataFrame, batch_id: int, path: str, log: str, upto: int, spare: list[DataFrame]
) -> DataFrame:
    """Changes of the buckets touched, this batch's mentions and late fields included."""
    spark, numbers, places = state.spark, bucket_numbers(new), mention_places(new)
    late = _late_keys(state, log, upto, spare)
    if late is not None:
        late_numbers = bucket_numbers(late)
        numbers = sorted({*numbers, *late_numbers})
        # Their mentions are attributed anew, from the first one on.
        before = read_log(spark, f"{path}/reviews", new.drop("bucket").schema)
        before = before.filter((F.col("batch") < batch_id) & F.col("bucket").isin(late_numbers))
        keys = late.select("case_id", "key")
        places = places.unionByName(mention_places(before).join(keys, ["case_id", "key"], "left_semi"))
    held = state.read("changes", CHANGES["case_id"], numbers)
    if late is not None:
        held = held.join(keys, ["case_id", "key"], "left_anti")
    places = _kept(places, spare)
    arrived = arrivals(known_fields(spark, log, upto, numbers))
    arrived = arrived.join(places.select("case_id", "key").distinct(), ["case_id", "key"], "left_semi")
    return (
        held.unionByName(fold_mentions(arrived, places))
        .groupBy("case_id", "key", "target")
        .agg(F.sum("times").alias("times"), F.max("last").alias("last"), F.min("first").alias("first"))
    )


def _merge_documents(state: State, new: DataFrame) -> DataFrame:
    held = state.read("changes", CHANGES["document_id"], bucket_numbers(new))
    merged = held.unionByName(document_changes(new)).groupBy("document_id", "key")
    return merged.agg(F.max("last").alias("last"))


def apply_review_batch(
    batch: DataFrame,
    batch_id: int,
    fields: DataFrame | str,
    path: str,
    target: str = "case_id",
    buckets: int = BUCKETS,
    tables: tuple[str, ...] = TABLES,
) -> None:
    """Log the batch's reviews, merge them into the state, and add their audit rows.

    ``fields``: a table that stays as it is, or the folder of a growing log of fields.
    A batch without reviews still takes in fields that arrived late.
    """
    spark, spare = batch.sparkSession, []
    write_bucketed(batch.withColumn("bucket", bucket(target, buckets)), f"{path}/reviews/batch={batch_id}")
    stored = StructType(list(batch.schema.fields)).add("bucket", "long")
    new = spark.read.schema(stored).parquet(f"{path}/reviews/batch={batch_id}")
    state = State(spark, path, before=batch_id)
    if "changes" in tables and target == "case_id":
        log = fields if isinstance(fields, str) else f"{path}/arrived"
        if log is not fields and not exists(spark, log):
            lay_out(fields, log, buckets)
        upto = last_batch(spark, log)
        merged = _merge_cases(state, new, batch_id, path, log, upto, spare).withColumn("bucket", bucket(target, buckets))
        merged = _kept(merged, spare)
        state.write("changes", merged, batch_id)
        newest = merged.groupBy("bucket").agg(F.max("last.place.event_seq").alias("newest")).collect()
        state.facts["newest"] = state.facts.get("newest", {}) | {str(row.bucket): row.newest for row in newest}
        state.facts["fields"] = upto
    elif "changes" in tables:
        merged = _merge_documents(state, new).withColumn("bucket", bucket(target, buckets))
        state.write("changes", merged, batch_id)
    if "decisions" in tables:
        held = state.read("decisions", f"{target} string, {_DECISION}", bucket_numbers(new))
        last = held.unionByName(last_reviews(new, target)).groupBy(target)
        last = last.agg(F.max("place").alias("place"), F.max_by("review", "place").alias("review"))
        state.write("decisions", last.withColumn("bucket", bucket(target, buckets)), batch_id)
    if "audit" in tables:
        audit = audit_rows(new.drop("bucket"), target, SUBJECTS[target])
        audit.write.mode("overwrite").parquet(f"{path}/audit/batch={batch_id}")
    state.commit(batch_id)
    for table in spare:
        discard(table)


def stream_reviews(
    reviews: DataFrame,
    fields: DataFrame | str,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    target: str = "case_id",
    buckets: int = BUCKETS,
    tables: tuple[str, ...] = TABLES,
) -> StreamingQuery:
    """Apply arriving reviews of cases, or of template documents, to ``fields``.

    ``fields`` may be the folder in which an upload stream logs its fields (it holds
    each document once, laid out by the same number of buckets).
    """
    return (
        reviews.writeStream.foreachBatch(
            lambda batch, batch_id: apply_review_batch(batch, batch_id, fields, path, target, buckets, tables)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def reviewed_fields(
    spark: SparkSession, fields: DataFrame, path: str, target: str = "case_id"
) -> DataFrame:
    """Fields after the reviews so far; before the first batch, as they are."""
    state = State(spark, path)
    if not state.folders("changes"):
        return fields
    changes = state.read("changes", CHANGES[target])
    return apply_targets(fields, changes) if target == "case_id" else apply_document_changes(fields, changes)


def upsert_fields(
    spark: SparkSession, log: str, path: str, into: str, columns: StructType, buckets: int = BUCKETS
) -> list[int]:
    """Bring the table ``into`` (current fields, in buckets of cases) up to date.

    ``log``: the fields as an upload stream logs them. Rewritten are the buckets with
    fields or changes that the table does not have yet, each as a whole, by dynamic
    partition overwrite; the others are not read. Returns their numbers. Called again, or
    after half of a call, it gives the same table.
    """
    state, done = State(spark, path), State(spark, into)
    upto, seen = last_batch(spark, log), done.facts.get("fields", -1)
    versions = state.versions.get("changes", {})
    stale = {b for b, version in versions.items() if done.versions.get("changes", {}).get(b) != version}
    fields = read_log(spark, log, columns).filter(F.col("batch") <= upto)
    stale.update(bucket_numbers(fields.filter(F.col("batch") > seen)))
    numbers = sorted(stale)
    if numbers:
        held = fields.filter(F.col("bucket").isin(numbers)).drop("batch", "bucket")
        current = apply_targets(held, state.read("changes", CHANGES["case_id"], numbers))
        (
            current.withColumn("bucket", bucket("case_id", buckets))
            .hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(f"{into}/fields")
        )
        done.versions["changes"] = dict(versions)
        done.facts["fields"] = upto
        done.commit((done.batch if done.batch is not None else -1) + 1)
    return numbers


def last_decisions(spark: SparkSession, path: str, target: str = "case_id") -> DataFrame | None:
    """Reviewer, note, time and status after the last review per target; None so far."""
    state = State(spark, path)
    if not state.folders("decisions"):
        return None
    return state.read("decisions", f"{target} string, {_DECISION}").select(target, "review.*")


def review_audit(spark: SparkSession, path: str) -> DataFrame | None:
    """Audit rows of the reviews so far; None before the first batch."""
    if not exists(spark, f"{path}/audit"):
        return None
    return spark.read.parquet(f"{path}/audit").drop("batch")


def compact(spark: SparkSession, path: str) -> None:
    """Delete superseded state, between batches; late reviews and a replay stay possible.

    Changes and decisions are then one version per bucket, however many batches there
    were. The log of reviews and the audit rows are records and stay.
    """
    State(spark, path).vacuum()
