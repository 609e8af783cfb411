"""A stream ends with what the batch gives, replays included."""

import re

from pyspark.sql import functions as F

from dossier.operators.reviews import apply_case_reviews
from dossier.schemas import REVIEWS
from dossier.operators.reviews import review_state
from dossier.streaming.reviews import (
    apply_review_batch,
    compact,
    known_fields,
    last_decisions,
    review_audit,
    reviewed_fields,
    stream_reviews,
    upsert_fields,
)
from dossier.streaming.layout import State, bucket, last_batch, numbered_folders
from test_reviews import field, histories, review, tables, FIELDS


def _rows(fields):
    return sorted(
        (r.case_id, r.field_id, r.key, r.value, r.source, r.validation_status) for r in fields.collect()
    )


def test_reviews_arriving_in_any_order(spark, tmp_path):
    fields, found = tables(spark, list(histories(25, 5)))
    # Late ones too: the last reviews of every case come first.
    late = found.orderBy("event_seq", ascending=False).coalesce(1)
    late.write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "arriving"))
    arriving = spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "arriving"))
    path = str(tmp_path / "out")
    # Nothing has arrived yet.
    assert _rows(reviewed_fields(spark, fields, path)) == _rows(fields)
    stream_reviews(arriving, fields, path, str(tmp_path / "state")).awaitTermination()
    expected = _rows(apply_case_reviews(fields, found))
    assert _rows(reviewed_fields(spark, fields, path)) == expected

    states = [sorted(map(str, t.select("case_id", "reviewer", "status_after").collect()))
              for t in (last_decisions(spark, path), review_state(found))]
    assert states[0] == states[1]
    assert review_audit(spark, path).count() == found.count()
    compact(spark, path)
    assert _rows(reviewed_fields(spark, fields, path)) == expected

    # A batch that runs again leaves everything as it was.
    last = max(row.batch for row in spark.read.parquet(f"{path}/reviews").select("batch").distinct().collect())
    again = spark.read.parquet(f"{path}/reviews").filter(f"batch = {last}").drop("batch", "bucket")
    rows = again.collect()
    apply_review_batch(spark.createDataFrame(rows, again.schema), last, fields, path)
    assert _rows(reviewed_fields(spark, fields, path)) == expected
    assert review_audit(spark, path).count() == found.count()
    assert last_decisions(spark, str(tmp_path / "none")) is None and review_audit(spark, str(tmp_path / "none")) is None


def _log(fields, path, batch, buckets=32):
    """Fields as an upload stream logs them."""
    rows = fields.withColumn("bucket", bucket("case_id", buckets))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def test_fields_and_reviews_by_turns(spark, tmp_path):
    """Halves of the fields and reviews by turns, in no order: late fields take mentions over."""
    fields, found = tables(spark, list(histories(40, 9)))
    log, path = str(tmp_path / "fields"), str(tmp_path / "out")
    half = {"fields": F.pmod(F.xxhash64("document_id"), F.lit(2)), "reviews": F.pmod(F.xxhash64("event_seq"), F.lit(2))}
    for batch in (0, 1):
        _log(fields.filter(half["fields"] == batch), log, batch)
        apply_review_batch(found.filter(half["reviews"] == batch), batch, log, path)
    assert _rows(reviewed_fields(spark, fields, path)) == _rows(apply_case_reviews(fields, found))
    # Fields alone that come later still are taken in by a batch without reviews.
    more = spark.createDataFrame([field("case0", -5, 0, key, "early") for key in ("a_x", "b_x", "c_x", "mobile")], FIELDS)
    _log(more, log, 2)
    apply_review_batch(found.limit(0), 2, log, path)
    every = fields.unionByName(more)
    assert _rows(reviewed_fields(spark, every, path)) == _rows(apply_case_reviews(every, found))
    # A field log without its success marker is not read yet.
    (tmp_path / "fields" / "batch=2" / "_SUCCESS").unlink()
    assert last_batch(spark, log) == 1


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    fields, found = tables(spark, list(histories(60, 4)))
    path = str(tmp_path / "out")
    apply_review_batch(found, 0, fields, path)
    one = spark.createDataFrame([review("case7", 900, {"a_x": "new"})], REVIEWS)
    number = one.select(bucket("case_id")).first()[0]
    apply_review_batch(one, 1, fields, path)
    state = State(spark, path)
    for table in ("changes", "decisions"):
        assert numbered_folders(spark, f"{path}/{table}/version=1", "bucket") == [number]
        assert {b for b, version in state.versions[table].items() if version == 1} == {number}
        assert state.folders(table, [number]) == [f"{path}/{table}/version=1/bucket={number}"]
    plan = known_fields(spark, f"{path}/arrived", 0, [number])._jdf.queryExecution().toString()
    assert re.search(rf"PartitionFilters: .*bucket#\d+L? = {number}", plan)
    # The versions replaced go, those in use stay; running the last batch again still works.
    apply_review_batch(spark.createDataFrame([review("case7", 901, {"a_x": "newer"})], REVIEWS), 2, fields, path)
    before = _rows(reviewed_fields(spark, fields, path))
    compact(spark, path)
    left = numbered_folders(spark, f"{path}/changes/version=0", "bucket")
    assert number not in left and left
    assert numbered_folders(spark, f"{path}/manifest", "batch") == [1, 2]
    apply_review_batch(spark.createDataFrame([review("case7", 901, {"a_x": "newer"})], REVIEWS), 2, fields, path)
    assert _rows(reviewed_fields(spark, fields, path)) == before
    assert ("case7", "newer") in {(r[0], r[3]) for r in before}


def test_upsert_rewrites_stale_buckets_only(spark, tmp_path):
    fields, found = tables(spark, list(histories(30, 6)))
    log, path, into = (str(tmp_path / name) for name in ("fields", "out", "current"))
    _log(fields, log, 0)

    def current():
        return _rows(spark.read.parquet(f"{into}/fields").drop("bucket"))

    def stamps():
        return {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "current" / "fields").glob("bucket=*/*.parquet")}

    everything = upsert_fields(spark, log, path, into, fields.schema)
    assert current() == _rows(fields) and len(everything) > 5
    apply_review_batch(found, 0, log, path)
    upsert_fields(spark, log, path, into, fields.schema)
    assert current() == _rows(apply_case_reviews(fields, found))
    before = stamps()
    one = spark.createDataFrame([review("case7", 900, {"a_x": "new"})], REVIEWS)
    apply_review_batch(one, 1, log, path)
    number = one.select(bucket("case_id")).first()[0]
    assert upsert_fields(spark, log, path, into, fields.schema) == [number]
    after = stamps()
    assert {name for name in after if before.get(name) != after[name]} == {f"bucket={number}"}
    assert current() == _rows(apply_case_reviews(fields, found.unionByName(one)))
    assert upsert_fields(spark, log, path, into, fields.schema) == [] and stamps() == after
