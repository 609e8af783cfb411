"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.exports import JSON_OPTIONS


def append_audit(audit: DataFrame, path: str, run_id: str) -> None:
    """Add a run's audit rows, in a folder of the run with one folder per day.

    A run that is repeated replaces its own rows and no others. Rows of a day are
    brought together before writing, so that writers do not open every day's
    folder; a day with very many rows is split over writers.
    """
    dated = audit.withColumn("day", F.to_date("created_at")).hint("rebalance", "day")
    dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/run_id={run_id}")


def write_exports(exports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per line; null members are written, not left out."""
    exports.write.mode(mode).options(**JSON_OPTIONS).json(path)


def write_clustered(rows: DataFrame, path: str, owner: str, *within: str) -> None:
    """Rows in files that each hold a range of owners, and a list of the files' ranges.

    ``within`` orders the rows of an owner; one with very many rows is spread over
    several files, in that order. The list has one row per file.
    """
    ranged = rows.repartitionByRange(owner, *within).sortWithinPartitions(owner, *within)
    ranged.write.mode("overwrite").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    files = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(owner).alias("first"), F.max(owner).alias("last"), F.count(F.lit(1)).alias("rows")
    )
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def clustered_files(spark: SparkSession, path: str, owners: Sequence[str]) -> list[str]:
    """The files of ``write_clustered`` that may hold rows of one of the owners."""
    files = spark.read.parquet(f"{path}/files")
    wanted = F.array(*[F.lit(owner) for owner in owners])
    held = files.filter(F.exists(wanted, lambda owner: owner.between(F.col("first"), F.col("last"))))
    return [f"{path}/rows/{row.file}" for row in held.select("file").orderBy("file").collect()]


def read_clustered(spark: SparkSession, path: str, owner: str, owners: Sequence[str]) -> DataFrame:
    """The rows of a few owners, from the files of their ranges only."""
    files = clustered_files(spark, path, owners)
    if not files:
        return spark.read.parquet(f"{path}/rows").limit(0)
    return spark.read.parquet(*files).filter(F.col(owner).isin(*owners))
