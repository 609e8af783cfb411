"""Tables of a stream: logs by batch, state by version, both in buckets of ids.

A log gets a folder per micro-batch, ``batch=<n>/bucket=<b>``; a batch that runs again
overwrites its own. State is kept as versions of buckets: a batch writes the buckets it
touches as ``version=<n>/bucket=<b>``, made of the versions that the batches before it
left, and then a manifest, which names the version of every bucket. So a batch reads and
writes the buckets of its own ids only, and running it again, also after half of it,
starts from the same versions. Versions that no manifest in use names may be deleted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

# Buckets of ids. To be raised with the number of ids, before the first batch.
BUCKETS = 32


def bucket(target: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(target), F.lit(buckets))


def bucket_numbers(rows: DataFrame) -> list[int]:
    """The buckets that the rows' column ``bucket`` names; at most as many as there are."""
    return sorted(row[0] for row in rows.select("bucket").distinct().collect())


def write_bucketed(rows: DataFrame, folder: str, *by: str) -> None:
    """Replace a folder by the rows in folders of their bucket; large buckets are split."""
    by = by or ("bucket",)
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(folder)


def read_log(spark: SparkSession, log: str, schema: StructType, *by: str) -> DataFrame:
    """A whole log with its columns ``batch`` and ``bucket``; filters on them prune folders."""
    folders = ["batch", *(by or ("bucket",))]
    kinds = {"kind": "string"}
    stored = StructType(list(schema.fields))
    for name in folders:
        stored = stored.add(name, kinds.get(name, LongType()))
    return spark.read.schema(stored).parquet(log)


def _system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def numbered_folders(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers n of the folders ``<name>=<n>`` in a folder; none if it does not exist."""
    system, path = _system(spark, folder)
    if not system.exists(path):
        return []
    children = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(int(child.split("=")[1]) for child in children if child.startswith(f"{name}="))


def last_batch(spark: SparkSession, log: str) -> int:
    """The last batch of a log that is complete, -1 if there is none."""
    for number in reversed(numbered_folders(spark, log, "batch")):
        system, path = _system(spark, f"{log}/batch={number}/_SUCCESS")
        if system.exists(path):
            return number
    return -1


class State:
    """Versions of buckets under a path, as the manifest of one batch has them."""

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        self.spark, self.path = spark, path
        found = numbered_folders(spark, f"{path}/manifest", "batch")
        found = [n for n in found if before is None or n < before]
        #: Of each table the version of each bucket; facts that batches hand on.
        self.versions: dict[str, dict[int, int]] = {}
        self.facts: dict[str, object] = {}
        self.batch = found[-1] if found else None
        if found:
            text = spark.read.text(f"{path}/manifest/batch={found[-1]}").first()[0]
            held = json.loads(text)
            self.facts = held["facts"]
            self.versions = {t: {int(b): v for b, v in of.items()} for t, of in held["versions"].items()}

    def folders(self, table: str, numbers: Iterable[int] | None = None) -> list[str]:
        versions = self.versions.get(table, {})
        wanted = versions if numbers is None else [b for b in numbers if b in versions]
        return [f"{self.path}/{table}/version={versions[b]}/bucket={b}" for b in wanted]

    def read(self, table: str, schema: str | StructType, numbers: Iterable[int] | None = None) -> DataFrame:
        """The given buckets of a table, or all; other folders are not even listed."""
        folders = self.folders(table, numbers)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def write(self, table: str, rows: DataFrame, version: int) -> None:
        """Rows with a column ``bucket`` as the new version of their buckets."""
        folder = f"{self.path}/{table}/version={version}"
        write_bucketed(rows, folder)
        of = self.versions.setdefault(table, {})
        of.update(dict.fromkeys(numbered_folders(self.spark, folder, "bucket"), version))

    def commit(self, batch: int) -> None:
        """The manifest comes last: without it the batch has not happened."""
        text = json.dumps({"versions": self.versions, "facts": self.facts})
        row = self.spark.createDataFrame([(text,)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.path}/manifest/batch={batch}")

    def vacuum(self) -> None:
        """Delete what neither the last batch nor the one before it, should it run again, needs."""
        batches = numbered_folders(self.spark, f"{self.path}/manifest", "batch")
        kept = [State(self.spark, self.path, n + 1) for n in batches[-2:]]
        for number in batches[:-2]:
            self._delete(f"{self.path}/manifest/batch={number}")
        for table in self.versions:
            used = {pair for state in kept for pair in state.versions.get(table, {}).items()}
            for version in numbered_folders(self.spark, f"{self.path}/{table}", "version"):
                folder = f"{self.path}/{table}/version={version}"
                stored = numbered_folders(self.spark, folder, "bucket")
                superseded = [number for number in stored if (number, version) not in used]
                for name in [f"{folder}/bucket={n}" for n in superseded] if len(superseded) < len(stored) else [folder]:
                    self._delete(name)

    def _delete(self, folder: str) -> None:
        system, path = _system(self.spark, folder)
        system.delete(path, True)
