"""Pieces that several operators of this package share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as none of the rows' columns has."""
    taken = {name.lower() for name in rows.columns}
    depth = 1
    while any("_" * depth + name in taken for name in names):
        depth += 1
    return ["_" * depth + name for name in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is named."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; none for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Arrow batches gathered until the text in ``column`` reaches ``limit`` bytes.

    A chunk holds less than ``limit`` bytes more than its last batch, so a task's
    memory does not depend on the size of its partition.
    """
    held, size = [], 0
    for batch in batches:
        for start, stop in _cuts(batch, column, limit):
            part = batch.slice(start, stop - start)
            held.append(part)
            size += _bytes(part, column)
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lengths(batch: pa.RecordBatch, column: str):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(batch.column(column)), 0)


def _bytes(batch: pa.RecordBatch, column: str) -> int:
    import pyarrow.compute as pc

    return pc.sum(_lengths(batch, column)).as_py() or 0


def _cuts(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about ``limit`` bytes each."""
    import numpy as np

    if not batch.num_rows:
        return
    ends = np.cumsum(_lengths(batch, column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + limit, side="left")) + 1
        stop = min(max(stop, start + 1), len(ends))
        yield start, stop
        start = stop


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package's code to the executors, once per application.

    Needed where they do not have it installed; a few kilobytes.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as files:
        for source in sorted(package.rglob("*.py")):
            files.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
