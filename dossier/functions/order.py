"""Places in a total order of a table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.session import materialise


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their ``place`` (from 1) in a total order of the whole table.

    Rows are sorted in ranges, none of which needs to fit anywhere else, and written
    with their number within their range; the ranges' sizes, one figure each, then give
    the place at which each starts. No task sees more than its own range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # Such an id is the number of the partition, and in its lower 33 bits that in it.
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(numbered.groupBy(part.alias("part")).count().collect())
    parts = sorted(sizes)
    starts = dict(zip(parts, accumulate([0, *(sizes[n] for n in parts)])))
    if not parts:
        return numbered.withColumn("place", within + 1).drop("_at")
    listed = ",".join(str(starts.get(n, 0)) for n in range(parts[-1] + 1))
    start = F.get(F.split(F.lit(listed), ",").cast("array<bigint>"), part.cast("int"))
    return numbered.withColumn("place", start + within + 1).drop("_at")
