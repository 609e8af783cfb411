"""Row-wise helpers that keep costly expressions from being copied around a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but the new columns are computed exactly once per row.

    A filter on a plain computed column is pushed below it by writing the whole
    expression out again, once per mention; nested ones multiply. The output of
    a generator cannot be taken apart that way, and a generator over a
    one-element array neither adds rows nor shuffles.
    """
    kept = [name for name in rows.columns if name not in columns]
    # The projection evaluates (with shared subexpressions), the generator only fences.
    fenced = F.inline_outer(F.array(F.struct(*columns)))
    return rows.withColumns(columns).select(*kept, fenced)


def exploded(rows: DataFrame, kept: list[str], items: str, position: str, item: str) -> DataFrame:
    """One row per array item with its position; rows without items disappear.

    The outer form is used because the inner one first filters on the array's
    size, which evaluates the array twice.
    """
    every = rows.select(*kept, F.posexplode_outer(items).alias(position, item))
    return every.filter(F.col(position).isNotNull())
