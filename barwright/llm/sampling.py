"""Bounded samples of large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARE = 1.3  # rows let through for each one wanted: more than the error of the estimated count


def smallest(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows with small values of key, a hash of 64 bits (all rows, if fewer; the n smallest, unless the count of distinct
    values is estimated far too large). A bound from that count leaves about n rows to be sorted, whatever the table's size."""
    known = rows.select(F.approx_count_distinct(key)).first()[0]
    if known > SPARE * n:
        rows = rows.where(key <= F.lit(int(-(2**63) + 2**64 * (SPARE * n / known))))
    return rows.orderBy(key).limit(n)
