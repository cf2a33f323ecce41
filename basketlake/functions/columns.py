"""Small column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0.0 unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0.0 for an empty base."""
    return ratio(part * F.lit(100.0), whole)


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Difference of the two instants after each is floored to the second."""
    return later.cast("long") - earlier.cast("long")


def night_flag(hour: Column) -> Column:
    """1 from 22:00 to 05:59, else 0 (also for an unknown hour)."""
    return F.when((hour >= 22) | (hour < 6), 1).otherwise(0)


def count_if(condition: Column) -> Column:
    """Number of rows that meet the condition (0, not NULL, for none)."""
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def finite_or_zero(column: Column) -> Column:
    """Number, with NULL, NaN, infinities and unparsable text as 0.0."""
    number = column.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(number)


def number_or_zero(column: Column) -> Column:
    """Number, with NULL and NaN as 0.0."""
    return F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))


def hash_bucket(keys: list[str], seed: int = 42, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from an MD5 of the key values and the seed.

    Depends on the row alone, so a recomputed or re-partitioned input lands in
    the same bucket, and other SQL engines can reproduce it.
    """
    parts = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
