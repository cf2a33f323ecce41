"""Equi-joins and ordered prefix sums that survive very heavy keys.

A key counts as heavy when it holds a noticeable share of all rows.  Heavy keys
are found in one pass with a mergeable frequent-items sketch, so the answer has
at most ``MAX_HEAVY`` rows whatever the size of the data: it is always safe to
broadcast.  Which keys are called heavy only moves work between tasks; results
do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HEAVY = 4096         # a key below 1/4096 of the rows is never heavy
SKETCH_ITEMS = 65536     # counters kept by a sketch, error well below 1/4096
MERGE_GROUPS = 1024      # sketches of the scan tasks are merged in two rounds
PARTS = 8192             # a heavy key is cut so that no part exceeds ~1/8192 of the rows
MIN_HEAVY_ROWS = 200_000  # below this a key fits one task anyway


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(key) for key in keys])


def heavy_keys(df: DataFrame, keys: list[str], min_rows: int = MIN_HEAVY_ROWS) -> DataFrame:
    """Rows (heavy_hash, splits), at most ``MAX_HEAVY`` of them."""
    partial = (
        df.select(
            key_hash(keys).alias("h"),
            F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g"),
        )
        .groupBy("g")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"approx_top_k_accumulate(h, {SKETCH_ITEMS})").alias("sketch"),
        )
    )
    found = partial.groupBy(F.lit(0).alias("all")).agg(  # without rows there is no sketch to combine
        F.sum("n").alias("total"),
        F.expr(f"approx_top_k_combine(sketch, {SKETCH_ITEMS})").alias("sketch"),
    ).select("total", F.expr(f"approx_top_k_estimate(sketch, {MAX_HEAVY})").alias("top"))
    item = F.col("item")
    return (
        found.select("total", F.explode("top").alias("item"))
        .filter((item["count"] >= min_rows) & (item["count"] * MAX_HEAVY >= F.col("total")))
        .select(
            item["item"].alias("heavy_hash"),
            F.greatest(F.lit(2), F.ceil(item["count"] * PARTS / F.col("total")))
            .cast("int").alias("splits"),
        )
    )


def _with_splits(df: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    return (
        df.withColumn("_h", key_hash(keys))
        .join(F.broadcast(heavy), F.col("_h") == F.col("heavy_hash"), "left")
        .drop("_h", "heavy_hash")
    )


def spread_join(
    big: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    spread_by: list[str],
    heavy: DataFrame | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``big`` to ``lookup`` (one row per key), cutting heavy keys of ``big``.

    Rows of a heavy key get a part number from the hash of ``spread_by``; the
    lookup row of that key is repeated once per part.  Other keys keep part 0.
    ``heavy`` is a result of :func:`heavy_keys`, computed from ``big`` if absent.
    """
    if heavy is None:
        heavy = heavy_keys(big, keys)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.col("splits"))
    left = (
        _with_splits(big, keys, heavy)
        .withColumn("_part", F.coalesce(part, F.lit(0)).cast("int"))
        .drop("splits")
    )
    right = (
        _with_splits(lookup, keys, heavy)
        .withColumn(
            "_part",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits"), F.lit(1)) - 1)),
        )
        .drop("splits")
    )
    if not null_safe:
        return left.join(right, [*keys, "_part"], how).drop("_part")
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in [*keys, "_part"]})
    condition = F.col("_part") == F.col("_r__part")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(
        "_part", "_r__part", *[f"_r_{key}" for key in keys]
    )


def smallest(df: DataFrame, n: int, order: list[str], leading: Column) -> DataFrame:
    """The ``n`` first rows by ``order`` (NULLs first), without ``n`` rows from every task.

    ``leading`` must be non-decreasing along ``order`` and have few distinct
    values (a short prefix).  Counts per value tell at which value the n-th row
    lies; rows beyond it never reach the final ordering.
    """
    counts = df.groupBy(leading.alias("lead")).agg(F.count(F.lit(1)).alias("rows"))
    running = F.sum("rows").over(
        Window.orderBy(F.col("lead").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = (
        counts.withColumn("before", F.coalesce(running, F.lit(0)))
        .filter(F.col("before") < n)
        .agg(F.max("lead"))
        .scalar()
    )
    kept = df.filter(leading.isNull() | (leading <= cut))
    return kept.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)
