"""What each user did in strictly earlier cart sessions.

The natural form is one window per user.  A user with a large part of all
sessions would put that part into one task, so the time line of such a user is
cut into slices: each slice is a window of its own, and the totals of the slices
before it are added from a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.columns import ratio, whole_seconds
from basketlake.operators.skew import heavy_keys, key_hash

SLICES = 1024  # most slices per heavy user
STRIDE = 32    # a slice is looked up among every 32nd bound first


def _slice_bounds(sessions: DataFrame, heavy: DataFrame) -> DataFrame:
    """One row per heavy user: time quantiles that cut the user's sessions evenly.

    A user gets about as many slices as the heavy-key table asks splits for, so
    all users together have only some thousand slices.
    """
    shares = F.expr("array(" + ", ".join(f"{i / SLICES}D" for i in range(1, SLICES)) + ")")
    step = F.greatest(F.lit(1), (F.lit(SLICES) / F.col("splits")).cast("int"))

    def every(column: str, distance: Column) -> Column:
        return F.filter(column, lambda _, i: (i + 1) % distance == 0)

    return (
        sessions.select("user_id", F.unix_micros("first_cart_time").alias("at"))
        .withColumn("h", key_hash(["user_id"]))
        .join(F.broadcast(heavy), F.col("h") == F.col("heavy_hash"), "inner")
        .groupBy("user_id")
        .agg(
            F.percentile_approx("at", shares, 10000).alias("quantiles"),
            F.max("splits").alias("splits"),
        )
        .withColumn("step", step)
        .withColumn("bounds", every("quantiles", F.col("step")))
        .select("user_id", "bounds", every("bounds", F.lit(STRIDE)).alias("edges"))
    )


def _sliced(sessions: DataFrame, heavy: DataFrame) -> DataFrame:
    """Add ``_slice``: 0 for ordinary users, the time slice for heavy ones."""
    bounds = F.broadcast(_slice_bounds(sessions, heavy))

    def passed(column) -> Column:
        return F.size(F.filter(column, lambda b: b < F.unix_micros("first_cart_time")))

    skipped = F.col("_skipped")
    near = passed(F.slice("bounds", skipped + 1, F.lit(STRIDE)))
    return (
        sessions.join(bounds, "user_id", "left")
        .withColumn("_skipped", F.when(F.col("bounds").isNotNull(), passed("edges") * STRIDE))
        .withColumn("_slice", F.coalesce(skipped + near + 1, F.lit(0)))
        .drop("bounds", "edges", "_skipped")
    )


def _carried(sliced: DataFrame) -> DataFrame:
    """Totals of all earlier slices, for heavy users only (slice numbers start at 1)."""
    totals = (
        sliced.filter(F.col("_slice") > 0)
        .groupBy("user_id", "_slice")
        .agg(
            F.count("session_id").alias("n"),
            F.sum("converted").alias("c"),
            F.sum("is_abandoned").alias("a"),
            F.min("first_cart_time").alias("t"),
        )
    )
    earlier = (
        Window.partitionBy("user_id").orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        "user_id", "_slice",
        F.sum("n").over(earlier).alias("_n"), F.sum("c").over(earlier).alias("_c"),
        F.sum("a").over(earlier).alias("_a"), F.min("t").over(earlier).alias("_t"),
    )


def with_history(sessions: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Add the six history features and ``user_first_prior_cart_time``.

    Only sessions strictly earlier in (first_cart_time, session_id) count.
    ``sessions`` is read several times, so hand in a stored table.
    """
    if heavy is None:
        heavy = heavy_keys(sessions, ["user_id"])
    sliced = _sliced(sessions, heavy)
    earlier = (
        Window.partitionBy("user_id", "_slice")
        .orderBy("first_cart_time", "session_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = sliced.withColumns({
        "_ln": F.count("session_id").over(earlier),
        "_lc": F.sum("converted").over(earlier),
        "_la": F.sum("is_abandoned").over(earlier),
        "_lt": F.min("first_cart_time").over(earlier),
    }).join(F.broadcast(_carried(sliced)), ["user_id", "_slice"], "left")

    def total(part: str) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.col(f"_l{part}"), zero) + F.coalesce(F.col(f"_{part}"), zero)

    prior = F.col("user_prior_sessions")
    first = F.col("user_first_prior_cart_time")
    return (
        counted.withColumns({
            "user_prior_sessions": total("n"),
            "user_prior_conversions": total("c"),
            "user_prior_abandonments": total("a"),
            "user_first_prior_cart_time": F.least("_lt", "_t"),
        })
        .withColumns({
            "user_prior_conversion_rate": ratio(F.col("user_prior_conversions"), prior),
            "user_prior_abandon_rate": ratio(F.col("user_prior_abandonments"), prior),
            "user_lifetime_hours": F.when(
                first.isNotNull(),
                whole_seconds(F.col("first_cart_time"), first) / F.lit(3600.0),
            ).otherwise(F.lit(0.0)),
        })
        .drop("_slice", *[f"_{p}" for p in "ncat"], *[f"_l{p}" for p in "ncat"])
    )
