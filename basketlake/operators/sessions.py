"""Session-grain tables: first cart, session features, pre-cart features, funnel.

All per-session figures are plain aggregates with map-side combining.  The first
cart time is joined on with :func:`spread_join`, so a session that holds a large
part of all events is worked on by many tasks.  ``heavy`` takes a stored list of
such sessions (see :func:`session_heavy_keys`); without it the list is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.functions.columns import count_if, night_flag, ratio, sum_if, whole_seconds
from basketlake.operators.skew import heavy_keys, spread_join
from basketlake.schemas import GOLD_KEYS, SESSION_KEYS

SPREAD_BY = ["event_time", "product_id", "event_type"]


def is_cart() -> Column:
    return F.col("event_type") == "cart"


def is_view() -> Column:
    return F.col("event_type") == "view"


def is_purchase() -> Column:
    return F.col("event_type") == "purchase"


def before_cart() -> Column:
    return F.col("event_time") < F.col("first_cart_time")


def _spread_columns(events: DataFrame) -> list[str]:
    return [c for c in SPREAD_BY if c in events.columns]


def first_cart(events: DataFrame) -> DataFrame:
    """Earliest cart time per (session, user)."""
    return (
        events.filter(is_cart())
        .groupBy(*SESSION_KEYS)
        .agg(F.min("event_time").alias("first_cart_time"))
    )


def with_first_cart(events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Every event with the first cart time of its session.

    NULL where the session has no cart; a missing session id matches nothing.
    """
    return spread_join(
        events, first_cart(events), SESSION_KEYS, "left", _spread_columns(events),
        heavy=heavy,
    )


def cart_timeline(events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Events of sessions with a known id and a cart, with first cart time and purchase count."""
    marks = (
        events.filter(F.col("user_session").isNotNull() & (is_cart() | is_purchase()))
        .groupBy(*SESSION_KEYS)
        .agg(
            F.min(F.when(is_cart(), F.col("event_time"))).alias("first_cart_time"),
            count_if(is_purchase()).alias("session_purchases"),
        )
        .filter(F.col("first_cart_time").isNotNull())
    )
    return spread_join(
        events, marks, SESSION_KEYS, "inner", _spread_columns(events), heavy=heavy
    )


def pre_cart_events(events_with_cart_time: DataFrame) -> DataFrame:
    """Leak guard: only events up to and including the first cart."""
    return events_with_cart_time.filter(
        F.col("first_cart_time").isNotNull()
        & (F.col("event_time") <= F.col("first_cart_time"))
    )


def _targets(carts: Column, purchases: Column) -> dict[str, Column]:
    abandoned = F.when((carts > 0) & (purchases == 0), 1).otherwise(0)
    return {"is_abandoned": abandoned, "converted": F.lit(1) - abandoned}


def session_features(events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """One row per cart session over all its events, with targets.

    Rows without a session id form one group per user; they have no first cart
    time, so nothing counts as seen before it.
    """
    joined = spread_join(
        events, first_cart(events), SESSION_KEYS, "inner", _spread_columns(events),
        null_safe=True, heavy=heavy,
    ).withColumn(
        "first_cart_time", F.when(F.col("user_session").isNotNull(), F.col("first_cart_time"))
    )
    totals = joined.groupBy(*SESSION_KEYS).agg(
        sum_if(is_cart(), F.col("price")).alias("total_cart_value"),
        count_if(is_cart()).alias("num_cart_items"),
        count_if(is_view() & before_cart()).alias("num_views_before_cart"),
        count_if(is_purchase()).alias("num_purchases"),
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.min("first_cart_time").alias("first_cart_time"),
    )
    hour = F.hour("first_cart_time")
    carts = F.col("num_cart_items")
    return (
        totals.filter(carts > 0)
        .withColumns({
            "session_duration_sec": whole_seconds(F.col("session_end"), F.col("session_start")),
            "hour_of_day": hour,
            "is_night": night_flag(hour),
            "view_to_cart_ratio": ratio(F.col("num_views_before_cart"), carts),
            **_targets(carts, F.col("num_purchases")),
        })
        .withColumnRenamed("user_session", "session_id")
    )


def pre_cart_aggregates(timeline: DataFrame) -> DataFrame:
    """The thirteen aggregates over pre-cart events, one row per (session, user)."""
    viewed = is_view() & before_cart()
    at_cart = is_cart() & (F.col("event_time") == F.col("first_cart_time"))
    price = F.col("price")
    extra = [
        F.max(name).alias(name) for name in ("session_purchases",) if name in timeline.columns
    ]
    return pre_cart_events(timeline).groupBy(*SESSION_KEYS).agg(
        F.min("event_time").alias("first_event_time"),
        F.min("first_cart_time").alias("first_cart_time"),
        count_if(viewed).alias("num_views_before_cart"),
        *[
            F.count_distinct(F.when(viewed, F.col(column))).alias(f"unique_{name}_viewed")
            for name, column in (
                ("products", "product_id"), ("categories", "category_id"), ("brands", "brand"),
            )
        ],
        *[
            function(F.when(viewed, price)).alias(f"{name}_viewed_price")
            for name, function in (("avg", F.avg), ("min", F.min), ("max", F.max))
        ],
        sum_if(at_cart, price).alias("cart_value_at_first_cart"),
        count_if(at_cart).alias("num_cart_items_at_first_cart"),
        F.avg(F.when(at_cart, price)).alias("avg_cart_item_price"),
        F.max(F.when(at_cart, price)).alias("max_cart_item_price"),
        *extra,
    )


def _derive_pre_cart(aggregates: DataFrame) -> DataFrame:
    hour = F.hour("first_cart_time")
    spread = F.col("max_viewed_price") - F.col("min_viewed_price")
    return (
        aggregates.withColumns({
            "time_to_first_cart_sec": whole_seconds(
                F.col("first_cart_time"), F.col("first_event_time")
            ),
            "hour_of_day": hour,
            "is_night": night_flag(hour),
            "view_to_cart_ratio": ratio(
                F.col("num_views_before_cart"), F.col("num_cart_items_at_first_cart")
            ),
            "viewed_price_range": F.coalesce(spread, F.lit(0.0)),
        })
        .fillna(0.0, subset=[
            "avg_viewed_price", "min_viewed_price", "max_viewed_price",
            "avg_cart_item_price", "max_cart_item_price",
        ])
        .withColumnRenamed("user_session", "session_id")
    )


def ml_features(events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Pre-cart features with both targets, one row per cart session with an id.

    The purchase count that decides the target travels with the first cart time,
    so the targets need no second join.
    """
    features = _derive_pre_cart(pre_cart_aggregates(cart_timeline(events, heavy)))
    return features.withColumns(
        _targets(F.col("num_cart_items_at_first_cart"), F.col("session_purchases"))
    ).drop("session_purchases")


def pre_cart_features(events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """The same features without targets."""
    timeline = cart_timeline(events, heavy).drop("session_purchases")
    return _derive_pre_cart(pre_cart_aggregates(timeline))


def with_targets(features: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach the whole-session targets to features of the same key."""
    targets = sessions.select(*GOLD_KEYS, "is_abandoned", "converted")
    return features.join(targets, GOLD_KEYS, "inner")


def cart_session_events(events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Events of sessions (by session id alone) that contain a cart."""
    carts = events.filter(is_cart()).select("user_session").distinct()
    return spread_join(
        events, carts, ["user_session"], "left_semi", _spread_columns(events), heavy=heavy
    )


def _cart_variety(events: DataFrame) -> DataFrame:
    """Distinct brands and categories and the most frequent category, from cart events alone.

    Of equally frequent categories the smallest counts.
    """
    return events.filter(F.col("user_session").isNotNull() & is_cart()).groupBy("user_session").agg(
        F.count_distinct("brand").alias("num_distinct_brands"),
        F.count_distinct("category_code").alias("num_distinct_categories"),
        F.mode("category_code", deterministic=True).alias("top_category"),
    )


def _cart_totals(events: DataFrame) -> DataFrame:
    """Plain sums and extremes per session id.

    Events are summed up per (session, user) first: those aggregates stay in
    generated code, and picking the user of the earliest event then only looks
    at one row per pair.
    """
    price = F.when(is_cart(), F.col("price"))
    pairs = (
        events.filter(F.col("user_session").isNotNull())
        .groupBy(*SESSION_KEYS)
        .agg(
            count_if(is_cart()).alias("num_cart_items"),
            F.sum(price).alias("total_cart_value"),
            F.max(price).alias("max_item_price"),
            F.min(price).alias("min_item_price"),
            count_if(is_view()).alias("num_views_before_cart"),
            F.min("event_time").alias("first_event_time"),
            F.max(F.when(is_cart(), F.col("event_time"))).alias("last_cart_time"),
            F.max(F.when(is_purchase(), 1).otherwise(0)).alias("has_purchase"),
        )
    )
    return pairs.groupBy("user_session").agg(
        F.min_by("user_id", F.struct("first_event_time", "user_id")).alias("user_id"),
        *[F.sum(c).alias(c) for c in
          ("num_cart_items", "total_cart_value", "num_views_before_cart")],
        *[F.max(c).alias(c) for c in ("max_item_price", "last_cart_time", "has_purchase")],
        *[F.min(c).alias(c) for c in ("min_item_price", "first_event_time")],
    ).filter(F.col("num_cart_items") > 0)


def cart_features(events: DataFrame) -> DataFrame:
    """Sixteen cart features and the target per session id, up to the last cart.

    ``num_views_before_cart`` counts every view of the session, as the coupon
    model expects it.  Both halves end up partitioned by session id, so joining
    them moves no rows.
    """
    totals = _cart_totals(events).join(_cart_variety(events), "user_session")
    at = F.col("last_cart_time")
    items = F.col("num_cart_items")
    weekday = F.weekday(at)
    elapsed = (F.unix_micros(at) - F.unix_micros("first_event_time")) / F.lit(1e6)
    return totals.select(
        "user_session", "user_id", "num_cart_items", "total_cart_value", "max_item_price",
        "min_item_price", (F.col("total_cart_value") / items).alias("avg_item_price"),
        "num_distinct_brands", "num_distinct_categories",
        F.coalesce(F.substring_index("top_category", ".", 1), F.lit("other"))
        .alias("main_category"),
        "num_views_before_cart",
        (F.col("num_views_before_cart") / F.greatest(items, F.lit(1)))
        .alias("view_to_cart_ratio"),
        F.greatest(elapsed, F.lit(0.0)).alias("session_duration_sec"),
        F.hour(at).alias("hour_of_day"),
        weekday.alias("day_of_week"),
        F.when(weekday >= 5, 1).otherwise(0).alias("is_weekend"),
        night_flag(F.hour(at)).alias("is_night"),
        (F.lit(1) - F.col("has_purchase")).alias("is_abandoned"),
    )


def funnel(events: DataFrame) -> DataFrame:
    """Events per type."""
    return events.groupBy("event_type").count().orderBy("event_type")


def session_heavy_keys(events: DataFrame) -> DataFrame:
    """Sessions to cut over several tasks; at most 4096 rows, worth storing beside Silver."""
    return heavy_keys(events, SESSION_KEYS)
