"""Explicit schemas and the feature sets of each model generation."""

from pyspark.sql import types as T


# Names and types of the published files, in their order.

EVENT_COLUMNS = [
    "event_time", "event_type", "product_id", "category_id", "category_code",
    "brand", "price", "user_id", "user_session",
]

EVENT_TYPES = ("view", "cart", "purchase")

EVENTS_RAW = T.StructType([T.StructField(name, T.StringType()) for name in EVENT_COLUMNS])

EVENTS_SILVER = T.StructType([
    T.StructField("event_time", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
])

LABELLED_SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.IntegerType()),
    T.StructField("total_cart_value", T.DoubleType()),
    T.StructField("num_cart_items", T.IntegerType()),
    T.StructField("num_views_before_cart", T.IntegerType()),
    T.StructField("session_duration_sec", T.IntegerType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("is_night", T.IntegerType()),
    T.StructField("user_profile", T.StringType()),
    T.StructField("is_abandoned", T.IntegerType()),
])

RAW_PRICES = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.IntegerType()),
    T.StructField("event_time", T.StringType()),
])

RAW_ORDERS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("order_type", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("total_value", T.DoubleType()),
    T.StructField("event_time", T.StringType()),
])

SESSION_KEYS = ["user_session", "user_id"]
GOLD_KEYS = ["session_id", "user_id"]

# The twelve base features, in the order the positional training files use.
BASE_FEATURES = [
    "num_views_before_cart", "unique_products_viewed", "unique_categories_viewed",
    "unique_brands_viewed", "avg_viewed_price", "viewed_price_range",
    "cart_value_at_first_cart", "num_cart_items_at_first_cart", "time_to_first_cart_sec",
    "view_to_cart_ratio", "hour_of_day", "is_night",
]

DERIVED_FEATURES = [
    "views_per_minute", "cart_value_per_item", "price_spread_ratio", "product_revisit_rate",
    "category_diversity_ratio", "brand_diversity_ratio", "cart_to_view_ratio",
    "cart_value_vs_avg_viewed_price", "seconds_per_view", "fast_cart_flag",
    "high_exploration_flag", "night_views_interaction", "log_time_to_first_cart",
    "log_cart_value",
]

HISTORY_FEATURES = [
    "user_prior_sessions", "user_prior_conversions", "user_prior_abandonments",
    "user_prior_conversion_rate", "user_prior_abandon_rate", "user_lifetime_hours",
]

FEATURES_V2 = BASE_FEATURES + DERIVED_FEATURES
FEATURES_V3 = FEATURES_V2 + HISTORY_FEATURES
PROFILE_FEATURES = list(BASE_FEATURES)

PROPENSITY_FEATURES = [
    "num_views_before_cart", "unique_products_viewed", "unique_categories_viewed",
    "unique_brands_viewed", "avg_viewed_price", "viewed_price_range",
    "cart_value_at_first_cart", "num_cart_items_at_first_cart", "avg_cart_item_price",
    "max_cart_item_price", "time_to_first_cart_sec", "view_to_cart_ratio", "hour_of_day", "is_night",
]

ABANDONMENT_NUMERIC = [
    "num_cart_items", "total_cart_value", "max_item_price", "min_item_price",
    "avg_item_price", "num_distinct_brands", "num_distinct_categories",
    "num_views_before_cart", "view_to_cart_ratio", "session_duration_sec", "hour_of_day",
    "day_of_week", "is_weekend", "is_night",
]
ABANDONMENT_CATEGORICAL = "main_category"

LABELLED_FEATURES = [
    "total_cart_value", "num_cart_items", "num_views_before_cart", "view_to_cart_ratio",
    "session_duration_sec", "hour_of_day", "is_night",
]

CONVERTED = "converted"
ABANDONED = "is_abandoned"


def training_columns(features: list[str], target: str = CONVERTED) -> list[str]:
    """Column order of a positional training file: target first."""
    return [target, *features]
