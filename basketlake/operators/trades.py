"""Price and order messages: acceptance rules, typing, ticker summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW_PRICE_LIMIT = 30  # fixed value


def clean_prices(prices: DataFrame) -> DataFrame:
    """Prices above 0 with their band."""
    price = F.col("price")
    return prices.filter(price > 0).select(
        "ticker", "price", "volume", "event_time",
        F.when(price < LOW_PRICE_LIMIT, "LOW").otherwise("HIGH").alias("price_band"),
    )


def clean_orders(orders: DataFrame) -> DataFrame:
    """Orders with a quantity above 0, client id masked, total recomputed."""
    return orders.filter(F.col("quantity") > 0).select(
        "order_id",
        F.sha2(F.col("client_id").cast("string"), 256).alias("client_id_masked"),
        "ticker", "order_type", "quantity", "price",
        (F.col("quantity") * F.col("price")).alias("total_value"),
        "event_time",
    )


def type_raw_prices(prices: DataFrame) -> DataFrame:
    return prices.select(
        "ticker", F.col("price").try_cast("double").alias("price"),
        F.col("volume").try_cast("int").alias("volume"), "event_time",
        F.current_timestamp().alias("processed_at"),
    )


def type_raw_orders(orders: DataFrame) -> DataFrame:
    """Typed orders; the supplied total is kept."""
    return orders.select(
        "order_id", "ticker", F.col("quantity").try_cast("int").alias("quantity"),
        F.col("price").try_cast("double").alias("price"),
        F.col("total_value").try_cast("double").alias("total_value"), "event_time",
        F.current_timestamp().alias("processed_at"),
    )


def type_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({
        "price": F.col("price").try_cast("double"),
        "volume": F.col("volume").try_cast("int"),
        "event_time": F.try_to_timestamp(F.col("event_time").cast("string")),
    })


def ticker_summary(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("ticker").agg(
        F.avg("price").alias("avg_price"), F.sum("volume").alias("total_volume")
    )
