"""Overview figures over the Gold tables, as SQL on registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.functions.columns import percent

OVERVIEW_SQL = """
SELECT cart_sessions, abandoned_sessions, converted_sessions,
       coalesce(try_divide(abandoned_sessions * 100.0D, cart_sessions), 0.0D) AS abandonment_rate,
       coalesce(try_divide(converted_sessions * 100.0D, cart_sessions), 0.0D) AS conversion_rate
FROM (SELECT count(*) AS cart_sessions,
             count_if(is_abandoned = 1) AS abandoned_sessions,
             count_if(converted = 1) AS converted_sessions
      FROM {sessions})
"""


def overview_kpis(sessions: DataFrame) -> DataFrame:
    """Cart sessions, abandoned and converted ones, and both rates in percent."""
    return sessions.sparkSession.sql(OVERVIEW_SQL, sessions=sessions)


def funnel_rates(funnel: DataFrame) -> DataFrame:
    """Totals per step, step-to-step rates in percent, and all events."""
    def step(name: str):
        return F.coalesce(F.sum(F.when(F.col("event_type") == name, F.col("count"))), F.lit(0))

    totals = funnel.agg(
        step("view").alias("views"), step("cart").alias("carts"),
        step("purchase").alias("purchases"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_events"),
    )
    views, carts, purchases = F.col("views"), F.col("carts"), F.col("purchases")
    return totals.withColumns({
        "view_to_cart": percent(carts, views),
        "cart_to_purchase": percent(purchases, carts),
        "view_to_purchase": percent(purchases, views),
    })


def register_gold(spark: SparkSession, paths: dict[str, str], tables: bool = False) -> None:
    """Make stored layers queryable by name: views, or tables of the catalog."""
    for name, path in paths.items():
        if tables:
            spark.catalog.createTable(name, path=path, source="parquet")
        else:
            spark.read.parquet(path).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
