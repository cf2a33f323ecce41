"""Shop-click view of the generic ``events`` table.

``events`` (event_id, ts, user_id, event_type, value, props) has no product or
session columns; they are derived row by row, so the view grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake import schemas


def _category_code(bucket: Column) -> Column:
    return (
        F.when(bucket <= 1, F.lit(None).cast("string"))
        .when(bucket <= 3, "electronics.smartphone")
        .when(bucket <= 5, "electronics.audio.headphone")
        .when(bucket <= 7, "computers.notebook")
        .otherwise("furniture")
    )


def as_clicks(events: DataFrame) -> DataFrame:
    """Typed click rows, with every 50th event delivered twice."""
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).try_cast("bigint")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    copies = F.when(F.col("event_id") % 50 == 0, 2).otherwise(1)
    return (
        events.withColumn("k", k)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        .select(
            F.col("ts").cast("timestamp").alias("event_time"),
            F.when(F.col("event_type") == "click", "cart")
            .otherwise(F.col("event_type")).alias("event_type"),
            F.col("k").alias("product_id"),
            (F.col("k") % 10).alias("category_id"),
            _category_code(F.col("k") % 10).alias("category_code"),
            F.when(F.col("k") % 7 != 0, F.concat(F.lit("brand_"), F.col("k") % 25)).alias("brand"),
            F.col("value").alias("price"),
            F.col("user_id"),
            F.when(
                F.col("event_id") % 97 != 0, F.concat_ws("-", F.col("user_id"), day)
            ).alias("user_session"),
        )
    )


def as_landed(clicks: DataFrame) -> DataFrame:
    """The same rows as text, the way a landed CSV carries them."""
    columns = []
    for name in schemas.EVENT_COLUMNS:
        column = F.col(name)
        if name == "event_time":
            column = F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC"))
        elif name == "event_type":
            column = F.concat(F.lit(" "), F.upper(column), F.lit(" "))
        columns.append(column.cast("string").alias(name))
    return clicks.select(*columns)
