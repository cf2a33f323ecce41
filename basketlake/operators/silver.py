"""Bronze to Silver: typing, validity rules, exact-duplicate removal, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake import schemas


def normalise_events(df: DataFrame) -> DataFrame:
    """Type the nine columns; text that does not parse becomes NULL."""
    typed = {field.name: field.dataType for field in schemas.EVENTS_SILVER}
    columns = []
    for name in schemas.EVENT_COLUMNS:
        column = F.col(name).try_cast(typed[name])
        if name == "event_type":
            column = F.lower(F.trim(F.col(name)))
        columns.append(column.alias(name))
    return df.select(*columns)


def valid_events(df: DataFrame) -> DataFrame:
    """Rows with time, product and user, a known type and a price of at least 0."""
    return df.filter(
        F.col("event_time").isNotNull()
        & F.col("event_type").isin(*schemas.EVENT_TYPES)
        & F.col("product_id").isNotNull()
        & F.col("user_id").isNotNull()
        & (F.col("price") >= 0)
    )


def dedup_events(df: DataFrame) -> DataFrame:
    """One row per group of identical rows.

    Copies collapse inside each task before the exchange, so a group of very
    many copies sends one row per task.
    """
    return df.dropDuplicates()


def to_silver(bronze: DataFrame) -> DataFrame:
    return dedup_events(valid_events(normalise_events(bronze)))


def silver_audit(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """One row: bronze, silver and removed row counts.

    Counted on what is stored: figures observed during the write would count a
    task twice that a lost executor makes run again.
    """
    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")

    both = counted(bronze, "bronze").unionByName(counted(silver, "silver"))
    totals = both.agg(
        F.sum(F.when(F.col("side") == "bronze", F.col("n"))).alias("bronze_count"),
        F.sum(F.when(F.col("side") == "silver", F.col("n"))).alias("silver_count"),
    )
    return totals.withColumn("removed_count", F.col("bronze_count") - F.col("silver_count"))


def conform_event_table(silver: DataFrame) -> DataFrame:
    """The curated event table: required columns present, fixed-point price, load columns."""
    required = ["event_time", "event_type", "product_id", "price", "user_id"]
    return silver.dropna(subset=required).select(
        *[
            F.col(name).cast("decimal(12,2)").alias(name) if name == "price" else F.col(name)
            for name in schemas.EVENT_COLUMNS
        ],
        F.current_timestamp().alias("ingestion_time"),
        F.lit("ecommerce").alias("source"),
    )
