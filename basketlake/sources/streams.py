"""Streaming readers: message topics or files, decoded to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlake import schemas

CORRUPT = "_corrupt_record"


def read_message_stream(
    spark: SparkSession, source: str = "kafka", path: str | None = None, **options: str
) -> DataFrame:
    """Messages as text in ``value``, from the earliest one on.

    ``source`` is "kafka" (needs the connector on the class path; pass
    ``subscribe`` and bootstrap servers as options) or "text" for files of one
    message per line.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("startingOffsets", "earliest")
    stream = reader.options(**options).load(path) if path else reader.options(**options).load()
    keep = [c for c in ("topic",) if c in stream.columns]
    return stream.select(F.col("value").cast("string").alias("value"), *keep)


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON fields as columns; text that does not fit stays in ``_corrupt_record``."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        "value", with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return messages.withColumn("message", parsed)


def decode_once(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """:func:`decode` of which each pass parses a message once.

    A filter on a decoded field would otherwise be pushed below the parsing and parse on its own.
    """
    decoded = decode(messages, schema)
    others = [c for c in decoded.columns if c != "message"]
    return decoded.select(*others, F.explode(F.array("message")).alias("message"))


def accepted(decoded: DataFrame) -> DataFrame:
    """Columns of the messages that were read without error."""
    good = F.col("message").isNotNull() & F.col(f"message.{CORRUPT}").isNull()
    return decoded.filter(good).select("message.*").drop(CORRUPT)


def quarantined(decoded: DataFrame) -> DataFrame:
    """Text of the messages that were not, for an error sink."""
    bad = F.col("message").isNull() | F.col(f"message.{CORRUPT}").isNotNull()
    return decoded.filter(bad).select("value", F.lit("not a valid message").alias("reason"))


def read_event_stream(
    spark: SparkSession, source: str = "kafka", path: str | None = None, **options: str
) -> DataFrame:
    """Click events as text columns, from messages or (``csv``/``parquet``) landed files."""
    if source in ("csv", "parquet", "json"):
        reader = spark.readStream.format(source).schema(schemas.EVENTS_RAW)
        return reader.options(**options).load(path)
    return accepted(decode(
        read_message_stream(spark, source, path, **options), schemas.EVENTS_RAW
    ))
