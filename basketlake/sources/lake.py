"""Batch readers. Every reader states its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlake import schemas
from basketlake.sinks import versions


def read_bronze_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of the nine event columns, all as text; typing belongs to Silver."""
    return spark.read.schema(schemas.EVENTS_RAW).option("header", True).csv(path)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet layer, read where it lies; ``year``/``month`` folders prune as columns.

    Of a layer whose partitions are published by a manifest the live parts are read.
    """
    if versions.is_versioned(spark, path):
        return versions.read_live(spark, path)
    return spark.read.parquet(path)


DAY_FOLDERS = ("year", "month", "day")


def read_raw_json(
    spark: SparkSession, path: str, schema: T.StructType, day_columns: bool = False, recursive: bool = False
) -> DataFrame:
    """JSON records under year/month/day folders.

    ``day_columns`` keeps the folders as text columns, so that a filter on them prunes
    the scan. ``recursive`` reads any other depth of folders, without pruning.
    """
    if recursive:
        return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    folders = [T.StructField(name, T.StringType()) for name in DAY_FOLDERS]
    rows = spark.read.schema(T.StructType([*schema.fields, *folders])).json(path)
    return rows.select(*schema.names, *(DAY_FOLDERS if day_columns else ()))


def read_positional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header-less training file: columns by position, all double."""
    fields = [T.StructField(name, T.DoubleType()) for name in columns]
    return spark.read.schema(T.StructType(fields)).option("header", False).csv(path)


def read_labelled_sessions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The ten-column table of labelled cart sessions."""
    reader = spark.read.schema(schemas.LABELLED_SESSIONS)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    table = spark.read.format(fmt).load(path)
    return table.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LABELLED_SESSIONS]
    )
