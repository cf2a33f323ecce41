"""Run a bounded stream to its end, into a Parquet folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketlake.session import scratch_path


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process what the source holds now and give the stored result."""
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{target}/rows").option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")
