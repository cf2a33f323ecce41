"""Writers. Data goes straight to lake paths; partitions are replaced, not files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.sinks import batches, versions
from basketlake.sources.lake import read_bronze_csv

#: For text and JSON lines. A compressed file is read by one task, hence the bound on its lines.
COMPRESSED = {"compression": "gzip", "maxRecordsPerFile": 500_000}


def write_layer(df: DataFrame, path: str) -> None:
    """Replace a Parquet layer."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def with_month(df: DataFrame, time: str = "event_time") -> DataFrame:
    return df.withColumns({"year": F.year(time), "month": F.month(time)})


def replace_partition(
    df: DataFrame, path: str, time: str | None = "event_time", rebalance: bool = False
) -> None:
    """Replace exactly the ``year``/``month`` partitions that ``df`` has rows for, all at once.

    With ``time`` None the frame already carries ``year`` and ``month``.  A load
    that spans many months should ``rebalance``: rows are gathered by month and a
    large month is still cut into files of the advisory size.
    """
    dated = df if time is None else with_month(df, time)
    if rebalance:
        dated = dated.hint("rebalance", "year", "month")
    versions.publish(df.sparkSession, path, versions.stage(dated, path, keys=("year", "month")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at the path, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def month_part(year: int, month: int) -> str:
    return f"year={year}/month={month}"


def month_folder(path: str, year: int, month: int) -> str:
    return f"{path}/{month_part(year, month)}"


def load_month(df: DataFrame, path: str, year: int, month: int, time: str | None = "event_time") -> list[tuple[int, int]]:
    """Make ``df`` the whole of one month's partition, whatever else the layer holds.

    Rows of other months never touch a partition: they are set aside with this load,
    replaced when it is repeated, and join their own month when that is loaded
    (:func:`set_aside`). The months they belong to are returned: those that are live
    already have to be loaded again. With ``time`` None all rows belong to the month. A
    month without rows ends up empty. The rows are worked out and written once, and
    readers see the old month until all of the new one is there.
    """
    mine = F.lit(True) if time is None else F.coalesce((F.year(time) == year) & (F.month(time) == month), F.lit(False))
    part = month_part(year, month)
    staged = versions.stage(df.withColumn("stray", ~mine), path, part, ("stray",))
    versions.publish(df.sparkSession, path, {part: staged.get("stray=false"), f"aside/{part}": staged.get("stray=true")})
    if "stray=true" not in staged:
        return []
    return versions.months_of(versions.read_parts(df.sparkSession, path, [staged["stray=true"]]), time)


def loaded_months(spark: SparkSession, path: str) -> set[str]:
    """Parts of a versioned layer that hold a month."""
    return {part for part in versions.live_parts(spark, path) if not part.startswith("aside/")}


def aside(spark: SparkSession, path: str, like: DataFrame, but: tuple[int, int] | None = None) -> DataFrame:
    """All rows that loads have set aside, or those of all loads but one."""
    own = f"aside/{month_part(*but)}" if but else None
    folders = [f for part, f in versions.live_parts(spark, path).items() if part.startswith("aside/") and part != own]
    return versions.read_parts(spark, path, folders, like.schema).select(*like.columns)


def set_aside(spark: SparkSession, path: str, like: DataFrame, year: int, month: int, time: str = "event_time") -> DataFrame:
    """Rows of the month that loads of other months set aside; none if nothing was."""
    # the month's own load is about to be replaced and holds none of its rows
    return aside(spark, path, like, (year, month)).filter((F.year(time) == year) & (F.month(time) == month))


def land_bronze(spark: SparkSession, csv: str, path: str, year: int, month: int) -> None:
    """Land a raw file, untyped, under its month. A missing input raises."""
    landed = read_bronze_csv(spark, csv).withColumns(
        {"year": F.lit(year), "month": F.lit(month)}
    )
    (
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("header", True).partitionBy("year", "month").csv(path)
    )


def write_split_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Header-less positional CSV.

    ``files`` asks for a number of files (the training jobs of small data sets
    used 20, 5 and 5); rows are redistributed for it, so the work before the
    write keeps its own parallelism.  Without it every task writes its share.
    """
    spread = df if files is None else df.repartition(files)
    spread.write.mode("overwrite").option("header", False).csv(path)


def write_report_csv(report: DataFrame, path: str) -> None:
    """One header CSV file, for small reports."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_export_csv(df: DataFrame, path: str) -> None:
    """Header CSV of any size, one file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def with_day(df: DataFrame, time: str | None = None) -> DataFrame:
    """Add year, month and day of the write (UTC), or of ``time``, as text."""
    at = F.current_timestamp() if time is None else F.col(time)
    return df.withColumns({
        "year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"),
        "day": F.date_format(at, "dd"),
    })


def write_json_by_day(df: DataFrame, path: str, time: str | None = None) -> None:
    """Append JSON lines under year/month/day folders."""
    with_day(df, time).write.mode("append").partitionBy("year", "month", "day").json(path)


def append_curated(batch: DataFrame, batch_id: int, path: str) -> None:
    """``foreachBatch`` writer for accepted rows; read them with ``read_layer``.

    A batch that runs again after a failure leaves its rows once, and files of many
    batches are merged (:mod:`basketlake.sinks.batches`). ``batch_id`` is a column.
    """
    batches.append_batch(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id, path)


def write_json_batch(batch: DataFrame, batch_id: int, path: str, folders: list[str] | None = None) -> None:
    """JSON lines of one micro-batch, compressed, replaced when the batch runs again."""
    (
        batch.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**COMPRESSED)
        .partitionBy(*(folders or []), "batch_id").json(path)
    )


def append_jdbc(batch: DataFrame, url: str, table: str, **options: str) -> None:
    """Append accepted rows to a database table (needs its JDBC driver on the class path)."""
    batch.write.mode("append").format("jdbc").options(url=url, dbtable=table, **options).save()
