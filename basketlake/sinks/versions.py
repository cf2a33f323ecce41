"""Partitions that change at once: data is staged, then a small manifest names what is live.

A layer written here has the folders ``version=<id>/<partition>`` with data and
``_manifest/<number>`` with (part, folder) rows, one per partition. A manifest counts once
its ``_SUCCESS`` marker is there, which Spark writes last, so a load that dies at any
point leaves the last whole state. Readers take the newest one that counts. One writer at
a time; readers may run meanwhile, as old versions stay until :func:`vacuum`. A manifest
has one row per partition (months), so it passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = T.StructType([T.StructField("part", T.StringType()), T.StructField("folder", T.StringType())])
_OWN = ("version", "stray")


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, without the scheme's host part if the pattern has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def _numbers(spark: SparkSession, path: str, marker: str = "/_SUCCESS") -> list[int]:
    found = _glob(spark, f"{path}/_manifest/*{marker}")
    return sorted(int(f.removesuffix(marker).rsplit("/", 1)[-1]) for f in found)


def is_versioned(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def live_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder, relative to the layer, of each live part."""
    numbers = _numbers(spark, path)
    if not numbers:
        return {}
    rows = spark.read.schema(_MANIFEST).json(f"{path}/_manifest/{numbers[-1]:012d}").collect()
    return {r["part"]: r["folder"] for r in rows}


def stage(df: DataFrame, path: str, under: str = "", keys: tuple[str, ...] = ()) -> dict[str, str]:
    """Write the rows where no reader looks; gives (partition, folder) of what was written."""
    spark = df.sparkSession
    version = f"version={uuid.uuid4().hex}"
    root = "/".join(x for x in (version, under) if x)
    df.write.partitionBy(*keys).option("compression", "zstd").parquet(f"{path}/{root}")
    found = _glob(spark, f"{path}/{root}" + "".join(f"/{key}=*" for key in keys))
    parts = ["/".join(f.rsplit("/", len(keys))[1:]) if keys else "" for f in found]
    return {part: f"{root}/{part}".rstrip("/") for part in parts}


def publish(spark: SparkSession, path: str, changes: dict[str, str | None]) -> None:
    """Make the changed parts live, all at once; a part with None is live no more."""
    parts = {**live_parts(spark, path), **changes}
    rows = [(part, folder) for part, folder in sorted(parts.items()) if folder is not None]
    started = _numbers(spark, path, "") or [0]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{path}/_manifest/{started[-1] + 1:012d}")


def read_parts(spark: SparkSession, path: str, folders: list[str], like: T.StructType | None = None) -> DataFrame:
    """Rows of some folders with their partition columns; none needs ``like``."""
    if not folders:
        return spark.createDataFrame([], like or T.StructType([]))
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{folder}" for folder in folders])
    return rows.drop(*_OWN)


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The live parts; filters on partition columns prune folders."""
    return read_parts(spark, path, [f for part, f in live_parts(spark, path).items() if not part.startswith("aside/")])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete folders and manifests that are not live; call it when no reader holds an older state."""
    used = {folder.split("/", 1)[0] for folder in live_parts(spark, path).values()}
    gone = [f for f in _glob(spark, f"{path}/version=*") if f.rsplit("/", 1)[-1] not in used]
    newest = max(_numbers(spark, path), default=0)
    gone += [f for f in _glob(spark, f"{path}/_manifest/*") if int(f.rsplit("/", 1)[-1]) < newest]
    for folder in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return gone


def months_of(rows: DataFrame, time: str = "event_time") -> list[tuple[int, int]]:
    """The distinct months of the rows; a report of a few lines."""
    found = rows.filter(F.col(time).isNotNull()).select(F.year(time).alias("y"), F.month(time).alias("m")).distinct()
    return sorted((r["y"], r["m"]) for r in found.collect())
