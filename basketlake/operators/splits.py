"""Repeatable splits and samples that depend on row content, not on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.columns import hash_bucket
from basketlake.operators.skew import smallest
from basketlake.schemas import GOLD_KEYS

SEED = 42


def split_3way(df: DataFrame, keys: list[str] = GOLD_KEYS, seed: int = SEED) -> DataFrame:
    """Add ``split``: train (70 %), validation (15 %) or test (15 %)."""
    bucket = hash_bucket(keys, seed)
    return df.withColumn(
        "split",
        F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test"),
    )


def split_2way(df: DataFrame, keys: list[str] = GOLD_KEYS, seed: int = SEED) -> DataFrame:
    """Add ``split``: train (80 %) or test (20 %)."""
    return df.withColumn(
        "split", F.when(hash_bucket(keys, seed) < 80, "train").otherwise("test")
    )


def part(df: DataFrame, name: str) -> DataFrame:
    """One side of a split."""
    return df.filter(F.col("split") == name).drop("split")


def _digest(keys: list[str], seed: int):
    parts = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def split_stratified(
    df: DataFrame, label: str, keys: list[str] = GOLD_KEYS, test_share: float = 0.2,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` with exactly ``round(test_share * n)`` test rows in each class.

    The test rows of a class are its first ones by digest.  Counts per leading
    digest bucket tell in which bucket the last test row lies; only that bucket
    (about 1/65536 of the class) is ranked, so no class is sorted in one task.
    """
    digested = df.withColumn("_digest", _digest(keys, seed)).withColumn(
        "_lead", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    )
    counts = digested.groupBy(F.col(label).alias("_class"), "_lead").agg(
        F.count(F.lit(1)).alias("rows")
    )
    by_class = Window.partitionBy("_class")
    running = by_class.orderBy("_lead").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        counts.withColumns({
            "wanted": F.round(F.sum("rows").over(by_class) * test_share).cast("long"),
            "upto": F.sum("rows").over(running),
        })
        .withColumn("before", F.col("upto") - F.col("rows"))
        .filter((F.col("before") < F.col("wanted")) & (F.col("upto") >= F.col("wanted")))
        .select("_class", F.col("_lead").alias("_edge"),
                (F.col("wanted") - F.col("before")).alias("_take"))
    )
    # One row per class, so always small.
    marked = digested.join(F.broadcast(edges), F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")
    rank = F.row_number().over(Window.partitionBy(label, "_lead").orderBy("_digest", *keys))
    on_edge = F.col("_lead") == F.col("_edge")
    clear = marked.filter(F.col("_edge").isNull() | ~on_edge).withColumn(
        "split", F.when(F.col("_lead") < F.col("_edge"), "test").otherwise("train")
    )
    ranked = marked.filter(on_edge).withColumn(
        "split", F.when(rank <= F.col("_take"), "test").otherwise("train")
    )
    return clear.unionByName(ranked).drop("_digest", "_lead", "_edge", "_take")


def ml_sample(df: DataFrame, n: int = 100_000) -> DataFrame:
    """The first ``n`` sessions by (session_id, user_id)."""
    return smallest(df, n, GOLD_KEYS, F.substring("session_id", 1, 3))


def bounded_sample(
    df: DataFrame, n: int = 50_000, keys: list[str] = GOLD_KEYS, seed: int = SEED
) -> DataFrame:
    """``n`` repeatable rows in digest order (a preview; training uses all rows)."""
    digested = df.withColumn("_digest", _digest(keys, seed))
    return smallest(
        digested, n, ["_digest", *keys], F.substring("_digest", 1, 4)
    ).drop("_digest")


def preview(df: DataFrame, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    """Print the schema and give ``n`` rows."""
    df.printSchema()
    return (df.select(*columns) if columns else df).limit(n)
