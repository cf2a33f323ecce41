"""Shared helpers: stored intermediates, running totals over chunks, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SLICE = 1 << 21  # bytes of text a Python worker handles and hands back at once


def quoted(names: list[str]) -> list[str]:
    """Column references that also hold for names with dots and backticks."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def text_slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``SLICE`` bytes of the string column ``at`` (or one longer text)."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE, side="right"))
        end = max(end, row + 1)
        yield batch.slice(row, end - row)
        row = end


def changed_rows(documents: DataFrame, change: Callable) -> DataFrame:
    """Rows of ``documents`` that ``change`` keeps, with the texts it gives, all columns.

    ``change(texts)`` takes a string array and returns (keep, texts): a boolean array or
    None for all, and a string array or None for no change. A row crosses to Python and
    back once, in slices of bounded size; rows that are not kept do not come back.
    Columns may have any names; ``text`` comes back as a string.
    """
    names = documents.columns
    at = names.index("text")
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at):
                keep, texts = change(part.column(at))
                if texts is not None:
                    part = part.set_column(at, part.schema.field(at), texts)
                yield part if keep is None else part.filter(pa.array(keep))
        pa.default_memory_pool().release_unused()
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def in_fold(doc_id: Column) -> Column:
    """True for held-out rows, false for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def running_totals(df: DataFrame, group: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """Add exclusive running totals ``{new: summed}`` of each group in ``order``.

    The rows are cut into range chunks (a hot group spans many), each chunk is a
    window of its own, and totals of earlier chunks come from a table with one row
    per group and chunk. ``order`` should decide ties by content.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(
        df.repartitionByRange(n, *group, *order).withColumn("_chunk", F.spark_partition_id()), "chunks")
    return chunk_totals(cut, group, order, totals)


def chunk_totals(cut: DataFrame, group: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """:func:`running_totals` of rows already cut into chunks: those of a lower ``_chunk`` come first."""
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*group, "_chunk").agg(*[F.sum(v).alias(f"_s_{k}") for k, v in totals.items()])
    bases = sums.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_chunk").alias("_c"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in totals])
    inner = Window.partitionBy("_chunk", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_l_{k}") for k, v in totals.items()])
    match = F.col("_chunk") == F.col("_c")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(bases, match)
    for k in totals:
        joined = joined.withColumn(k, F.col(f"_l_{k}") + F.col(f"_b_{k}"))
    return joined.select(*[c for c in cut.columns if c != "_chunk"], *totals)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges(a, b)``.

    Labels start at the node itself; each round takes the smallest label among the
    neighbours, hooks whole trees onto it and halves the paths. Nothing is gathered
    per node but a minimum.
    """
    both = stored(
        edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                    .select("node", F.least("node", "b").alias("root")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen")))
        found = stored(labels.join(near, "node").select(
            "node", "root", F.least("root", "seen").alias("seen")), "seen")
        hooks = found.groupBy("root").agg(F.min("seen").alias("hook"))
        moved = found.join(hooks, "root").select(
            "node", F.col("root").alias("old"), F.least("seen", "hook").alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = stored(moved.join(jump, "root", "left").select(
            "node", "old", F.coalesce("up", "root").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return labels
