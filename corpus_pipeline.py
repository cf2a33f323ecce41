"""The training-data pipeline: quality, near-duplicates, decontamination, secrets, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.llm import decontam, mixing, neardup, quality, secret_scan
from basketlake.llm.common import stored
from basketlake.llm.queries import table
from basketlake.session import ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps."""
    ship_package(spark)
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates (similarity 0.8 and more)."""
    ship_package(spark)
    return neardup.deduplicated(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars, if there, follows the text."""
    ship_package(spark)
    out = secret_scan.masked(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words taken of each (repeats counted).

    Columns that already bear the name of a figure, in any case, give way to it.
    """
    mix = mixing.mixed_rows(docs).where("taken > 0")
    carried = [n for n in docs.columns if n.lower() not in FIGURES]
    return mix.select(*[F.col("row").getField(n).alias(n) for n in carried], *FIGURES)


#: What the last stage adds.
FIGURES = ("size", "source_size", "target", "taken")

STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The learned stages have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
