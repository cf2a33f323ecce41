"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a word budget by weight; none gives more than ``most`` times its
size, the rest is shared again by weight until nothing is above. A source gives
whole epochs first; the remaining words come from its documents in the order of
exponential keys -ln(u) / weight, summed up to the budget; the last document is
cut there. u is a digest of the document, so reruns agree. All built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm.common import quoted, running_totals, stored

# Fixed values of the mix
BLANK_WORD = r"[^\x20\x09-\x0D]+"
SOURCE_WEIGHTS = [3, 1, 2]
SHARE = 1.5
MOST = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of usual word length (3 to 12 characters a word), else 1/4."""
    mean = F.try_divide(F.length(text), size)
    return F.when((size > 0) & mean.between(3.0, 12.0), F.lit(1.0)).otherwise(F.lit(0.25))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``, one row a source."""
    ranked = stored(running_totals(
        sizes.withColumn("one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], {"place": "one"}), "sources")
    cycle = F.array(*[F.lit(w).cast("long") for w in SOURCE_WEIGHTS])
    weighed = ranked.select(
        "source", "source_size", "place", (F.col("source_size") * MOST).alias("cap"),
        F.get(cycle, (F.col("place") % len(SOURCE_WEIGHTS)).cast("int")).alias("w"))
    total, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    filled = stored(running_totals(
        weighed.withColumn("ratio", F.col("cap") / F.col("w")), [], [F.col("ratio"), F.col("place")],
        {"caps": "cap", "passed": "w"}), "filled")
    level = (F.lit(SHARE * total) - F.col("caps")) / (F.lit(weights) - F.col("passed"))
    open_ = filled.withColumn("level", level).where(F.col("level") * F.col("w") < F.col("cap"))
    last = open_.orderBy("ratio", "place").select("level").first()
    target = F.col("cap").cast("double")
    if last is not None:
        target = F.least(target, F.lit(last[0]) * F.col("w"))
    return filled.select("source", "source_size", target.alias("target"))


ORDER = ["key", "doc_id", "size", "tie"]


def _keyed(documents: DataFrame, seed: int, *more: Column) -> DataFrame:
    """(doc_id, source, size, key, tie) per row, and ``more``."""
    text = F.col("text").cast("string")
    spread = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    sized = documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), text.alias("text"),
        ((spread.cast("double") + 0.5) / float(1 << 52)).alias("u"), *more)
    names = [c for c in sized.columns if c not in ("doc_id", "source", "size", "text", "u")]
    return sized.select(
        "doc_id", "source", "size", (-F.log("u") / quality_weight(F.col("text"), F.col("size"))).alias("key"),
        F.xxhash64("text").alias("tie"), *names)


def _placed(documents: DataFrame, seed: int) -> DataFrame:
    """Keyed rows with their source's figures, the words ``before`` them and those ``left`` for its last epoch."""
    keyed = stored(_keyed(documents, seed), "sized")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes), "targets").withColumnRenamed("source", "of")
    summed = running_totals(keyed, ["source"], ORDER, {"before": "size"})
    out = summed.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    return out.withColumn("epochs", epochs.cast("long")).withColumn(
        "left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))


def mixed(documents: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``documents(doc_id, text, source)``.

    A null or blank text has size 0 and gives 0 words. A null source is a source of
    its own, last in order. Rows that repeat share a key; either of them is first.
    An empty table gives an empty result; other columns are ignored.
    """
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return _placed(documents, seed).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(documents: DataFrame, seed: int = 17) -> DataFrame:
    """The whole ``row`` of each document with (size, source_size, target, taken).

    Texts are not shuffled: the cut of each source, one row, is found on the slim
    rows, and each document is held against the cut of its source. Rows that repeat
    right at the cut share its words evenly (less than one word each is lost).
    """
    placed = stored(_placed(documents, seed), "placed")
    beyond = placed.where("before + size > left")
    place = F.struct(*ORDER)
    cut = beyond.groupBy(F.col("source").alias("of")).agg(F.min(place).alias("at"))
    same = placed.withColumn("place", place).join(
        stored(cut, "cuts"), F.col("source").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
    shared = same.groupBy("of", "at").agg(
        F.first(F.col("left")).alias("rest"), F.min("before").alias("ahead"), F.count("*").alias("copies"))
    sources = placed.groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "epochs")])
    known = stored(sources.join(shared, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "epochs", "at",
        (F.col("rest") - F.col("ahead")).alias("words"), "copies"), "cuts")
    rows = _keyed(documents, seed, F.struct(*quoted(documents.columns)).alias("row")).withColumn("place", place)
    out = rows.join(known, F.col("source").eqNullSafe(F.col("of")))
    part = (F.when(F.col("at").isNull() | (F.col("place") < F.col("at")), F.col("size"))
            .when(F.col("place") == F.col("at"), F.floor(F.col("words") / F.col("copies"))).otherwise(0))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return out.select("row", "size", "source_size", "target", taken.alias("taken"))
