"""Quality figures of binary and multi-class predictions as aggregates.

The heavy part of each is one aggregate with map-side combining; what follows
works on a handful of counted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlake.functions.columns import count_if, ratio

# Thresholds tried on the validation set
CURVE_CUTS = 255  # quantiles that cut the scores of a curve into ranges
THRESHOLDS = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).count().orderBy(target)


def abandonment_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("is_abandoned").alias("abandonment_rate"))


def confusion_counts(
    df: DataFrame, label: str = "converted", prediction: str = "prediction"
) -> DataFrame:
    """One row: tp, fp, fn, tn."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        F.coalesce(count_if((y == 1) & (p == 1)), F.lit(0)).alias("tp"),
        F.coalesce(count_if((y == 0) & (p == 1)), F.lit(0)).alias("fp"),
        F.coalesce(count_if((y == 1) & (p == 0)), F.lit(0)).alias("fn"),
        F.coalesce(count_if((y == 0) & (p == 0)), F.lit(0)).alias("tn"),
    )


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and F1 to confusion counts; 0 for empty bases."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    }).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def class_report(
    df: DataFrame, label: str = "converted", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class.

    Rows are counted per (label, prediction) pair first; the rest sees one row
    per pair.
    """
    pairs = df.groupBy(
        F.col(label).cast("string").alias("label"),
        F.col(prediction).cast("string").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = pairs.groupBy(F.col("label").alias("class")).agg(
        F.sum(hit).alias("hits"), F.sum("n").alias("support")
    )
    called = pairs.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    table = actual.join(called, "class", "full").fillna(0, ["hits", "support", "called"])
    return (
        table.withColumns({
            "precision": ratio(F.col("hits"), F.col("called")),
            "recall": ratio(F.col("hits"), F.col("support")),
        })
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
        .select("class", "precision", "recall", "f1", "support")
        .orderBy("class")
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: list[float] = THRESHOLDS,
    label: str = "converted",
    probability: str = "probability_1",
) -> DataFrame:
    """Counts and metrics for each threshold, in one pass over the predictions.

    A row counts as positive from its highest passed threshold downwards, so rows
    are counted per (thresholds passed, label) and summed up from there.
    """
    ordered = sorted(thresholds)
    passed = sum(
        (F.when(F.col(probability) >= t, 1).otherwise(0) for t in ordered), F.lit(0)
    )
    counted = df.groupBy(passed.alias("passed"), F.col(label).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    y, n = F.col("y"), F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    def outcome(step: int, threshold: float) -> Column:
        positive = F.col("passed") >= step
        return F.struct(
            F.lit(threshold).alias("threshold"),
            total(positive & (y == 1)).alias("tp"),
            total(positive & (y == 0)).alias("fp"),
            total(~positive & (y == 1)).alias("fn"),
            total(~positive & (y == 0)).alias("tn"),
        )

    outcomes = F.array(*[outcome(i, t) for i, t in enumerate(ordered, start=1)])
    counts = counted.agg(outcomes.alias("outcomes")).select(F.inline("outcomes"))
    return classification_metrics(counts).orderBy("threshold")


def score_counts(
    df: DataFrame, label: str = "converted", score: str | Column = "probability_1", **keys: str | Column
) -> DataFrame:
    """Positives and negatives per ``keys`` and distinct score: all that curves and confusion need.

    One pass with map-side combining; rows without a score are left out.
    """
    score = F.col(score) if isinstance(score, str) else score
    named = [(F.col(k) if isinstance(k, str) else k).alias(name) for name, k in keys.items()]
    rows = df.select(*named, score.alias("score"), F.col(label).alias("_y")).filter(F.col("score").isNotNull())
    return rows.groupBy(*keys, "score").agg(
        count_if(F.col("_y") == 1).alias("positives"), count_if(F.col("_y") == 0).alias("negatives"))


def curve_areas(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """Areas under the ROC and the precision-recall curve per ``by``, exact, from score counts.

    Distinct scores are cut at quantiles into at most ``CURVE_CUTS`` + 1 ranges. Each range
    is a window of its own; what lies above it comes from one row per range. The
    curves have a point at each distinct score (equal scores count half), the
    precision-recall curve begins level. Areas are 0 where a class is missing.
    """
    merged = counts.groupBy(*by, "score").agg(F.sum("positives").alias("pos"), F.sum("negatives").alias("neg"))
    quantiles = [i / (CURVE_CUTS + 1) for i in range(1, CURVE_CUTS + 1)]
    cuts = merged.agg(F.percentile_approx("score", quantiles, CURVE_CUTS * 100)).scalar()
    ranged = merged.withColumn("_cuts", cuts).withColumn(
        "_range", F.size(F.filter("_cuts", lambda cut: cut <= F.col("score")))).drop("_cuts")
    sums = ranged.groupBy(*by, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    bases = sums.select(
        *by, "_range",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_p", "_n")],
        *[F.sum(c).over(everything).alias(f"{c}_all") for c in ("_p", "_n")])
    higher = Window.partitionBy(*by, "_range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    point = ranged.join(F.broadcast(bases), [*by, "_range"]).withColumns({
        "tp": F.coalesce(F.sum("pos").over(higher), F.lit(0)) + F.col("_p_above"),
        "fp": F.coalesce(F.sum("neg").over(higher), F.lit(0)) + F.col("_n_above"),
    })
    pos, tp, fp = F.col("pos"), F.col("tp"), F.col("fp")
    after = (tp + pos) / (tp + pos + fp + F.col("neg"))
    before = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(after)
    summed = point.groupBy(*by).agg(
        F.sum(F.col("neg") * (tp + pos / 2)).alias("_roc"), F.sum(pos * (before + after) / 2).alias("_pr"),
        F.first("_p_all").alias("_p"), F.first("_n_all").alias("_n"))
    return summed.select(
        *by, ratio(F.col("_roc"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        ratio(F.col("_pr"), F.col("_p")).alias("pr_auc"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1; the lowest of equals."""
    return sweep.orderBy(F.col("f1").desc(), F.col("threshold")).limit(1)


def score_band_distribution(df: DataFrame, band: str = "score_band") -> DataFrame:
    return df.groupBy(band).count().orderBy(band)


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").count().orderBy("cluster")


def cluster_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature per cluster, two digits."""
    means = [F.round(F.avg(name), 2).alias(name) for name in features]
    return df.groupBy("cluster").agg(*means).orderBy("cluster")


def cluster_conversion(df: DataFrame) -> DataFrame:
    """Sessions, conversion and abandonment in percent per cluster, two digits."""
    return df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.avg("converted") * 100, 2).alias("conversion_rate"),
        F.round(F.avg("is_abandoned") * 100, 2).alias("abandonment_rate"),
    ).orderBy("cluster")
