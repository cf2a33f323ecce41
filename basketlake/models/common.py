"""Assembling, scoring and judging Spark ML pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.operators import metrics
from basketlake.session import scratch_path
from basketlake.sinks.lake import write_layer

SEED = 42
PART_ROWS, PART_MOST = 10_000, 500_000  # rows of a training part: at least, if cores are left, and at most


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def assemble(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """Feature vector plus the columns in ``keep``."""
    return assembler(features).transform(df).select(*keep, "features")


def stored(model):
    """The model as read back from the shared folder.

    A freshly fitted model drags its training summary, and with it the session,
    into every task that scores rows; the stored one holds parameters only.
    """
    path = scratch_path(SparkSession.active(), "fitted")
    model.write().overwrite().save(path)
    return type(model).load(path)


def settled(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as stored in the shared folder, worked out once.

    A cached plan keeps every partition of its shuffles, most of them empty, in each pass
    over it; stored rows are read in as few parts as their size asks for.
    """
    path = scratch_path(df.sparkSession, name)
    write_layer(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows as stored in the shared folder, in a number of parts that suits training.

    Training makes hundreds of passes with one task per part. A plan's own partitions are
    either many empty ones (a shuffle) or a few large ones (files of a small layer); here
    every core gets a part once there are ``PART_ROWS`` rows for it, and no part has many
    more than ``PART_MOST``. The estimators keep their own form of the rows.
    """
    found = settled(df)
    rows = found.count()
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)), -(-rows // PART_MOST))
    return settled(found.repartition(parts))


def fit_on(df: DataFrame, features: list[str], classifier) -> PipelineModel:
    """Fit ``classifier`` on assembled features; the pipeline carries its feature list."""
    vectors = assembler(features)
    label, weight = classifier.getLabelCol(), None
    if classifier.hasParam("weightCol") and classifier.isSet("weightCol"):
        weight = classifier.getWeightCol()
    model = classifier.fit(spread(assemble(df, features, label, *([weight] if weight else []))))
    return PipelineModel(stages=[vectors, stored(model)])


def score(model: Transformer, df: DataFrame, column: str = "probability_1") -> DataFrame:
    """Predictions with the probability of class 1 in ``column``."""
    return model.transform(df).withColumn(column, vector_to_array("probability")[1])


def evaluate(predictions: dict[str, DataFrame], label: str) -> dict[str, dict[str, float]]:
    """Areas, confusion counts and metrics of each named set of predictions.

    Rows are scored once: all figures come from counts per name, score and prediction. The
    score is the probability of class 1.
    """
    counts = settled(reduce(DataFrame.unionByName, [
        metrics.score_counts(rows, label, vector_to_array("probability")[1], model=F.lit(name), prediction="prediction")
        for name, rows in predictions.items()]), "score_counts")
    found = {name: {"roc_auc": 0.0, "pr_auc": 0.0} for name in predictions}
    for row in metrics.curve_areas(counts, ["model"]).collect():  # one row per name
        found[row["model"]] |= {"roc_auc": row["roc_auc"], "pr_auc": row["pr_auc"]}
    for name in predictions:
        own = counts.filter(F.col("model") == name)
        hit = F.col("prediction") == 1
        confusion = own.agg(*[
            F.coalesce(F.sum(F.when(called, F.col(side))), F.lit(0)).alias(cell)
            for cell, called, side in (("tp", hit, "positives"), ("fp", hit, "negatives"),
                                       ("fn", ~hit, "positives"), ("tn", ~hit, "negatives"))])
        found[name] |= metrics.classification_metrics(confusion).first().asDict()
    return found


def evaluate_auc(predictions: DataFrame, label: str) -> dict[str, float]:
    """Areas under the ROC and the precision-recall curve."""
    found = evaluate({"": predictions}, label)[""]
    return {name: found[name] for name in ("roc_auc", "pr_auc")}


def feature_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance per feature, highest first (one row per feature)."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(features, weights)]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    """Feature list a stored pipeline was trained on."""
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
