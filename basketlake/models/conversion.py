"""Conversion propensity: the boosted/forest pair with threshold tuning, and the first forest."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.models.common import SEED, evaluate, evaluate_auc, fit_on, score, settled
from basketlake.operators.decisions import propensity_bin
from basketlake.operators.metrics import best_threshold, threshold_sweep

TARGET = schemas.CONVERTED


def train_rf_v3(train: DataFrame, features: list[str] = schemas.FEATURES_V3) -> PipelineModel:
    return fit_on(train, features, RandomForestClassifier(
        labelCol=TARGET, numTrees=200, maxDepth=10, minInstancesPerNode=5,
        featureSubsetStrategy="sqrt", subsamplingRate=0.8, seed=SEED,
    ))


def train_gbt_v3(train: DataFrame, features: list[str] = schemas.FEATURES_V3) -> PipelineModel:
    return fit_on(train, features, GBTClassifier(
        labelCol=TARGET, maxIter=120, maxDepth=6, stepSize=0.05, minInstancesPerNode=5,
        subsamplingRate=0.8, seed=SEED,
    ))


def select_winner(rf_auc: float, gbt_auc: float) -> str:
    """Boosting only wins with a strictly higher validation ROC-AUC."""
    return "GBTClassifier" if gbt_auc > rf_auc else "RandomForestClassifier"


def choose_model(
    rf: PipelineModel, gbt: PipelineModel, validation: DataFrame
) -> tuple[str, PipelineModel, dict[str, float]]:
    """Winner on the validation set alone, with both models' areas."""
    found = evaluate({"rf": rf.transform(validation), "gbt": gbt.transform(validation)}, TARGET)
    areas = {f"{name}_validation_{m}": found[name][m] for name in ("rf", "gbt") for m in ("roc_auc", "pr_auc")}
    winner = select_winner(areas["rf_validation_roc_auc"], areas["gbt_validation_roc_auc"])
    return winner, (gbt if winner == "GBTClassifier" else rf), areas


def training_report(
    winner: str, model: PipelineModel, areas: dict[str, float], test: DataFrame
) -> DataFrame:
    """One row: winner, validation areas, test metrics, test areas, confusion counts."""
    found = evaluate({"test": model.transform(test)}, TARGET)["test"]
    row = {"winner": winner, **areas}
    row |= {f"test_{name}": float(found[name]) for name in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")}
    row |= {name: int(found[name]) for name in ("tp", "fp", "fn", "tn")}
    types = {str: "string", float: "double", int: "bigint"}
    schema = ", ".join(f"{name} {types[type(value)]}" for name, value in row.items())
    return test.sparkSession.createDataFrame([tuple(row.values())], schema)


def tune_threshold(model: PipelineModel, validation: DataFrame) -> DataFrame:
    """Counts and metrics per threshold on the validation set."""
    return threshold_sweep(score(model, validation), label=TARGET)


def final_threshold_eval(model: PipelineModel, sweep: DataFrame, test: DataFrame) -> DataFrame:
    """One row: test metrics at the best validation threshold, with both areas."""
    threshold = best_threshold(sweep).first()["threshold"]
    predictions = settled(score(model, test).select(TARGET, "probability_1", "probability", "prediction"), "predictions")
    areas = evaluate_auc(predictions, TARGET)
    at_best = threshold_sweep(predictions, [threshold], TARGET).first()
    names = ["accuracy", "precision", "recall", "f1"]
    values = [at_best[n] for n in names] + [areas["roc_auc"], areas["pr_auc"]]
    counts = [int(at_best[n]) for n in ("tp", "fp", "fn", "tn")]
    schema = ", ".join(
        [f"{n} double" for n in ["best_threshold", *names, "roc_auc", "pr_auc"]]
        + [f"{n} bigint" for n in ("tp", "fp", "fn", "tn")]
    )
    row = (float(threshold), *map(float, values), *counts)
    return test.sparkSession.createDataFrame([row], schema)


def with_class_weight(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Add ``class_weight`` = n / (classes * rows of the class).

    The joined table has one row per class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k")).first()
    weights = counts.select(
        label, (F.lit(float(totals["_all"] or 0)) / (F.lit(totals["_k"]) * F.col("_n")))
        .alias("class_weight"),
    )
    return df.join(F.broadcast(weights), label)


def train_propensity_v1(train: DataFrame) -> PipelineModel:
    """Forest on fourteen features with balanced class weights."""
    return fit_on(with_class_weight(train), schemas.PROPENSITY_FEATURES, RandomForestClassifier(
        labelCol=TARGET, weightCol="class_weight", numTrees=120, maxDepth=10,
        minInstancesPerNode=10, seed=SEED,
    ))


def propensity_metrics(model: PipelineModel, test: DataFrame) -> DataFrame:
    """One row: confusion counts, metrics and both areas on the test rows."""
    found = evaluate({"test": model.transform(test)}, TARGET)["test"]
    names = ["tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    schema = ", ".join(f"{n} {'bigint' if len(n) == 2 and n != 'f1' else 'double'}" for n in names)
    return test.sparkSession.createDataFrame([tuple(found[n] for n in names)], schema)


def score_conversion(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``conversion_score`` and its report bin ``score_band``; keep the input columns."""
    scored = score(model, df, "conversion_score")
    return scored.withColumn("score_band", propensity_bin(F.col("conversion_score"))).drop(
        "features", "rawPrediction", "probability"
    )
