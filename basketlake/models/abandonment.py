"""Cart abandonment models: the three-way comparison and the two labelled-table forests."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import (
    IndexToString, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.models.common import SEED, assembler, evaluate, fit_on, score, spread, stored
from basketlake.operators.decisions import recommend_coupon
from basketlake.operators.metrics import class_report
from basketlake.operators.splits import part, split_2way, split_stratified

TARGET = schemas.ABANDONED

# Names under which the three candidates are reported
LOGISTIC = "Regressão Logística (Baseline)"
FOREST = "Random Forest Classifier"
BOOSTING = "HistGradientBoosting"


def abandonment_preprocessor() -> Pipeline:
    """Scaled numbers plus one indicator per known category; an unknown one gives zeros.

    The indexer files unknown categories under one extra index, and the encoder
    drops exactly that last index.
    """
    category = schemas.ABANDONMENT_CATEGORICAL
    return Pipeline(stages=[
        VectorAssembler(inputCols=schemas.ABANDONMENT_NUMERIC, outputCol="numbers",
                        handleInvalid="keep"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(inputCol=category, outputCol="category_index", handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="category_index", outputCol="category_flags", dropLast=True),
        VectorAssembler(inputCols=["scaled", "category_flags"], outputCol="features",
                        handleInvalid="keep"),
    ])


def _candidates(rows: int) -> list[tuple[str, object]]:
    return [
        (LOGISTIC, LogisticRegression(
            labelCol=TARGET, maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False)),
        (FOREST, RandomForestClassifier(labelCol=TARGET, numTrees=100, maxDepth=8, seed=SEED)),
        (BOOSTING, GBTClassifier(labelCol=TARGET, maxIter=100, maxDepth=6, seed=SEED)),
    ]


def compare_abandonment_models(carts: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Fit the three candidates on a stratified split.

    Gives the pipeline with the best test ROC-AUC (the first of equals) and a
    report with one row per candidate.
    """
    halves = split_stratified(carts, TARGET, keys=["user_session"])
    train, test = part(halves, "train"), part(halves, "test")
    prepared = abandonment_preprocessor().fit(train)
    columns = [TARGET, "features"]
    fit_rows, test_rows = (spread(prepared.transform(rows).select(*columns)) for rows in (train, test))
    reports, best = [], None
    for name, estimator in _candidates(fit_rows.count()):
        model = stored(estimator.fit(fit_rows))
        predictions = model.transform(test_rows)
        counts = evaluate({name: predictions}, TARGET)[name]
        auc = counts["roc_auc"]
        reports.append((
            name, float(auc), *(float(counts[m]) for m in
                                ("accuracy", "precision", "recall", "f1")),
            *(int(counts[c]) for c in ("tp", "fp", "fn", "tn")),
        ))
        if best is None or auc > best[0]:
            best = (auc, name, model)
    report = carts.sparkSession.createDataFrame(
        reports,
        "model string, roc_auc double, accuracy double, precision double, recall double, "
        "f1 double, tp bigint, fp bigint, fn bigint, tn bigint",
    ).withColumn("is_best", F.col("model") == best[1])
    return PipelineModel(stages=[*prepared.stages, best[2]]), report


def recommend_batch(carts: DataFrame, model: PipelineModel) -> DataFrame:
    """Score every cart and attach its coupon."""
    inputs = carts.columns
    return recommend_coupon(score(model, carts, "p_abandonment").select(*inputs, "p_abandonment"))


def labelled_features(sessions: DataFrame) -> DataFrame:
    """Add the two-digit view ratio and fill missing figures with 0."""
    items = F.greatest(F.col("num_cart_items"), F.lit(1))
    ratio = F.bround(F.col("num_views_before_cart") / items, 2)
    return sessions.withColumn("view_to_cart_ratio", ratio).fillna(0, schemas.LABELLED_FEATURES)


def _halves(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = split_2way(labelled_features(sessions))
    return part(split, "train"), part(split, "test")


def train_abandonment_7f(sessions: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Forest for abandonment on the labelled table; report with accuracy and ROC-AUC."""
    train, test = _halves(sessions)
    model = fit_on(train, schemas.LABELLED_FEATURES, RandomForestClassifier(
        labelCol=TARGET, numTrees=100, maxDepth=10, seed=SEED))
    found = evaluate({"test": model.transform(test)}, TARGET)["test"]
    report = sessions.sparkSession.createDataFrame(
        [(found["accuracy"], found["roc_auc"])], "accuracy double, roc_auc double"
    )
    return model, report


def train_profile_classifier(sessions: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Forest for the three profiles; report with one row per class."""
    train, test = _halves(sessions)
    indexer = StringIndexer(inputCol="user_profile", outputCol="profile_index",
                            stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    vectors = assembler(schemas.LABELLED_FEATURES)
    forest = RandomForestClassifier(labelCol="profile_index", numTrees=100, maxDepth=8, seed=SEED)
    rows = vectors.transform(indexer.transform(train)).select("profile_index", "features")
    fitted = stored(forest.fit(spread(rows)))
    names = IndexToString(inputCol="prediction", outputCol="ml_predicted_profile",
                          labels=[*indexer.labels, "browser"])
    model = PipelineModel(stages=[vectors, fitted, names])
    predicted = model.transform(test).select("user_profile", "ml_predicted_profile")
    return model, class_report(predicted, "user_profile", "ml_predicted_profile")
