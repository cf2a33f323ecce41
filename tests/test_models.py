import pytest
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.functions import rules
from basketlake.models import abandonment, common, conversion, profiles
from basketlake.operators.decisions import with_profile


@pytest.fixture(scope="module")
def planted(spark):
    """Conversion follows one feature, with some noise."""
    names = schemas.FEATURES_V3
    columns = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(17)).cast("double").alias(n)
               for i, n in enumerate(names)]
    noisy = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    signal = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(17)) >= 8
    return spark.range(600).select(
        F.when(signal != noisy, 1).otherwise(0).alias("converted"), *columns).coalesce(1)


def test_fit_select_report_and_tune(spark, planted, tmp_path):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    train, test = planted.filter(F.col("seconds_per_view") < 13), planted
    rf = common.fit_on(train, schemas.FEATURES_V3, RandomForestClassifier(
        labelCol="converted", numTrees=10, maxDepth=4, seed=1))
    gbt = common.fit_on(train, schemas.FEATURES_V3, GBTClassifier(
        labelCol="converted", maxIter=3, maxDepth=3, seed=1))
    winner, model, areas = conversion.choose_model(rf, gbt, test)
    assert min(areas["rf_validation_roc_auc"], areas["gbt_validation_roc_auc"]) > 0.7
    assert winner == conversion.select_winner(
        areas["rf_validation_roc_auc"], areas["gbt_validation_roc_auc"])
    report = conversion.training_report(winner, model, areas, test)
    assert len(report.columns) == 15
    row = report.first()
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 600
    common.save_model(model, str(tmp_path / "m"))
    loaded = common.load_model(str(tmp_path / "m"))
    assert common.model_features(loaded) == schemas.FEATURES_V3
    sweep = conversion.tune_threshold(loaded, test)
    final = conversion.final_threshold_eval(loaded, sweep, test).first()
    best = max(sweep.collect(), key=lambda r: (r["f1"], -r["threshold"]))
    assert final["best_threshold"] == best["threshold"] and final["f1"] == pytest.approx(best["f1"])
    importance = common.feature_importance(rf, schemas.FEATURES_V3).first()
    assert importance["feature"] == "num_views_before_cart"


def test_first_model_reports_areas_and_metrics(spark, planted):
    from pyspark.ml.classification import RandomForestClassifier

    model = common.fit_on(planted, schemas.FEATURES_V3, RandomForestClassifier(
        labelCol="converted", numTrees=5, maxDepth=3, seed=1))
    row = conversion.propensity_metrics(model, planted).first()
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 600
    assert row["accuracy"] == (row["tp"] + row["tn"]) / 600 and 0.7 < row["roc_auc"] <= 1 and row["pr_auc"] > 0.7
    assert common.evaluate_auc(model.transform(planted), "converted")["roc_auc"] == pytest.approx(row["roc_auc"])


def test_boosting_must_be_strictly_better():
    assert conversion.select_winner(0.7, 0.7) == "RandomForestClassifier"
    assert conversion.select_winner(0.7, 0.71) == "GBTClassifier"


def test_published_settings():
    import inspect

    forest, boosting = (inspect.getsource(f) for f in (conversion.train_rf_v3, conversion.train_gbt_v3))
    assert "numTrees=200" in forest and "maxIter=120" in boosting and "stepSize=0.05" in boosting


def test_class_weights_balance(spark):
    frame = spark.createDataFrame([(1,), (0,), (0,), (0,)], "converted int")
    weights = {r["converted"]: r["class_weight"]
               for r in conversion.with_class_weight(frame).distinct().collect()}
    assert weights == {1: 2.0, 0: pytest.approx(2 / 3)}


def test_preprocessor_gives_zeros_for_an_unknown_category(spark):
    numbers = {n: 1.0 for n in schemas.ABANDONMENT_NUMERIC}
    schema = ", ".join(f"{n} double" for n in numbers) + ", main_category string"

    def frame(*categories):
        return spark.createDataFrame(
            [(*(v + i for v in numbers.values()), c) for i, c in enumerate(categories)], schema)

    fitted = abandonment.abandonment_preprocessor().fit(frame("a", "b", "c"))
    vectors = [r["features"].toArray()[14:].tolist()
               for r in fitted.transform(frame("a", "c", "new")).collect()]
    assert vectors == [[1, 0, 0], [0, 0, 1], [0, 0, 0]]


def _noting_parts(base, seen):
    """The estimator, noting the number of partitions it is fitted on."""
    class Noting(base):
        def fit(self, rows, params=None):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows, params)

    return Noting


def test_candidates_train_on_few_parts_of_a_scattered_table(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    names = [*schemas.ABANDONMENT_NUMERIC]
    carts = spark.range(300).repartition(40).select(
        F.concat(F.lit("s"), "id").alias("user_session"), (F.col("id") % 2).cast("int").alias("is_abandoned"),
        *[((F.col("id") * (i + 3)) % 11 + F.col("id") % 2).cast("double").alias(n) for i, n in enumerate(names)],
        F.concat(F.lit("c"), F.col("id") % 3).alias(schemas.ABANDONMENT_CATEGORICAL))
    seen = []
    noting = _noting_parts(LogisticRegression, seen)
    monkeypatch.setattr(abandonment, "_candidates", lambda rows: [("a", noting(labelCol="is_abandoned", maxIter=3))])
    report = abandonment.compare_abandonment_models(carts)[1].first()
    assert seen == [1]
    assert report["tp"] + report["fp"] + report["fn"] + report["tn"] == 60


def test_training_uses_all_cores_for_rows_of_one_file(spark, planted, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    monkeypatch.setattr(common, "PART_ROWS", 100)
    seen = []
    common.fit_on(planted, schemas.FEATURES_V3, _noting_parts(LogisticRegression, seen)(labelCol="converted", maxIter=3))
    assert seen == [4]


def test_spread_keeps_rows_and_column_metadata(spark, planted):
    fitted = abandonment.StringIndexer(inputCol="converted", outputCol="index").fit(planted)
    rows = common.assemble(fitted.transform(planted), schemas.FEATURES_V3[:3], "index")
    stored = common.spread(rows)
    assert [f.metadata for f in stored.schema] == [f.metadata for f in rows.schema] != [{}, {}]
    assert sorted(stored.collect(), key=repr) == sorted(rows.collect(), key=repr)


def test_segments(spark):
    names = schemas.PROFILE_FEATURES
    centres = [0.0, 50.0, 100.0]
    rows = [
        (f"s{i}", i, *(centres[i % 3] + (i * 7 + j) % 5 for j in range(12)), i % 2, 1 - i % 2)
        for i in range(90)
    ]
    frame = spark.createDataFrame(
        rows, "session_id string, user_id long, " + ", ".join(f"{n} double" for n in names)
              + ", is_abandoned int, converted int")
    model = profiles.fit_profiles(frame, restarts=3)
    clustered = profiles.assign_clusters(model, frame)
    assert sorted(r["count"] for r in clustered.groupBy("cluster").count().collect()) == [30] * 3
    assert profiles.silhouette(model, frame).first()[0] > 0.9
    centroids = profiles.centroids_original_scale(model, frame)
    assert sorted(r["hour_of_day"] for r in centroids.collect()) == pytest.approx([2, 52, 102])
    mapping = {r["cluster"]: r["profile"] for r in profiles.profile_mapping(centroids).collect()}
    by_views = [r["cluster"] for r in centroids.orderBy("num_views_before_cart").collect()]
    assert [mapping[c] for c in by_views] == [
        rules.HIGH_INTENT, rules.DISCOUNT_HUNTER, rules.UNDECIDED]
    named = with_profile(clustered, profiles.profile_mapping(centroids))
    assert named.filter("profile IS NULL").count() == 0


def test_labelled_features(spark):
    frame = spark.createDataFrame(
        [(1, 3, None), (0, 5, 10), (3, 2, 10)],
        "num_cart_items int, num_views_before_cart int, session_duration_sec int")
    for name in set(schemas.LABELLED_FEATURES) - set(frame.columns) - {"view_to_cart_ratio"}:
        frame = frame.withColumn(name, F.lit(1))
    got = [(r["view_to_cart_ratio"], r["session_duration_sec"])
           for r in abandonment.labelled_features(frame).collect()]
    assert got == [(3.0, 0), (5.0, 10), (0.67, 10)]
