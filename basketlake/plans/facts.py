"""Facts about fitted models that any engine can state: rows, labels, counts, rules.

Metric values depend on the implementation of an estimator; what is checked here must
hold for every fit: the keys a model scores, labels carried through, probabilities in
[0, 1], predictions that follow their rule, counts that add up, one row per cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.models import common, profiles
from basketlake.operators.metrics import THRESHOLDS
from basketlake.plans import registry
from basketlake.plans.layers import Lake
from basketlake.plans.registry import query

_SPLIT = f"""
SELECT session_id, user_id, converted,
       CASE WHEN {registry._BUCKET} < 70 THEN 'train' WHEN {registry._BUCKET} < 85 THEN 'validation'
            ELSE 'test' END AS split FROM keyed"""
_STRATIFIED = """
SELECT session_id, user_id, converted FROM (
  SELECT *, row_number() OVER (PARTITION BY converted ORDER BY digest, session_id, user_id)
              <= round(count(*) OVER (PARTITION BY converted) * 0.2) AS tested FROM keyed) WHERE tested"""

RATES = ("accuracy", "precision", "recall", "f1")


def within(*columns: str) -> Column:
    """All columns lie in [0, 1]."""
    out = F.lit(True)
    for name in columns:
        out = out & F.col(name).between(0.0, 1.0)
    return out


def counted(report: DataFrame, prefix: str = "") -> DataFrame:
    """Rows, positives, and whether the accuracy follows from the counts."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    right = F.abs(F.col(f"{prefix}accuracy") - (F.col("tp") + F.col("tn")) / n) < 1e-6
    return report.withColumns({
        "n": n, "positives": F.col("tp") + F.col("fn"),
        "consistent": right & within(*(prefix + r for r in RATES)),
    })


def _scored(model, rows: DataFrame) -> DataFrame:
    rule = F.col("prediction") == F.when(F.col("probability_1") > 0.5, 1.0).otherwise(0.0)
    tie = F.abs(F.col("probability_1") - 0.5) < 1e-9
    return common.score(model, rows).select(
        "session_id", "user_id", "converted", (within("probability_1") & (rule | tie)).alias("consistent"))


_VALIDATION = f"SELECT session_id, user_id, converted, true AS consistent FROM ({_SPLIT}) WHERE split = 'validation'"
_TEST = f"SELECT count(*) AS n, CAST(sum(converted) AS BIGINT) AS positives, true AS consistent FROM ({_SPLIT}) WHERE split = 'test'"


@query("train_rf_v3_facts", _VALIDATION)
def _(lk: Lake):
    return _scored(lk.rf_v3(), lk.part("validation"))


@query("train_gbt_v3_facts", _VALIDATION)
def _(lk: Lake):
    return _scored(lk.gbt_v3(), lk.part("validation"))


@query("training_report_facts", _TEST)
def _(lk: Lake):
    """Counts add up, areas lie in [0, 1], and the winner follows from the areas."""
    rule = F.when(F.col("gbt_validation_roc_auc") > F.col("rf_validation_roc_auc"), "GBTClassifier").otherwise("RandomForestClassifier")
    areas = [f"{m}_validation_{a}" for m in ("rf", "gbt") for a in ("roc_auc", "pr_auc")] + ["test_roc_auc", "test_pr_auc"]
    report = counted(registry.QUERIES["training_report"](lk.spark, lk.sf_dir), "test_")
    return report.select("n", "positives", (F.col("consistent") & within(*areas) & (F.col("winner") == rule)).alias("consistent"))


@query("tuned_thresholds_facts", f"""
SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n, CAST(sum(converted) AS BIGINT) AS positives, true AS consistent
FROM (SELECT unnest({THRESHOLDS}) AS t), ({_SPLIT}) WHERE split = 'validation' GROUP BY t""")
def _(lk: Lake):
    """Every threshold sees all validation rows; the rates follow from the counts."""
    return counted(registry.QUERIES["tuned_thresholds"](lk.spark, lk.sf_dir)).select("threshold", "n", "positives", "consistent")


@query("final_threshold_eval_facts", _TEST)
def _(lk: Lake):
    report = counted(registry.QUERIES["final_threshold_eval"](lk.spark, lk.sf_dir))
    known = F.col("best_threshold").isin(THRESHOLDS) & within("roc_auc", "pr_auc")
    return report.select("n", "positives", (F.col("consistent") & known).alias("consistent"))


@query("score_conversion_v1_facts", f"SELECT *, true AS consistent FROM ({_STRATIFIED})")
def _(lk: Lake):
    """Scores of the test rows, and the report bin each falls into."""
    score = F.col("conversion_score")
    bin_ = F.when(score <= 0.25, "Baixa Propensao").when(score <= 0.75, "Media Propensao").otherwise("Alta Propensao")
    edge = (F.abs(score - 0.25) < 1e-5) | (F.abs(score - 0.75) < 1e-5)
    rows = registry.QUERIES["score_conversion_v1"](lk.spark, lk.sf_dir)
    return rows.select("session_id", "user_id", "converted", (within("conversion_score") & ((F.col("score_band") == bin_) | edge)).alias("consistent"))


@query("propensity_metrics_v1_facts", f"""
SELECT count(*) AS n, CAST(sum(converted) AS BIGINT) AS positives, true AS consistent FROM ({_STRATIFIED})""")
def _(lk: Lake):
    return counted(registry.QUERIES["propensity_metrics_v1"](lk.spark, lk.sf_dir)).select("n", "positives", "consistent")


@query("feature_importance_v1_facts", f"""
SELECT unnest({schemas.PROPENSITY_FEATURES}) AS feature, true AS consistent""")
def _(lk: Lake):
    """One row per feature; importances are shares of one."""
    rows = common.feature_importance(lk.propensity(), schemas.PROPENSITY_FEATURES)
    total = rows.agg(F.abs(F.sum("importance") - 1) < 1e-6).first()[0]
    return rows.select("feature", (within("importance") & F.lit(total)).alias("consistent"))


@query("compare_abandonment_models_facts", """
SELECT 3 AS models, 1 AS best, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN is_abandoned = 1 THEN n ELSE 0 END) AS BIGINT) AS positives,
       true AS consistent
FROM (SELECT is_abandoned, round(count(*) * 0.2) AS n FROM cart_features GROUP BY is_abandoned)""")
def _(lk: Lake):
    """All candidates see the same test rows; the best one has the largest area."""
    report = counted(lk.abandonment()[1])
    best = F.max("roc_auc") == F.max(F.when(F.col("is_best"), F.col("roc_auc")))
    return report.agg(
        F.count("*").cast("int").alias("models"), F.sum(F.col("is_best").cast("int")).cast("int").alias("best"),
        F.max("n").alias("n"), F.max("positives").alias("positives"),
        (F.every("consistent") & best & (F.min("n") == F.max("n")) & (F.min("positives") == F.max("positives"))).alias("consistent"))


@query("recommend_batch_facts", "SELECT user_session, user_id, true AS consistent FROM cart_features")
def _(lk: Lake):
    """The coupon of each cart, worked out again from the reported risk and value."""
    code = F.expr("""CASE WHEN p_abandonment < 0.40 THEN 'NENHUM'
        WHEN p_abandonment < 0.65 THEN CASE WHEN total_cart_value >= 300 THEN 'FRETE_GRATIS' ELSE 'DESC5' END
        WHEN p_abandonment < 0.85 THEN CASE WHEN total_cart_value >= 500 THEN 'DESC10' ELSE 'DESC5_FRETE' END
        ELSE CASE WHEN total_cart_value >= 800 THEN 'RECUPE15' ELSE 'DESC10_FRETE' END END""")
    from basketlake.models import abandonment

    rows = abandonment.recommend_batch(lk.cart_features(), lk.abandonment()[0])
    return rows.select("user_session", "user_id", (within("p_abandonment") & (F.col("coupon_code") == code)).alias("consistent"))


@query("abandonment_7f_facts", "SELECT 1 AS reports, true AS consistent FROM labelled LIMIT 1")
def _(lk: Lake):
    return lk.abandonment_7f()[1].agg(F.count("*").cast("int").alias("reports"), F.every(within("accuracy", "roc_auc")).alias("consistent"))


@query("profile_classifier_facts", "SELECT DISTINCT user_profile AS class, true AS consistent FROM labelled")
def _(lk: Lake):
    """Every profile of the labelled table is reported; none else appears."""
    report = lk.profile_classifier()[1]
    known = lk.labelled().select(F.col("user_profile").alias("class")).distinct()
    seen = report.select("class", within("precision", "recall", "f1").alias("ok"))
    return known.join(seen, "class", "full").select("class", F.coalesce("ok", F.lit(True)).alias("consistent"))


@query("customer_clusters_facts", "SELECT session_id, user_id, converted, true AS consistent FROM keyed")
def _(lk: Lake):
    return lk.clustered().select("session_id", "user_id", "converted", F.col("cluster").isin(0, 1, 2).alias("consistent"))


@query("cluster_profiles_facts", """
SELECT 3 AS clusters, 3 AS profiles, count(*) AS sessions, true AS consistent FROM keyed""")
def _(lk: Lake):
    """Sizes add up to all sessions, each profile names one cluster, rates add up to 100."""
    rows = registry.QUERIES["cluster_profiles"](lk.spark, lk.sf_dir)
    return rows.agg(
        F.countDistinct("cluster").cast("int").alias("clusters"), F.countDistinct("profile").cast("int").alias("profiles"),
        F.sum("sessions").alias("sessions"),
        F.every(F.abs(F.col("conversion_rate") + F.col("abandonment_rate") - 100) < 0.011).alias("consistent"))


@query("centroids_facts", "SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS cluster, true AS consistent FROM (SELECT count(*) FROM keyed)")
def _(lk: Lake):
    """Each centre is the mean of the rows assigned to it."""
    centres = profiles.centroids_original_scale(lk.segments(), lk.profile_rows())
    means = lk.clustered().groupBy("cluster").agg(*[F.avg(c).alias(f"mean_{c}") for c in schemas.PROFILE_FEATURES])
    near = F.lit(True)
    for c in schemas.PROFILE_FEATURES:
        near = near & (F.abs(F.col(c) - F.col(f"mean_{c}")) <= 1e-2 * (1 + F.abs(F.col(f"mean_{c}"))))
    return centres.join(means, "cluster").select("cluster", near.alias("consistent"))


@query("silhouette_facts", "SELECT 1 AS n, true AS consistent FROM (SELECT count(*) FROM keyed)")
def _(lk: Lake):
    rows = profiles.silhouette(lk.segments(), lk.profile_rows())
    return rows.agg(F.count("*").cast("int").alias("n"), F.every(F.col("silhouette_score").between(-1.0, 1.0)).alias("consistent"))


@query("cart_offers_scored_facts", """
SELECT user_session, user_id, true AS consistent FROM bought_since
WHERE bought IS NULL OR bought > first_cart_time + INTERVAL 1 HOUR""")
def _(lk: Lake):
    """Every cart unpaid after an hour gets one offer with a risk and a coupon."""
    rows = registry.QUERIES["cart_offers_scored"](lk.spark, lk.sf_dir)
    good = F.col("ml_abandonment_risk_pct").between(0.0, 100.0) & F.col("assigned_coupon").isNotNull() & F.col("ml_predicted_profile").isNotNull()
    return rows.select("user_session", "user_id", good.alias("consistent"))


@query("preview_ordered", f"""
SELECT session_id, user_id, {registry._rounded(schemas.BASE_FEATURES)} FROM ml_features
ORDER BY session_id, user_id LIMIT 10""")
def _(lk: Lake):
    """The preview with an order, so that any engine shows the same rows."""
    rows = lk.ml_features().select("session_id", "user_id", *[F.col(c).cast("double").alias(c) for c in schemas.BASE_FEATURES])
    return rows.orderBy("session_id", "user_id").limit(10)
