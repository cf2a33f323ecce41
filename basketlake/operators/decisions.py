"""Commercial decisions as column rules and joins with fixed rule tables.

The rule tables have at most nine rows each, so broadcasting them is always
safe, and the texts reach the rows without a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake.functions import rules
from basketlake.functions.columns import night_flag


def _rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _valid_score(score: Column) -> Column:
    # NaN sorts above every number in Spark, so it fails the upper bound.
    return (score >= 0) & (score <= 1)


def score_band(score: Column, strict: bool = False) -> Column:
    """Band of a score in [0, 1]; outside it NULL, or an error in strict mode."""
    wrong = (
        F.raise_error(F.lit("conversion_score must lie between 0 and 1")).cast("string")
        if strict else F.lit(None).cast("string")
    )
    return (
        F.when(~_valid_score(score) | score.isNull(), wrong)
        .when(score <= 0.25, rules.BAND_LOW)
        .when(score <= 0.75, rules.BAND_MODERATE)
        .otherwise(rules.BAND_HIGH)
    )


def propensity_bin(score: Column) -> Column:
    """Report bins (-0.01, 0.25], (0.25, 0.75], (0.75, 1]; NULL outside them."""
    return (
        F.when((score > -0.01) & (score <= 0.25), rules.BAND_LOW)
        .when((score > 0.25) & (score <= 0.75), rules.BAND_MEDIUM)
        .when((score > 0.75) & (score <= 1.0), rules.BAND_HIGH)
    )


def with_action(df: DataFrame) -> DataFrame:
    """Add action, benefit and message for (profile, score_band)."""
    table = _rule_table(
        df.sparkSession, rules.ACTIONS,
        "profile string, score_band string, action string, benefit string, message string",
    )
    return df.join(table, ["profile", "score_band"], "left")


def decide(df: DataFrame, strict: bool = False) -> DataFrame:
    """Decision per row from ``profile`` and ``conversion_score``.

    Rows that cannot be decided keep NULL texts and say why in
    ``invalid_reason``; in strict mode they raise.
    """
    score = F.col("conversion_score").cast("double")
    known = F.coalesce(
        F.col("profile").isin(rules.HIGH_INTENT, rules.UNDECIDED, rules.DISCOUNT_HUNTER),
        F.lit(False),
    )
    reason = F.when(score.isNull() | ~_valid_score(score), "score outside [0, 1]").when(
        ~known, "unknown profile"
    )
    checked = df.withColumns({
        "score_band": score_band(score, strict),
        "conversion_score": F.bround(score, 4),
        "invalid_reason": reason,
    })
    if strict:
        checked = checked.withColumn(
            "profile",
            F.when(known, F.col("profile")).otherwise(
                F.raise_error(F.concat(F.lit("unknown profile: "), F.col("profile")))
                .cast("string")
            ),
        )
    return with_action(checked)


def with_profile(
    df: DataFrame, mapping: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Add the profile name of ``cluster``; the default mapping is the published one.

    ``mapping`` (cluster, profile) has one row per cluster of the fit.
    """
    if mapping is None:
        mapping = df.sparkSession.createDataFrame(
            rules.CLUSTER_PROFILES, "cluster int, profile string"
        )
    named = df.join(F.broadcast(mapping), "cluster", "left")
    if not strict:
        return named
    unknown = F.raise_error(
        F.concat(F.lit("unknown cluster: "), F.col("cluster").cast("string"))
    ).cast("string")
    return named.withColumn("profile", F.coalesce(F.col("profile"), unknown))


def decide_from_cluster(
    df: DataFrame, mapping: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Decision per row from ``cluster`` and ``conversion_score``."""
    return decide(with_profile(df, mapping, strict), strict)


def coupon_code(risk: Column, cart_value: Column) -> Column:
    """Coupon for an abandonment risk and a cart value.

    A missing or NaN risk fails every comparison and gets the last tier, as in a
    plain chain of comparisons.
    """
    chosen = None
    for limit, value_from, first, second in rules.COUPON_TIERS:
        code = F.lit(first)
        if value_from is not None:
            code = F.when(cart_value >= value_from, first).otherwise(second)
        if limit is None:
            return chosen.otherwise(code)
        chosen = (F if chosen is None else chosen).when(risk < limit, code)
    raise AssertionError("the last tier has no limit")


def recommend_coupon(
    df: DataFrame, risk: str = "p_abandonment", cart_value: str = "total_cart_value"
) -> DataFrame:
    """Add coupon columns and the revenue a coupon is expected to bring back."""
    table = _rule_table(
        df.sparkSession, rules.COUPONS,
        "coupon_code string, coupon_label string, discount_pct double, free_shipping boolean, "
        "urgency_level string, rationale string",
    )
    coded = df.withColumn("coupon_code", coupon_code(F.col(risk), F.col(cart_value)))
    return coded.join(table, "coupon_code", "left").withColumn(
        "estimated_recovered_gmv",
        recovered_gmv(F.col("coupon_code"), F.col(cart_value), F.col("discount_pct")),
    )


def recovered_gmv(code: Column, cart_value: Column, discount: Column) -> Column:
    expected = cart_value * F.lit(rules.CONVERSION_LIFT) * (F.lit(1.0) - discount)
    return F.when(code != "NENHUM", expected).otherwise(F.lit(0.0))


def profile_fallback(views: Column, is_night: Column) -> Column:
    """Profile while no profile model is trained."""
    return (
        F.when(views <= 3, "high_intent")
        .when((views >= 6) | (is_night == 1), "bargain_hunter")
        .otherwise("browser")
    )


def profile_label_rule(
    views: Column, duration: Column, is_night: Column, cart_value: Column
) -> Column:
    """Profile label of a labelled session."""
    return (
        F.when((views <= 3) & (duration < 90), "high_intent")
        .when((views >= 6) | ((is_night == 1) & (cart_value >= 400)), "bargain_hunter")
        .otherwise("browser")
    )


def prescribe_by_profile(
    df: DataFrame, profile: str = "predicted_profile", cart_value: str = "total_cart_value"
) -> DataFrame:
    """Add display name, coupon, label and rationale; unknown profiles count as browser."""
    spark = df.sparkSession
    value = F.col(cart_value)
    group = F.when(
        F.col(profile).isin("high_intent", "bargain_hunter"), F.col(profile)
    ).otherwise("browser")
    reaches = F.lit(False)
    for name, limit in rules.PROFILE_LIMITS:
        reaches = F.when(F.col("_group") == name, F.coalesce(value >= limit, F.lit(False))).otherwise(reaches)
    coupons = _rule_table(
        spark, rules.PROFILE_COUPONS,
        "_group string, _reaches boolean, assigned_coupon string, coupon_label string",
    )
    texts = _rule_table(
        spark, rules.PROFILE_TEXTS,
        "_group string, profile_name_pt string, action_rationale string",
    )
    return (
        df.withColumn("_group", group).withColumn("_reaches", reaches)
        .join(coupons, ["_group", "_reaches"], "left")
        .join(texts, "_group", "left")
        .drop("_group", "_reaches")
    )


def offer_features(df: DataFrame) -> DataFrame:
    """Session figures of an offer with defaults, ratio to two digits and the night flag."""
    filled = df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value))
        for name, value in rules.OFFER_DEFAULTS.items()
    })
    items = F.greatest(F.col("num_cart_items"), F.lit(1))
    return filled.withColumns({
        "view_to_cart_ratio": F.bround(F.col("num_views_before_cart") / items, 2),
        "is_night": night_flag(F.col("hour_of_day")),
    })


def prescribe_offer(
    df: DataFrame, risk: Column | None = None, profile: Column | None = None
) -> DataFrame:
    """The complete one-hour offer for session figures.

    ``risk`` and ``profile`` come from models; without them the fixed risk and the
    fallback rule apply.
    """
    if risk is None:
        risk = F.lit(rules.DEFAULT_RISK)
    if profile is None:
        profile = profile_fallback(F.col("num_views_before_cart"), F.col("is_night"))
    scored = offer_features(df).withColumns({
        "ml_predicted_profile": profile,
        "ml_abandonment_risk_pct": F.bround(risk * 100, 1),
    })
    return prescribe_by_profile(scored, "ml_predicted_profile").withColumns({
        name: F.lit(text) for name, text in rules.OFFER.items()
    })
