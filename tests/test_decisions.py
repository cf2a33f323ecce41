import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basketlake.functions import rules
from basketlake.operators import decisions as D


def one(df):
    return df.first().asDict()


def band(spark, score, strict=False):
    frame = spark.createDataFrame([(score,)], "s double")
    return frame.select(D.score_band(F.col("s"), strict).alias("b")).first()["b"]


@pytest.mark.parametrize("score, expected", [
    (0.00, "Baixa Propensao"), (0.25, "Baixa Propensao"),
    (0.26, "Moderada Propensao"), (0.75, "Moderada Propensao"),
    (0.76, "Alta Propensao"), (1.00, "Alta Propensao"),
])
def test_band_edges(spark, score, expected):
    assert band(spark, score) == expected


@pytest.mark.parametrize("score", [-0.01, 1.01, float("nan")])
def test_band_outside(spark, score):
    assert band(spark, score) is None
    with pytest.raises(PySparkException):
        band(spark, score, strict=True)


@pytest.mark.parametrize("profile, score, action", [
    ("Comprador de Alta Intencao", 0.20, "Notificacao Simples"),
    ("Comprador de Alta Intencao", 0.55, "Notificacao de Escassez"),
    ("Comprador de Alta Intencao", 0.85, "Frete Gratis"),
    ("Navegador Indeciso", 0.20, "Prova Social"),
    ("Navegador Indeciso", 0.55, "Frete Gratis"),
    ("Navegador Indeciso", 0.85, "Frete Gratis + 5% OFF"),
    ("Cacador de Descontos", 0.20, "Moedas / Pontos"),
    ("Cacador de Descontos", 0.55, "Cupom 5% OFF ou Frete"),
    ("Cacador de Descontos", 0.85, "Frete Gratis + 10% a 15% OFF"),
])
def test_matrix(spark, profile, score, action):
    frame = spark.createDataFrame([(profile, score)], "profile string, conversion_score double")
    row = one(D.decide(frame, strict=True))
    assert row["action"] == action
    assert row["benefit"] and row["message"] and row["invalid_reason"] is None


@pytest.mark.parametrize("cluster, profile", [
    (0, "Navegador Indeciso"), (1, "Comprador de Alta Intencao"), (2, "Cacador de Descontos"),
])
def test_clusters(spark, cluster, profile):
    frame = spark.createDataFrame([(cluster, 0.55)], "cluster int, conversion_score double")
    assert one(D.decide_from_cluster(frame, strict=True))["profile"] == profile


def test_unknown_keys(spark):
    by_name = spark.createDataFrame(
        [("Perfil Inexistente", 0.5)], "profile string, conversion_score double")
    row = one(D.decide(by_name))
    assert row["action"] is None and row["invalid_reason"] == "unknown profile"
    with pytest.raises(PySparkException):
        D.decide(by_name, strict=True).collect()
    by_cluster = spark.createDataFrame([(99, 0.5)], "cluster int, conversion_score double")
    assert one(D.decide_from_cluster(by_cluster))["profile"] is None
    with pytest.raises(PySparkException):
        D.decide_from_cluster(by_cluster, strict=True).collect()


def test_score_is_rounded_half_even(spark):
    frame = spark.createDataFrame(
        [("Navegador Indeciso", 0.123456)], "profile string, conversion_score double")
    assert one(D.decide(frame))["conversion_score"] == 0.1235


@pytest.mark.parametrize("risk, value, code", [
    (0.39, 10.0, "NENHUM"), (0.39, 5000.0, "NENHUM"),
    (0.40, 300.0, "FRETE_GRATIS"), (0.40, 299.99, "DESC5"),
    (0.65, 500.0, "DESC10"), (0.65, 499.99, "DESC5_FRETE"),
    (0.85, 800.0, "RECUPE15"), (0.85, 799.99, "DESC10_FRETE"),
])
def test_coupon_edges(spark, risk, value, code):
    frame = spark.createDataFrame([(risk, value)], "p_abandonment double, total_cart_value double")
    row = one(D.recommend_coupon(frame))
    assert row["coupon_code"] == code
    assert row["coupon_label"] == {r[0]: r[1] for r in rules.COUPONS}[code]


def test_recovered_value(spark):
    frame = spark.createDataFrame(
        [(0.9, 1000.0), (0.1, 1000.0)], "p_abandonment double, total_cart_value double")
    values = {r["coupon_code"]: r["estimated_recovered_gmv"]
              for r in D.recommend_coupon(frame).collect()}
    assert values["RECUPE15"] == pytest.approx(297.5)
    assert values["NENHUM"] == 0.0


def test_propensity_bin_uses_other_middle_label(spark):
    frame = spark.createDataFrame([(0.25,), (0.5,), (0.75,), (0.76,), (1.5,)], "s double")
    got = [r[0] for r in frame.select(D.propensity_bin(F.col("s"))).collect()]
    assert got == ["Baixa Propensao", "Media Propensao", "Media Propensao", "Alta Propensao", None]


@pytest.mark.parametrize("profile, value, code", [
    ("high_intent", 300.0, "FRETE_GRATIS"), ("high_intent", 299.0, "LEMBRETE_SEM_DESCONTO"),
    ("bargain_hunter", 400.0, "DESC15_VIP"), ("bargain_hunter", 399.0, "DESC10_FRETE"),
    ("browser", 900.0, "DESC5_FRETE"), ("anything", 10.0, "DESC5_FRETE"),
])
def test_profile_prescription(spark, profile, value, code):
    frame = spark.createDataFrame([(profile, value)], "predicted_profile string, total_cart_value double")
    assert one(D.prescribe_by_profile(frame))["assigned_coupon"] == code


def test_offer_without_models(spark):
    frame = spark.createDataFrame(
        [(386070015, 197.52, 1, 4, 153, 5)],
        "user_id long, total_cart_value double, num_cart_items int, num_views_before_cart int, "
        "session_duration_sec int, hour_of_day int")
    row = one(D.prescribe_offer(frame))
    assert (row["view_to_cart_ratio"], row["is_night"]) == (4.0, 1)
    assert row["ml_predicted_profile"] == "bargain_hunter"
    assert row["ml_abandonment_risk_pct"] == 68.0
    assert row["assigned_coupon"] == "DESC10_FRETE"


def test_offer_defaults(spark):
    frame = spark.createDataFrame(
        [(None, None, None, None, None)],
        "total_cart_value double, num_cart_items int, num_views_before_cart int, "
        "session_duration_sec int, hour_of_day int")
    row = one(D.prescribe_offer(frame))
    assert (row["num_cart_items"], row["num_views_before_cart"], row["hour_of_day"]) == (1, 2, 14)
    assert row["total_cart_value"] == 200.0 and row["ml_predicted_profile"] == "high_intent"


def test_label_and_fallback_rules(spark):
    frame = spark.createDataFrame(
        [(3, 89, 0, 10.0), (3, 90, 0, 10.0), (6, 500, 0, 10.0), (4, 500, 1, 400.0),
         (4, 500, 1, 399.0)],
        "v int, d int, n int, c double")
    got = [tuple(r) for r in frame.select(
        D.profile_label_rule(F.col("v"), F.col("d"), F.col("n"), F.col("c")),
        D.profile_fallback(F.col("v"), F.col("n"))).collect()]
    assert got == [("high_intent", "high_intent"), ("browser", "high_intent"),
                   ("bargain_hunter", "bargain_hunter"), ("bargain_hunter", "bargain_hunter"),
                   ("browser", "bargain_hunter")]
