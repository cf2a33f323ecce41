"""The published texts, word for word, as the operators give them."""

from pyspark.sql import functions as F

from basketlake.operators import decisions

# Profile, score -> action, benefit, message
MATRIX = {
    ("Comprador de Alta Intencao", 0.2): (
        "Notificacao Simples", "Lembrete de carrinho sem desconto", "Seus produtos ainda estao te esperando!"),
    ("Comprador de Alta Intencao", 0.55): (
        "Notificacao de Escassez", "Urgencia sem concessao de desconto", "Restam poucas unidades dos produtos do seu carrinho."),
    ("Comprador de Alta Intencao", 0.85): (
        "Frete Gratis", "Isencao do valor de entrega", "Finalize sua compra com frete gratis."),
    ("Navegador Indeciso", 0.2): (
        "Prova Social", "Reforco de confianca sem desconto", "Esse produto esta entre os mais vendidos."),
    ("Navegador Indeciso", 0.55): (
        "Frete Gratis", "Reducao da barreira de compra", "Que tal finalizar agora com frete gratis?"),
    ("Navegador Indeciso", 0.85): (
        "Frete Gratis + 5% OFF", "Incentivo combinado para fechamento", "Finalize agora com frete gratis e 5% de desconto."),
    ("Cacador de Descontos", 0.2): (
        "Moedas / Pontos", "Beneficio de baixo custo promocional", "Ganhe moedas ao finalizar sua compra."),
    ("Cacador de Descontos", 0.55): (
        "Cupom 5% OFF ou Frete", "Desconto promocional leve", "Voce ganhou uma condicao especial para finalizar seu carrinho."),
    ("Cacador de Descontos", 0.85): (
        "Frete Gratis + 10% a 15% OFF", "Incentivo comercial de maior intensidade", "Oferta especial para voce finalizar sua compra agora."),
}

# Risk, cart value -> coupon, label, discount, free shipping, urgency
COUPONS = {
    (0.1, 900.0): ("NENHUM", "Sem Cupom Necessário", 0.0, False, "Baixa"),
    (0.5, 300.0): ("FRETE_GRATIS", "Frete Grátis Shopee", 0.0, True, "Média"),
    (0.5, 299.0): ("DESC5", "Cupom 5% OFF", 0.05, False, "Média"),
    (0.7, 500.0): ("DESC10", "Cupom 10% OFF Especial", 0.10, False, "Alta"),
    (0.7, 499.0): ("DESC5_FRETE", "Cupom 5% OFF + Frete Grátis", 0.05, True, "Alta"),
    (0.9, 800.0): ("RECUPE15", "Cupom 15% VIP Recuperação", 0.15, True, "Crítica"),
    (0.9, 799.0): ("DESC10_FRETE", "Cupom 10% OFF + Frete Grátis", 0.10, True, "Crítica"),
}

# Profile, cart value -> display name, coupon, label
PROFILES = {
    ("high_intent", 300.0): ("1. Comprador de Alta Intenção", "FRETE_GRATIS", "Frete Grátis Shopee"),
    ("high_intent", 100.0): ("1. Comprador de Alta Intenção", "LEMBRETE_SEM_DESCONTO", "Apenas Lembrete (Sem Cupom)"),
    ("bargain_hunter", 400.0): ("2. Caçador de Descontos", "DESC15_VIP", "Cupom 15% VIP Recuperação"),
    ("bargain_hunter", 100.0): ("2. Caçador de Descontos", "DESC10_FRETE", "Cupom 10% OFF + Frete Grátis"),
    ("browser", 100.0): ("3. Navegador Indeciso", "DESC5_FRETE", "Cupom 5% OFF + Frete Grátis"),
}


def test_actions(spark):
    rows = spark.createDataFrame(list(MATRIX), "profile string, conversion_score double")
    out = decisions.decide(rows).collect()
    assert {(r["profile"], r["conversion_score"]): (r["action"], r["benefit"], r["message"]) for r in out} == MATRIX


def test_coupons(spark):
    rows = spark.createDataFrame(list(COUPONS), "p_abandonment double, total_cart_value double")
    out = decisions.recommend_coupon(rows).collect()
    assert {(r["p_abandonment"], r["total_cart_value"]): (
        r["coupon_code"], r["coupon_label"], r["discount_pct"], r["free_shipping"], r["urgency_level"]) for r in out} == COUPONS


def test_profiles(spark):
    rows = spark.createDataFrame(list(PROFILES), "predicted_profile string, total_cart_value double")
    out = decisions.prescribe_by_profile(rows.withColumn("extra", F.lit(1))).collect()
    assert {(r["predicted_profile"], r["total_cart_value"]): (
        r["profile_name_pt"], r["assigned_coupon"], r["coupon_label"]) for r in out} == PROFILES
