"""Fixed values of the commercial rules. The texts are results users compare, so they are verbatim."""

# --- Fixed values: score bands -------------------------------------------------
BAND_LOW = "Baixa Propensao"
BAND_MODERATE = "Moderada Propensao"
BAND_MEDIUM = "Media Propensao"
BAND_HIGH = "Alta Propensao"

# --- Fixed values: behavioural profiles ------------------------------------------
HIGH_INTENT = "Comprador de Alta Intencao"
UNDECIDED = "Navegador Indeciso"
DISCOUNT_HUNTER = "Cacador de Descontos"

# Cluster number -> profile of the published fit
CLUSTER_PROFILES = [
    (0, UNDECIDED),
    (1, HIGH_INTENT),
    (2, DISCOUNT_HUNTER),
]

# Profile, band -> action, benefit, message
ACTIONS = [
    (HIGH_INTENT, BAND_LOW, "Notificacao Simples",
     "Lembrete de carrinho sem desconto",
     "Seus produtos ainda estao te esperando!"),
    (HIGH_INTENT, BAND_MODERATE, "Notificacao de Escassez",
     "Urgencia sem concessao de desconto",
     "Restam poucas unidades dos produtos do seu carrinho."),
    (HIGH_INTENT, BAND_HIGH, "Frete Gratis",
     "Isencao do valor de entrega",
     "Finalize sua compra com frete gratis."),
    (UNDECIDED, BAND_LOW, "Prova Social",
     "Reforco de confianca sem desconto",
     "Esse produto esta entre os mais vendidos."),
    (UNDECIDED, BAND_MODERATE, "Frete Gratis",
     "Reducao da barreira de compra",
     "Que tal finalizar agora com frete gratis?"),
    (UNDECIDED, BAND_HIGH, "Frete Gratis + 5% OFF",
     "Incentivo combinado para fechamento",
     "Finalize agora com frete gratis e 5% de desconto."),
    (DISCOUNT_HUNTER, BAND_LOW, "Moedas / Pontos",
     "Beneficio de baixo custo promocional",
     "Ganhe moedas ao finalizar sua compra."),
    (DISCOUNT_HUNTER, BAND_MODERATE, "Cupom 5% OFF ou Frete",
     "Desconto promocional leve",
     "Voce ganhou uma condicao especial para finalizar seu carrinho."),
    (DISCOUNT_HUNTER, BAND_HIGH, "Frete Gratis + 10% a 15% OFF",
     "Incentivo comercial de maior intensidade",
     "Oferta especial para voce finalizar sua compra agora."),
]

# Coupon -> label, discount, free shipping, urgency, rationale
COUPONS = [
    ("NENHUM", "Sem Cupom Necessário", 0.0, False, "Baixa",
     "Cliente apresenta alta intenção de compra orgânica. Oferta de cupom iria erodir margem "
     "desnecessariamente."),
    ("FRETE_GRATIS", "Frete Grátis Shopee", 0.0, True, "Média",
     "Risco moderado em carrinho de médio/alto valor. O benefício do frete grátis elimina a "
     "principal barreira de checkout."),
    ("DESC5", "Cupom 5% OFF", 0.05, False, "Média",
     "Risco moderado em carrinho de ticket menor. Desconto leve de 5% incentiva a finalização "
     "imediata."),
    ("DESC10", "Cupom 10% OFF Especial", 0.10, False, "Alta",
     "Alto risco de perda de carrinho de valor expressivo. Cupom de 10% OFF atua como forte "
     "gatilho de conversão."),
    ("DESC5_FRETE", "Cupom 5% OFF + Frete Grátis", 0.05, True, "Alta",
     "Alto risco em ticket intermediário. Combo de 5% + Frete Grátis oferece percepção de alto "
     "valor para o cliente."),
    ("RECUPE15", "Cupom 15% VIP Recuperação", 0.15, True, "Crítica",
     "Abandono iminente em carrinho de altíssimo valor (GMV). Recuperação agressiva com 15% OFF "
     "+ Frete Grátis preserva receita substancial."),
    ("DESC10_FRETE", "Cupom 10% OFF + Frete Grátis", 0.10, True, "Crítica",
     "Carrinho prestes a ser abandonado. Incentivo máximo de 10% OFF + Frete Grátis para salvar "
     "a transação."),
]

# Risk below limit -> (cart value from which the first coupon applies, first, second)
COUPON_TIERS = [
    (0.40, None, "NENHUM", "NENHUM"),
    (0.65, 300.0, "FRETE_GRATIS", "DESC5"),
    (0.85, 500.0, "DESC10", "DESC5_FRETE"),
    (None, 800.0, "RECUPE15", "DESC10_FRETE"),
]

# Fixed value: expected conversion lift of a coupon sent in time
CONVERSION_LIFT = 0.35

# Behavioural profile -> display name, rationale
PROFILE_TEXTS = [
    ("high_intent", "1. Comprador de Alta Intenção",
     "Cliente com alta intenção orgânica. Evita dar desconto agressivo para proteger margem "
     "financeira."),
    ("bargain_hunter", "2. Caçador de Descontos",
     "Cliente altamente sensível a preço/ofertas. Cupom de alto valor destrava a tomada de "
     "decisão."),
    ("browser", "3. Navegador Indeciso",
     "Cliente navega por indecisão. Combo leve de 5% + Frete Grátis elimina a barreira do "
     "checkout."),
]

# Profile, whether the cart reaches its limit -> coupon, label
PROFILE_LIMITS = [("high_intent", 300.0), ("bargain_hunter", 400.0)]
PROFILE_COUPONS = [
    ("high_intent", True, "FRETE_GRATIS", "Frete Grátis Shopee"),
    ("high_intent", False, "LEMBRETE_SEM_DESCONTO", "Apenas Lembrete (Sem Cupom)"),
    ("bargain_hunter", True, "DESC15_VIP", "Cupom 15% VIP Recuperação"),
    ("bargain_hunter", False, "DESC10_FRETE", "Cupom 10% OFF + Frete Grátis"),
    ("browser", True, "DESC5_FRETE", "Cupom 5% OFF + Frete Grátis"),
    ("browser", False, "DESC5_FRETE", "Cupom 5% OFF + Frete Grátis"),
]

# Fixed value: abandonment risk assumed while no model is trained
DEFAULT_RISK = 0.68

# The two follow-ups after a first cart
REMINDER = {
    "trigger": "CART_PLUS_5_MINUTES",
    "time_window": "5 minutos após cart",
    "action_type": "PUSH_REMINDER",
    "message_title": "🛒 Seu carrinho está te esperando na Shopee!",
    "message_body": "Olá! Notei que você deixou produtos incríveis no carrinho. "
                    "Realize sua compra! Olha o seu produto aqui te esperando!",
    "status": "DISPARADO",
}
OFFER = {
    "trigger": "CART_PLUS_1_HOUR",
    "time_window": "1 hora após cart",
    "status": "DISPARADO_COM_ML",
}

# Session figures assumed when a field is missing
OFFER_DEFAULTS = {
    "num_cart_items": 1,
    "num_views_before_cart": 2,
    "session_duration_sec": 120,
    "hour_of_day": 14,
    "total_cart_value": 200.0,
}
