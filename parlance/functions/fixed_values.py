"""Patterns, word lists and thresholds that decide results.

Patterns are written for Unicode-aware matching; ``regex.unicode`` adds the Java flag.
"""

# Entity patterns
CPF = r"\b(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\b"
CPF_PUNCTUATED = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)(?:9\s?)?\d{4}[\s-]?\d{4}"
PLATE_NEW = r"\b([A-Z]{3}\d[A-Z0-9]\d{2})\b"
PLATE_OLD = r"\b([A-Z]{3}-?\d{4})\b"
CEP = r"\b(\d{5}-?\d{3})\b"
PRICE = r"R\$\s?(\d{1,3}(?:\.\d{3})+(?:,\d{2})?|\d+(?:,\d{2})?|\d+)"
MODEL_YEAR = r"\b(19[89]\d|20[012]\d)\b"

# Insurers, as (pattern on lower-case text, name), in report order
COMPETITORS = (
    (r"porto\s*seguro", "porto seguro"),
    (r"azul\s*seguros?", "azul"),
    (r"bradesco\s*seguros?", "bradesco"),
    (r"sulam[eé]rica", "sulamerica"),
    (r"liberty", "liberty"),
    (r"allianz", "allianz"),
    (r"hdi\s*seguros?", "hdi"),
    (r"mapfre", "mapfre"),
    (r"tokio\s*marine", "tokio marine"),
    (r"zurich", "zurich"),
)

# Car models per brand
MODEL_BRANDS = {
    "onix": "chevrolet",
    "prisma": "chevrolet",
    "cruze": "chevrolet",
    "tracker": "chevrolet",
    "spin": "chevrolet",
    "s10": "chevrolet",
    "celta": "chevrolet",
    "cobalt": "chevrolet",
    "montana": "chevrolet",
    "gol": "volkswagen",
    "polo": "volkswagen",
    "virtus": "volkswagen",
    "t-cross": "volkswagen",
    "nivus": "volkswagen",
    "saveiro": "volkswagen",
    "fox": "volkswagen",
    "voyage": "volkswagen",
    "up": "volkswagen",
    "civic": "honda",
    "hr-v": "honda",
    "city": "honda",
    "fit": "honda",
    "wr-v": "honda",
    "corolla": "toyota",
    "yaris": "toyota",
    "hilux": "toyota",
    "etios": "toyota",
    "sw4": "toyota",
    "rav4": "toyota",
    "hb20": "hyundai",
    "creta": "hyundai",
    "tucson": "hyundai",
    "kicks": "nissan",
    "versa": "nissan",
    "march": "nissan",
    "renegade": "jeep",
    "compass": "jeep",
    "commander": "jeep",
    "argo": "fiat",
    "cronos": "fiat",
    "mobi": "fiat",
    "uno": "fiat",
    "palio": "fiat",
    "toro": "fiat",
    "strada": "fiat",
    "pulse": "fiat",
    "fiesta": "ford",
    "ka": "ford",
    "ecosport": "ford",
    "ranger": "ford",
    "kwid": "renault",
    "sandero": "renault",
    "duster": "renault",
}

# Redaction rules, as (label, pattern), applied in this order
REDACTION_RULES = (
    ("CNPJ", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b"),
    ("CPF", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b"),
    ("PHONE_BR", r"(?:\+?55[\s-]?)?(?:\(?\d{2}\)?[\s-]?)9?\d{4}[\s-]?\d{4}\b"),
    ("EMAIL", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("BEARER_TOKEN", r"(?i)\bBearer\s+[A-Za-z0-9\-_\.=]+"),
    ("AWS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    ("GITHUB_PAT", r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("ANTHROPIC_KEY", r"\bsk-ant-[A-Za-z0-9\-_]{20,}\b"),
)
# Text without which a rule cannot match
REDACTION_NEEDLES = {
    "CNPJ": "/", "EMAIL": "@", "AWS_KEY": "AKIA", "GITHUB_PAT": "ghp_", "ANTHROPIC_KEY": "sk-ant-",
}

# Secrets cut out of free text
SECRET_PATTERNS = (r"sk-[A-Za-z0-9_-]+", r"ghp_[A-Za-z0-9_]+", r"AKIA[0-9A-Z]{12,}")

# Sentiment keywords
POSITIVE_WORDS = (
    "otimo", "perfeito", "excelente", "maravilha", "fechado", "aceito", "pode fazer",
    "vamos fechar", "gostei", "muito bom", "top", "obrigado", "obrigada", "show", "massa",
    "sensacional", "tranquilo", "beleza", "ok vamos", "sim aceito", "quero sim", "confianca",
    "seguranca", "tranquilidade", "protecao",
)
NEGATIVE_WORDS = (
    "caro", "muito caro", "absurdo", "nao quero", "desisto", "nao tenho interesse",
    "vou pensar", "ta ruim", "pessimo", "nao gostei", "cancelar", "reclamar", "demora",
    "demorado", "nao vale", "melhor nao", "sem condicao", "fora do orcamento", "concorrente",
    "mais barato", "preco alto", "nao compensa",
)

# Question topics
PRICE_TOPIC = r"(?i)(preco|valor|custa|parcela|desconto|barato|caro)"
COVERAGE_TOPIC = r"(?i)(cobertura|cobre|inclui|protege|assistencia|guincho)"

# Intent keywords, in tie-break order
INTENT_WORDS = {
    "status_check": ("status", "como esta", "rodou", "execucao", "run", "ultimo", "proximo"),
    "error_diagnosis": ("erro", "falhou", "falha", "problema", "bug", "quebrou", "por que"),
    "change_request": ("adicionar", "criar", "nova tabela", "modificar", "mudar", "alterar"),
    "report_request": (
        "relatorio", "metricas", "conversao", "dashboard", "quantos", "quantas",
    ),
    "fix_request": (
        "corrigir", "fix", "arrumar", "ajustar", "regex", "conserta", "correcao", "correção",
        "pr", "pull request", "observer", "automatica", "automatico", "agente", "codigo",
        "código",
    ),
}

# Prices per million tokens, as (provider, model prefix, input, output), in match order
TOKEN_PRICES = (
    ("anthropic", "claude-opus", 15.0, 75.0),
    ("anthropic", "claude-sonnet", 3.0, 15.0),
    ("anthropic", "claude-haiku", 0.80, 4.0),
    ("openai", "gpt-4o", 2.50, 10.0),
    ("openai", "gpt-4-turbo", 10.0, 30.0),
    ("openai", "gpt-4", 30.0, 60.0),
    ("openai", "gpt-3.5-turbo", 0.50, 1.50),
)

# Conversation outcomes
SOLD = "venda_fechada"
GHOSTED = "ghosting"
LOST = ("perdido_preco", "perdido_concorrente")
OPEN_DEAL = ("em_negociacao", "proposta_enviada")
GAVE_UP = "desistencia_lead"

# Lead score, fixed values: column -> (added, factor, most points)
SCORE_LINEAR = {"inbound_count": (0, 3, 30), "sentiment_score": (1, 10, 20)}
# Points for what the lead has given, and for a message in office hours
SCORE_FLAGS = {"has_cpf": 8, "has_email": 6, "has_plate": 6}
# Points for values below or above a limit, the first that holds
SCORE_BELOW = {"avg_response_time_sec": ((60, 15), (180, 10), (600, 5))}
SCORE_ABOVE = {"business_hours_messages": ((0, 5),), "total_messages": ((15, 10), (8, 5))}
SCORE_TIERS = ((70, "hot"), (40, "warm"))
LOWEST_TIER = "cold"
