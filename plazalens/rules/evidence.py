"""Evidence tables: fixed values for reputation, quality, priorities and verdicts."""

# Base reputation by name, domain or top-level domain.
BASE_SCORES = {
    "maldita.es": 0.95, "maldita": 0.95, "newtral.es": 0.95, "newtral": 0.95, "snopes.com": 0.90, "snopes": 0.90,
    "politifact.com": 0.90, "politifact": 0.90, "factcheck.org": 0.90, "factcheck": 0.90,
    "ine.es": 0.98, "ine": 0.98, "eurostat.europa.eu": 0.95, "eurostat": 0.95,
    "oficina estadística de la unión europea": 0.95, "eurostat - oficina estadística de la unión europea": 0.95,
    "who.int": 0.93, "who": 0.93, "world health organization": 0.93, "worldbank.org": 0.92, "worldbank": 0.92,
    "world bank": 0.92, "banco mundial": 0.92, "oecd.org": 0.90, "oecd": 0.90,
    "boe.es": 0.85, "boe": 0.85, "mscbs.gob.es": 0.88, "mscbs": 0.88, "exteriores.gob.es": 0.82, "exteriores": 0.82,
    "gobierno.es": 0.80, "gobierno": 0.80,
    "elpais.com": 0.75, "elpais": 0.75, "elmundo.es": 0.70, "elmundo": 0.70, "abc.es": 0.68, "abc": 0.68,
    "lavanguardia.com": 0.65, "lavanguardia": 0.65,
    "scholar.google.com": 0.80, "scholar": 0.80, "dialnet.unirioja.es": 0.75, "dialnet": 0.75, "sciencedirect.com": 0.85,
    "nature.com": 0.88, "wikipedia.org": 0.95, "wikipedia": 0.95, "wikipedia (es)": 0.95,
    "bbc.com": 0.75, "bbc": 0.75, "reuters.com": 0.80, "reuters": 0.80, "apnews.com": 0.78, "apnews": 0.78,
    "gov": 0.75, "edu": 0.70, "org": 0.65, "com": 0.50, "unknown": 0.40,
}
UNKNOWN_SCORE = 0.40

# Content quality words.
QUALITY_HIGH = [
    "estudio científico", "investigación", "datos oficiales", "informe oficial", "evidencia empírica", "análisis estadístico",
    "fuentes primarias",
]
QUALITY_MEDIUM = ["análisis", "investigación", "datos", "informe", "estudio", "verificación", "comprobación"]
QUALITY_LOW = ["opinión", "creo que", "parece", "probablemente", "quizás"]

# Claims on which news and web hits weigh less.
STATISTICAL_WORDS = [
    "pib", "gdp", "economía", "crecimiento", "paro", "empleo", "inflación", "déficit", "estadística", "datos oficiales",
    "tasa de", "porcentaje", "millones", "billones",
]
NEWS_DOMAINS = ["elpais.com", "elmundo.es", "abc.es", "lavanguardia.com", "bbc.com", "reuters.com", "apnews.com"]

# Reliability levels, highest first.
LEVELS = [
    (0.9, "Muy confiable"), (0.8, "Confiable"), (0.7, "Moderadamente confiable"), (0.6, "Baja confiabilidad"),
]
LOWEST_LEVEL = "No confiable"

# Source priorities, in lookup order.
PRIORITIES = [
    ("ine", 10), ("eurostat", 9), ("who", 9), ("worldbank", 8), ("oecd", 8), ("maldita", 9), ("newtral", 9), ("snopes", 8),
    ("politifact", 8), ("factcheck", 8), ("boe", 7), ("mscbs", 8), ("exteriores", 7), ("elpais", 6), ("elmundo", 6),
    ("abc", 5), ("lavanguardia", 5), ("scholar", 7), ("dialnet", 6), ("unknown", 3),
]
UNKNOWN_PRIORITY = 3
NEWS_CAP = 5
CAPPED_TOPICS = ["economy", "statistics"]

# Tie orders of the verdicts and their Spanish names.
CLAIM_VERDICTS = ["verified", "debunked", "questionable", "unverified"]
EVIDENCE_VERDICTS = ["verified", "questionable", "debunked", "unverified"]
VERDICT_VERBS = {"verified": "verificada", "debunked": "desmentida", "questionable": "cuestionable"}
VERDICT_NAMES = {
    "verified": "VERIFICADO", "debunked": "DESMENTIDO", "questionable": "CUESTIONABLE", "unverified": "SIN VERIFICAR",
}
FACT_VERDICT_NAMES = {
    "VERDADERO": ["true", "verdadero", "cierto"], "FALSO": ["false", "falso", "mentira"],
    "ENGAÑOSO": ["misleading", "engañoso", "manipulado"],
}
FACT_VERDICTS = {
    "verified": ["true", "verdadero", "cierto"], "debunked": ["false", "falso", "mentira"], "questionable": ["misleading", "engañoso"],
}

# News sites and their scores.
ARTICLE_SCORES = {"El País": 85, "El Mundo": 75, "ABC": 80, "La Vanguardia": 78, "Google News": 70, "Bing News": 65}
OTHER_ARTICLE_SCORE = 60

# Statistics routes. Each indicator: words that route to it, tolerance.
POPULATION_WORDS = ["población", "habitantes", "personas", "millones"]
GDP_WORDS = ["pib", "gdp", "producto interior bruto"]
GROWTH_WORDS = ["creció", "crecimiento", "aumento", "growth", "increased", "%"]
PER_HEAD_WORDS = ["per cápita", "capita"]
LIFE_WORDS = ["esperanza de vida", "life expectancy", "mortalidad"]
TOLERANCE = {"population": 0.05, "gdp": 0.10, "gdp_growth": 0.05, "life_expectancy": 0.03, "gdp_per_capita": 0.15}
MIN_GROWTH_TOLERANCE = 0.5
STATISTICS_NAMES = {
    "INE": "INE - Instituto Nacional de Estadística", "Eurostat": "Eurostat - Oficina Estadística de la Unión Europea",
    "WHO": "World Health Organization (WHO)", "World Bank": "World Bank Open Data",
}

# Event evidence by source kind: (outcome, verdict, confidence).
EVENT_OUTCOMES = {
    "fact_checker": {"contradicts": ("debunked", 0.8), "confirms": ("verified", 0.7), "silent_arrest": ("questionable", 0.4), "silent": ("questionable", 0.4)},
    "news": {"contradicts": ("debunked", 0.8), "confirms": ("verified", 0.7), "silent_arrest": ("debunked", 0.6), "silent": ("questionable", 0.4)},
    "official": {"contradicts": ("debunked", 0.9), "confirms": ("verified", 0.95), "silent_arrest": ("debunked", 0.7), "silent": ("questionable", 0.3)},
}
