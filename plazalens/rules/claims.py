"""Claim rules: fixed values for extraction, scoring, parsing and query building."""

# Claim expressions per type, in extraction order, with the context
# window (characters on both sides). All are matched without regard to case.
CLAIM_RULES = {
    "numerical": (50, [
        r'\b\d+(?:\.\d+)?%\b',
        r'\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b',
        r'\b\d+(?:\.\d+)?\s+(?:millones?|billones?|mil|trillones?)\b',
        r'\b\d+(?:\.\d+)?\s*(?:euros?|dólares?|€|\$|£)\b',
    ]),
    "temporal": (50, [
        r'\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b',
        r'\b(19|20)\d{2}\b',
        r'\b(?:hace|en|desde|durante)\s+\d+\s+(?:días?|meses?|años?|horas?)\b',
    ]),
    "attribution": (100, [
        r'\b(?:según|como\s+dice|afirmó|declaró|dijo)\s+[^,.:;]{10,50}[,:]',
        r'\b(?:el\s+gobierno|la\s+OMS|la\s+ONU|expertos|científicos)\s+(?:afirman?|dicen?|indican?)\b',
    ]),
    "causal": (150, [
        r'\b(?:porque|debido\s+a|por\s+eso|ya\s+que|como\s+resultado)\b[^.]{20,100}\.',
    ]),
    "legal_event": (80, [
        r'\b(?:arrestado|detenido|detención\s+de)\s+[A-ZÁ-ÚÑ][a-zá-úñ]+\b',
        r'\b[A-ZÁ-ÚÑ][a-zá-úñ]+\s+(?:ingresa|entra|llega)\s+(?:en|a)\s+(?:prisión|cárcel|Soto\s+del\s+Real)\b',
        r'\b(?:ingresa|ingreso\s+de)\s+[A-ZÁ-ÚÑ][a-zá-úñ]+\s+(?:en|a)\s+(?:prisión|cárcel)\b',
        r'\b(?:juez|jueza|fiscal|tribunal)\s+(?:ordena|dicta|envía|procesa)\s+[A-ZÁ-ÚÑ][a-zá-úñ]+\b',
        r'\b[A-ZÁ-ÚÑ][a-zá-úñ]+\s+(?:procesado|imputado|condenado)\s+(?:por|en)\b',
        r'\b(?:procesamiento|imputación|sentencia)\s+(?:de|contra)\s+[A-ZÁ-ÚÑ][a-zá-úñ]+\b',
    ]),
    "breaking_news": (100, [
        r'\b(?:ÚLTIMA\s+HORA|URGENTE|BREAKING|BOMBAZO|EXCLUSIVA)\b[^.]*?(?:ingresa|arrestan|detienen|procesan|condenan)\b',
        r'\b(?:ÚLTIMA\s+HORA|URGENTE|BREAKING|BOMBAZO)\b[^.]*?(?:[A-ZÁ-ÚÑ][a-zá-úñ]+)\s+(?:ingresa|arrestado|detenido|procesado)\b',
        r'\b(?:se\s+confirma|ya\s+está|acabamos\s+de)\s+(?:que\s+)?(?:[A-ZÁ-ÚÑ][a-zá-úñ]+)\s+(?:ingresa|arrestado|detenido)\b',
    ]),
}
CLAIM_TYPES = ["numerical", "temporal", "attribution", "causal", "existential", "legal_event", "breaking_news"]

# Words that decide the type of a sentence with number and year.
NUMERIC_LEAD = ["creció", "aumento", "disminuyó", "bajó", "pib", "gdp", "tasa", "porcentaje", "rate"]
TEMPORAL_LEAD = ["empezó", "terminó", "ocurrió", "pasó", "inicio", "final", "started", "ended"]

# Scoring word lists.
BIG_NUMBERS = ["millones", "billones", "million", "billion"]
ECONOMY_NUMBERS = ["millones", "billones", "million", "billion", "pib", "gdp"]
STATISTICAL_CONTEXT = ["estadísticas", "datos", "cifras", "según", "informe", "estudio"]
IMPORTANT_TOPICS = ["pandemia", "covid", "coronavirus", "guerra", "elecciones", "crisis", "muerte", "accidente"]
OFFICIAL_CONTEXT = ["según", "datos oficiales", "ministerio", "gobierno", "oms", "onu"]
OFFICIAL_SOURCES = ["gobierno", "oms", "onu", "ministro", "presidente"]
CAUSAL_EVIDENCE = ["pruebas", "evidencias", "demuestra", "confirman"]
FIGURES = ["ábalos", "sánchez", "iglesias", "montero", "casado", "abascal", "rivera"]
SERIOUS_ACTIONS = ["prisión", "cárcel", "soto del real", "condenado", "procesado"]
LEGAL_SPECIFICS = ["por", "porqué", "motivos", "acusación"]
SOURCED = ["según", "fuente", "informa", "confirma", "el país", "abc", "eldiario"]

# Number parsing.
NUMBER_RULES = [r'\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b', r'\b\d+\.\d+\b', r'\b\d+\b']
BARE_YEAR = r'^(19|20)\d{2}$'
UNITS = [
    ("million", r'millon(?:es)?'),
    ("billion", r'billon(?:es)?'),
    ("percent", r'%|por ciento'),
    ("euro", r'euros?|€'),
    ("people", r'personas?|habitantes?'),
]
NUMBER_KINDS = [("population", ["población", "habitantes"]), ("economic", ["pib", "paro", "economía"])]

# Multiplier words, longest first. The short-scale meaning is kept;
# LONG_SCALE holds the Spanish one.
MULTIPLIERS = [
    ("trillones", 1e12), ("billones", 1e9), ("millones", 1e6), ("trillón", 1e12), ("billón", 1e9), ("millón", 1e6), ("mil", 1e3),
]
LONG_SCALE = {"trillones": 1e18, "trillón": 1e18, "billones": 1e12, "billón": 1e12}

# Date and time expressions.
DAY_FIRST = r'\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b'
YEAR_FIRST = r'\b(\d{4})-(\d{2})-(\d{2})\b'
ANY_YEAR = r'\b((?:19|20)\d{2})\b'
RELATIVE_TIME = r'\bhace\s+(\d+)\s+(días?|meses?|años?)\b|\ben\s+(?:el\s+)?(\d{4})\b'

# Search query building.
STOPWORDS = [
    "que", "de", "la", "el", "y", "a", "en", "un", "ser", "se", "no", "haber", "por", "con", "su", "para", "como", "más",
    "o", "pero", "sus", "le", "ya", "este", "esta", "son", "entre", "cuando", "todo", "nos", "los", "las", "del", "al", "lo",
    "ha", "es", "era", "eran", "fue", "fueron",
]
QUERY_TEMPLATES = {
    "numerical": ['"{value}" {context}', "{context} datos estadísticas", "{value} verificación comprobación"],
    "temporal": ['"{value}" {context}', "{context} fecha verificación", "{value} acontecimiento histórico"],
    "attribution": ["{context}", "afirmación verificación {context}", "dicho por fuente oficial"],
    "causal": ["{context}", "relación causa efecto {context}", "evidencia científica {context}"],
}
DEFAULT_TEMPLATES = ["{context}"]
PAIR_QUERY_SUFFIX = "verificación"
FALLBACK_SUFFIXES = ["desmentido", "comprobación", "evidencia"]

# Claim topics, first hit wins.
TOPICS = [
    ("salud", ["covid", "pandemia", "vacuna", "salud"]),
    ("política", ["elecciones", "voto", "partido", "política"]),
    ("economía", ["economía", "paro", "empleo", "pib"]),
]
OTHER_TOPIC = "general"

# Political events.
ARREST_WORDS = ["ingresa", "ingreso", "prisión", "cárcel", "arrestado", "detenido"]
UNKNOWN_PERSON = "desconocido"
CAPITALISED_NAME = r'([A-ZÁ-Ú][a-zá-úñ]+(?:\s+[A-ZÁ-Ú][a-zá-úñ]+)*)'
JUDICIAL_TYPES = [
    ("judicial_order", ["juez", "jueza"]), ("prosecution", ["procesado", "procesamiento"]), ("conviction", ["condenado", "condena"]),
]
EVENT_TYPES = [
    ("arrest", ["detenido", "arrestado"]), ("prosecution", ["procesado"]), ("conviction", ["condenado"]),
    ("resignation", ["dimitido", "dimisión"]),
]
CONTRADICTION_WORDS = [
    "falso", "false", "mentira", "desmentido", "desmiente", "no es cierto", "sin fundamento", "bulo", "fake news",
    "no hay registro", "no consta", "no se ha producido",
]
CONFIRMATION_WORDS = [
    "confirmado", "confirma", "ha sido", "se ha producido", "según fuentes", "oficialmente", "anuncia",
]
ARREST_TYPES = ["arrest", "prisión", "condena"]
