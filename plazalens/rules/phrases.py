"""Phrase lists and lookup tables for labelling and display: fixed values."""

# Conclusions about disinformation in local and external explanations.
LOCAL_POSITIVE = [
    "se clasifica como desinformación", "es desinformación", "contiene desinformación", "clasificado como desinformación",
    "categorizado como desinformación", "es contenido de desinformación", "es una desinformación", "constituye desinformación",
]
LOCAL_NEGATIVE = [
    "no contiene desinformación", "no es desinformación", "no se clasifica como desinformación", "no constituye desinformación",
]
EXTERNAL_POSITIVE = [
    "desinformación", "información falsa", "noticia falsa", "completamente falsa", "totalmente falsa", "verificar con fuentes",
    "sin fundamento", "engaño", "manipulación", "contenido falso", "afirmación falsa", "bulo", "fake news",
    "información manipulada", "contenido manipulado", "falsificación", "documentos falsos", "pruebas falsas", "evidencia falsa",
    "afirmación no verificada", "sin verificación", "carece de fundamento", "no tiene base", "es falso", "son falsos",
]

# Verification trigger.
TRIGGER_CATEGORIES = [
    "disinformation", "conspiracy_theory", "anti_immigration", "anti_government", "political_general", "call_to_action",
]
TRIGGER_CONFIDENCE = 0.4
TRIGGER_KEYWORDS = [
    "estadística", "dato", "cifra", "millón", "porcentaje", "%", "según", "informe", "estudio", "investigación",
    "pandemia", "covid", "vacuna", "muerte", "contagio", "elecciones", "voto", "partido", "gobierno",
    "economía", "paro", "empleo", "pib", "déficit",
    "última hora", "urgente", "breaking", "bombazo", "exclusiva", "confirmado", "confirmada", "al descubierto",
    "ingresa", "ingreso", "prisión", "cárcel", "soto del real", "juez", "jueza", "fiscal", "tribunal", "juzgado", "corte",
    "arresta", "arrestado", "detiene", "detenido", "detención", "imputa", "imputado", "imputación",
    "procesa", "procesado", "procesamiento", "condena", "condenado", "sentencia",
    "ábalos", "sánchez", "iglesias", "montero", "grande-marlaska", "redondo", "calvo", "belarra", "yolanda díaz",
    "decreto", "ley", "real decreto", "dimite", "dimisión", "dimitido", "renuncia", "renunciado",
    "aprueba", "aprobado", "firma", "firmado", "promulga", "promulgado", "prohíbe", "prohibido", "obliga", "obligatorio",
    "manda", "orden", "cesa", "cesado", "destituye", "destituido", "nombramiento", "nombrado",
    "alianza", "pacto", "acuerdo", "coalición", "gobierno", "consejo de ministros",
    "ya está", "ya es oficial", "confirmado por", "según fuentes oficiales", "ha sido", "se ha confirmado",
    "queda demostrado", "está claro que", "oficialmente", "formalmente", "definitivamente", "inmediatamente",
]
TRIGGER_CLAIM_TYPES = ["numerical", "statistical", "temporal", "attribution"]
NO_TRIGGER = "No se cumplen criterios de activación"

# Model replies.
LEAD_IN = r"^(ok|okay|sure|bien|categoría|category)[\s\.,;:-]*"
NO_EXTERNAL = "Análisis externo no disponible."
EXTERNAL_DONE = "Análisis externo completado sin detalles adicionales."
TOXIC_LABELS = ["toxic", "hate", "negative", "1", "offensive", "bad"]
HATE_LABELS = ["hate", "odio", "discrimin"]
POSITIVE_LABELS = ["positive", "0", "good", "normal"]

# Keywords that point to a category, first hit wins.
KEYWORD_CATEGORY = [
    ("hate_speech", ["hate_speech", "odio", "racismo", "discriminación"]),
    ("anti_immigration", ["anti_immigration", "anti-inmigración", "xenofobia", "invasión"]),
    ("anti_lgbtq", ["anti_lgbtq", "homofobia", "transfobia", "ideología de género"]),
    ("anti_feminism", ["anti_feminism", "misoginia", "feminazi", "anti-feminista"]),
    ("disinformation", ["disinformation", "desinformación", "fake news", "mentira"]),
    ("conspiracy_theory", ["conspiracy", "conspiración", "teoría conspirativa"]),
    ("call_to_action", ["call_to_action", "llamado a la acción", "llamados a la acción"]),
    ("nationalism", ["nationalism", "nacionalismo", "patriotismo extremo"]),
    ("anti_government", ["anti_government", "anti-gobierno", "anti-establishment"]),
    ("historical_revisionism", ["historical_revisionism", "revisionismo histórico", "negacionismo"]),
    ("political_general", ["political_general", "política general", "debate político"]),
]

# Fixed values: (error class, words, recoverable, retry delay in seconds), first hit wins.
NETWORK_WORDS = ["connection", "timeout", "network", "dns", "ssl"]
ERROR_CLASSES = [
    ("authentication_error", ["unauthorized", "forbidden", "authentication", "api key", "credentials"], False, None),
    ("quota_error", ["quota", "rate limit", "exceeded", "limit"], True, 60),
    ("model_error", ["model not found", "model not available", "unsupported model"], True, 10),
    ("media_error", ["media", "file", "upload", "processing"], False, None),
    ("configuration_error", ["configuration", "config", "environment"], False, None),
]

# Topic tags of Spanish fact-check articles, and of the English source.
SPANISH_TAGS = [
    (["economía", "pib", "gdp", "crecimiento", "inflación", "paro", "desempleo", "salarios", "impuestos", "déficit", "deuda",
      "presupuesto", "banco", "mercado", "bolsa", "inversión", "exportaciones", "importaciones"],
     ["economía", "finanzas", "pib", "crecimiento"]),
    (["población", "habitantes", "personas", "millones", "demografía", "migración", "natalidad", "mortalidad",
      "esperanza de vida", "envejecimiento"], ["población", "demografía", "estadísticas"]),
    (["pandemia", "covid", "coronavirus", "vacuna", "salud", "enfermedad", "hospital", "médico", "farmacia", "contagio",
      "muerte", "casos", "pruebas", "uci"], ["salud", "pandemia", "covid", "medicina"]),
    (["política", "gobierno", "elecciones", "partido", "votación", "parlamento", "congreso", "senado", "presidente",
      "ministro", "alcalde", "diputado", "ley", "reforma", "constitución"], ["política"]),
    (["redes sociales", "twitter", "facebook", "instagram", "tiktok", "internet", "desinformación", "fake news", "mentira",
      "engaño", "manipulación"], ["redes sociales", "internet", "desinformación"]),
    (["educación", "escuela", "universidad", "estudiante", "profesor", "examen", "beca", "formación"], ["educación"]),
    (["medio ambiente", "clima", "cambio climático", "contaminación", "energía", "renovable", "emisiones", "calentamiento"],
     ["medio ambiente", "clima"]),
    (["delito", "crimen", "policía", "justicia", "prisión", "juez", "tribunal", "ley", "seguridad"], ["justicia", "seguridad"]),
    (["internacional", "ue", "unión europea", "eeuu", "estados unidos", "china", "rusia", "guerra", "conflicto", "paz",
      "diplomacia"], ["internacional"]),
    (["ciencia", "tecnología", "investigación", "innovación", "ia", "inteligencia artificial", "robot", "internet", "digital"],
     ["ciencia", "tecnología"]),
    (["deporte", "fútbol", "baloncesto", "tenis", "olimpiada", "cine", "música", "televisión", "entretenimiento"],
     ["deporte", "entretenimiento"]),
]
ENGLISH_TAGS = [
    (["pandemia", "covid", "coronavirus", "vaccine"], ["pandemia", "covid", "salud"]),
    (["economy", "gdp", "economic"], ["economía", "pib", "crecimiento"]),
    (["population", "million", "demographics"], ["población", "demografía", "estadísticas"]),
    (["politics", "government", "political"], ["política"]),
    (["social media", "facebook", "twitter"], ["redes sociales", "internet"]),
]
SOURCE_TAGS = {"maldita": SPANISH_TAGS, "newtral": SPANISH_TAGS, "snopes": ENGLISH_TAGS}

# Verdict names -> (verdict, confidence), first hit wins.
VERDICT_WORDS = [
    ("true", 0.9, ["verdadero", "cierto", "confirmado", "true"]),
    ("false", 0.9, ["falso", "mentira", "desmentido", "false"]),
    ("misleading", 0.7, ["engañoso", "manipulado", "misleading"]),
    ("misleading", 0.6, ["parcialmente", "mixta"]),
]
NO_VERDICT = ("unverified", 0.3)
SOURCE_VERDICTS = {
    "maldita": [
        ("true", 0.85, ["verdadero", "cierto", "confirmado", "correcto"]),
        ("false", 0.85, ["falso", "mentira", "desmentido", "incorrecto"]),
        ("misleading", 0.7, ["engañoso", "manipulado", "parcialmente", "mixta"]),
    ],
    "newtral": [
        ("true", 0.88, ["verdadero", "cierto", "confirmado", "correcto", "verdadera"]),
        ("false", 0.88, ["falso", "mentira", "desmentido", "incorrecto", "falsa"]),
        ("misleading", 0.75, ["engañoso", "manipulado", "parcialmente", "mixta"]),
    ],
    "snopes": [
        ("true", 0.85, ["true", "confirmed", "accurate", "correct"]),
        ("false", 0.85, ["false", "lie", "debuted", "incorrect"]),
        ("misleading", 0.7, ["misleading", "mixture", "partially", "mixed"]),
    ],
}
RATING_WORDS = [("true", 0.9, ["true"]), ("false", 0.9, ["false"]), ("misleading", 0.7, ["misleading", "mixture"])]
FACT_CHECK_NAMES = {"maldita": "Maldita.es", "newtral": "Newtral", "snopes": "Snopes"}
FACT_CHECK_SITES = {"maldita": "https://maldita.es", "newtral": "https://www.newtral.es", "snopes": "https://www.snopes.com"}

# Words that widen the relevance test: (query words, article words).
TOPIC_FAMILIES = [
    (["población", "habitantes", "personas", "millones"], ["población", "habitantes", "personas", "millones", "demografía", "censo"]),
    (["pib", "gdp", "crecimiento", "economía"], ["pib", "gdp", "crecimiento", "economía", "bruto", "producto"]),
    (["covid", "pandemia", "coronavirus"], ["covid", "pandemia", "coronavirus", "vacuna", "contagio"]),
]

# Media kinds.
VIDEO_MARKS = [".mp4", ".m3u8", ".mov", ".avi", ".webm", ".m4v", ".flv", ".wmv"]
IMAGE_MARKS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".svg"]
CAPTURED_VIDEO_MARKS = [".mp4", ".m3u8", ".webm", ".mov"]
VIDEO_HINTS = ["video", "vid/", "amplify_video"]

# Pipeline stages in order, display texts.
STAGES = ["pattern", "category_detection", "media_analysis", "explanation", "external"]
NO_ANALYSIS = "Sin análisis disponible"
REPOST_TYPES = ["repost_other", "repost_own", "repost_reply"]
WARNINGS = [("is_deleted", "deleted", "Este tweet fue eliminado"), ("is_edited", "edited", "Este tweet fue editado")]

# Marks of stored post pages.
BODY_MARK = "tweetText"
POST_MARK = "tweet"
PHOTO_MARK = "tweetPhoto"
PLAYER_MARK = "videoPlayer"
CONTEXT_MARK = "socialContext"
CARD_MARK = "card.wrapper"
VIEWS_MARK = "app-text-transition-container"
THREAD_CLASS = "r-1bimlpy"
STORED_IMAGE_MARKS = ["twimg.com/media/"]
MEDIA_HOSTS = ["twimg.com"]
CLIP_HOSTS = ["video.twimg.com"]
SKIPPED_IMAGE_MARKS = ["amplify_video_thumb", "/thumb/", "profile_images"]
PINNED_WORDS = ["pinned", "fijado"]
PINNED_LABELS = ["Pinned", "fijado"]
REPOST_WORDS = ["retweeted", "retuiteó"]
REPOST_ACTORS = [r"(?iU)(?:retweeted by|retuiteó)\s+@?(\w+)", r"(?iU)@?(\w+)\s+(?:retweeted|retuiteó)"]
