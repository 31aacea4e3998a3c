"""Queries for labelling, enrichment, display columns and bulk parsing."""

import re

from pyspark.sql import functions as F

from plazalens.catalog.claims import around, located
from plazalens.catalog.registry import query
from plazalens.functions import posts as C

from plazalens.operators import labels as O
from plazalens.operators import reports
from plazalens.plans.sample_scorers import by_length, refusing
from plazalens.rules import categories as R
from plazalens.rules import phrases as P
from plazalens.session import spread

# RE2 has no Unicode \\b and no lookahead: boundaries are spelled out, and a rule with a
# negative lookahead hits when it matches more often than together with what must not follow.
WC = "0-9A-Za-zÀ-ÿ_"
EDGE, INNER = f"[^{WC}]", f"[^{WC}\\n]"


def re2(rule):
    """One rule in RE2 notation."""
    out = rule.lower()
    if " bds " in out:
        return f"(?:^|{EDGE})(?:boicot\\s+a\\s+israel(?:$|{EDGE})|movimiento\\s+bds [{WC}])|[{WC}] bds [{WC}]"
    out = out.replace(r"\w", f"[{WC}]")
    out = out.replace(r"\b.*\b", f"(?:{INNER}|{INNER}.*{INNER})").replace(r"\s+.*\b", rf"\s+(?:.*{INNER})?")
    out = out.replace(r".*\b", f".*{INNER}")
    out = re.sub(r"^\\b", lambda m: f"(?:^|{EDGE})", out)
    out = out.replace(r"\b)", f"(?:$|{EDGE}))")
    return out.replace(r"\b", f"(?:$|{EDGE})")


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def hit_sql(rules, col="low"):
    plain, tests = [], []
    for rule in rules:
        at = rule.find(r"\b(?!")
        if at < 0:
            plain.append(re2(rule))
        else:
            head, tail = rule[:at], rule[at + 5:-1].lower().replace(r"\w", f"[{WC}]")
            whole = re2(head)
            edge = f"(?:$|{EDGE})"
            tests.append(
                f"len(regexp_extract_all({col}, {lit(whole + edge)})) > len(regexp_extract_all({col}, {lit(whole + tail)}))"
            )
    return "(" + " OR ".join([f"regexp_matches({col}, {lit('|'.join(plain))})"] + tests) + ")"


LABELS = (
    "lab AS (SELECT post_id, content, list_filter(["
    + ", ".join(f"CASE WHEN length(trim(content, chr(32) || chr(10) || chr(9) || chr(13))) >= 5 AND {hit_sql(rules)} THEN '{c}' END" for c, rules in R.LABEL_RULES.items())
    + "], lambda x: x IS NOT NULL) AS cats FROM (SELECT post_id, content, lower(content) AS low FROM posts) p)"
)


@query("F1_label", f"WITH {LABELS} SELECT post_id, array_to_string(cats, ',') AS categories FROM lab")
def label(v):
    return O.with_categories(v.texts).select("post_id", F.array_join("categories", ",").alias("categories"))


def count_sql(rule):
    """Matches of one rule in the lower-cased text, with ASCII boundaries."""
    at = rule.find(r"\b(?!")
    text = rule.lower()
    if at < 0:
        return f"len(regexp_extract_all(low, {lit(text)}))"
    head, tail = text[:at], text[at + 5:-1]
    return f"len(regexp_extract_all(low, {lit(head + chr(92) + 'b')})) - len(regexp_extract_all(low, {lit(head + chr(92) + 'b' + tail)}))"


RULE_COUNTS = " UNION ALL ".join(
    f"SELECT post_id, '{c}' AS category, {i} AS rule_no, CAST({count_sql(r)} AS BIGINT) AS n FROM lowered"
    for c, rules in R.LABEL_RULES.items()
    for i, r in enumerate(rules)
)


@query("F2_label_match_counts", f"WITH lowered AS (SELECT post_id, lower(content) AS low FROM posts) SELECT * FROM ({RULE_COUNTS}) r WHERE n > 0")
def label_match_counts(v):
    return O.label_matches(v.texts).groupBy("post_id", "category", "rule_no").agg(F.count("*").alias("n"))


def place_sql(category, i, rule):
    """Matches of one rule with their places in the lower-cased text; what must not follow is tested behind the match."""
    at, text = rule.find(r"\b(?!"), rule.lower()
    head, barred = (text, None) if at < 0 else (text[:at] + r"\b", text[at + 5 : -1])
    test = "" if barred is None else f" WHERE NOT regexp_matches(substring(low, x.at + length(x.t) + 1), {lit('^(?:' + barred + ')')})"
    return f"SELECT * FROM (SELECT post_id, content, low, '{category}' AS category, {i} AS rule_no, {located(lit(head), 'low').replace('FROM posts', 'FROM lowered')}) y{test}"


RULE_PLACES = " UNION ALL ".join(place_sql(c, i, r) for c, rules in R.LABEL_RULES.items() for i, r in enumerate(rules))
DESCRIBED = " ".join(f"WHEN '{c}' THEN {lit(d)}" for c, d in R.CATEGORY_DESCRIPTIONS.items())


@query(
    "F2_label_matches",
    f"""WITH lowered AS (SELECT post_id, content, lower(content) AS low FROM posts)
       SELECT post_id, category, rule_no, x.t AS matched, CASE category {DESCRIBED} ELSE '' END AS description, x.at AS start_pos, CAST(x.at + length(x.t) AS INTEGER) AS end_pos,
        {around('content', 'x.at', '(x.at + length(x.t))', '20')} AS context FROM ({RULE_PLACES}) r""",
)
def label_matches(v):
    return O.label_matches(v.texts)


@query("F3_primary_category", f"WITH {LABELS} SELECT post_id, coalesce(cats[1], 'non_political') AS primary_category FROM lab")
def primary(v):
    return O.with_categories(v.texts).select("post_id", O.primary_category(F.col("categories")).alias("primary_category"))


@query(
    "C2_label_distribution",
    f"WITH {LABELS} SELECT coalesce(cats[1], 'non_political') AS category, count(*) AS n, "
    "round(count(*) * 100.0 / (SELECT count(*) FROM lab), 6) AS percentage FROM lab GROUP BY 1",
)
def label_distribution(v):
    labelled = O.with_categories(v.texts).select(O.primary_category(F.col("categories")).alias("category"))
    return reports.category_distribution(labelled).select("category", "n", F.round("percentage", 6).alias("percentage"))


KEYWORDS = "kw AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, {lit(k)} AS keyword" for c, ks in R.CATEGORY_KEYWORDS.items() for k in ks) + ")"


@query(
    "F4_category_keywords",
    f"WITH {LABELS}, {KEYWORDS} SELECT l.post_id, coalesce(string_agg(DISTINCT k.keyword, ',' ORDER BY k.keyword), '') AS keywords "
    "FROM lab l LEFT JOIN kw k ON list_contains(l.cats, k.category) GROUP BY l.post_id",
)
def keywords(v):
    return O.with_categories(v.texts).select(
        "post_id", F.array_join(O.category_keywords(F.col("categories")), ",").alias("keywords")
    )


ENTITIES = ", ".join(
    f"CASE WHEN regexp_matches(lower(content), '(?:^|{EDGE}){re.escape(n)}(?:$|{EDGE})') THEN '{k}:{n}' END" for k, n in R.ENTITIES
)


@query(
    "F5_entity_tags",
    f"SELECT post_id, array_to_string(list_filter([{ENTITIES}], lambda x: x IS NOT NULL), ',') AS entities FROM posts",
)
def entities(v):
    return v.texts.select("post_id", F.array_join(O.entity_tags(F.col("content")), ",").alias("entities"))


@query("F6_normalize", "SELECT post_id, nfc_normalize(lower(content)) AS normalized FROM posts")
def normalize(v):
    return v.texts.select("post_id", O.normalize("content").alias("normalized"))


def any_sql(col, words):
    return "(" + " OR ".join(f"contains(lower({col}), {lit(w)})" for w in words) + ")"


@query(
    "F7_concludes_disinfo",
    f"SELECT post_id, coalesce(NOT {any_sql('local_explanation', P.LOCAL_NEGATIVE)} AND {any_sql('local_explanation', P.LOCAL_POSITIVE)}, FALSE) AS concludes FROM content_analyses",
)
def concludes(v):
    return v.content_analyses.select("post_id", O.concludes_disinfo(F.col("local_explanation")).alias("concludes"))


@query(
    "F8_external_disinfo",
    f"SELECT post_id, coalesce({any_sql('external_explanation', P.EXTERNAL_POSITIVE)}, FALSE) AS flagged FROM content_analyses",
)
def external(v):
    return v.content_analyses.select("post_id", O.external_disinfo(F.col("external_explanation")).alias("flagged"))


TRIGGER_LIST = ", ".join(f"CASE WHEN contains(lower(content), {lit(k)}) THEN {lit(k)} END" for k in P.TRIGGER_KEYWORDS)


@query(
    "F9_needs_verification",
    f"""WITH j AS (SELECT p.post_id, p.content, a.category, a.verification_confidence - 0.3 AS confidence FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id),
       k AS (SELECT *, list_filter([{TRIGGER_LIST}], lambda x: x IS NOT NULL) AS kws FROM j),
       n AS (SELECT post_id, count(*) AS c FROM evidence WHERE claim_type IN ('numerical', 'temporal') GROUP BY post_id),
       r AS (SELECT k.post_id, CASE WHEN category IN ('disinformation', 'conspiracy_theory', 'anti_immigration', 'anti_government', 'political_general', 'call_to_action') THEN 'Categoría de contenido: ' || category
         WHEN coalesce(confidence, 0) >= 0.4 THEN 'Confianza del analizador: ' || printf('%.2f', confidence)
         WHEN len(kws) > 0 THEN 'Palabras clave encontradas: ' || array_to_string(kws[1:3], ', ')
         WHEN n.c >= 1 THEN 'Afirmaciones verificables encontradas: ' || n.c END AS reason FROM k LEFT JOIN n ON n.post_id = k.post_id)
       SELECT post_id, reason IS NOT NULL AS triggered, coalesce(reason, 'No se cumplen criterios de activación') AS reason FROM r""",
)
def needs(v):
    posts = v.posts.select("post_id", "content").join(
        v.content_analyses.select("post_id", "category", (F.col("verification_confidence") - 0.3).alias("confidence")), "post_id", "left"
    )
    return O.needs_verification(posts, v.evidence.select("post_id", "claim_type")).select("post_id", "triggered", "reason")


REPLIES = """rep AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Okay, hate_speech.' WHEN 1 THEN 'Category: disinformation' WHEN 2 THEN 'sure - general'
   WHEN 3 THEN 'nationalism' WHEN 4 THEN 'I think anti_lgbtq or nationalism' WHEN 5 THEN 'no idea' WHEN 6 THEN 'BIEN: Call_To_Action' WHEN 7 THEN '  ok' ELSE event_type END AS reply FROM events)"""


def replies(v):
    return v.raw("events").selectExpr(
        "event_id",
        "CASE event_id % 9 WHEN 0 THEN 'Okay, hate_speech.' WHEN 1 THEN 'Category: disinformation' WHEN 2 THEN 'sure - general' "
        "WHEN 3 THEN 'nationalism' WHEN 4 THEN 'I think anti_lgbtq or nationalism' WHEN 5 THEN 'no idea' WHEN 6 THEN 'BIEN: Call_To_Action' "
        "WHEN 7 THEN '  ok' ELSE event_type END AS reply",
    )


CATS = ", ".join(f"'{c}'" for c in R.CATEGORIES)


@query(
    "F10_clean_label",
    f"""WITH {REPLIES}, b AS (SELECT event_id, reply, trim(regexp_replace(lower(trim(reply)), '^(ok|okay|sure|bien|categoría|category)[\\s.,;:-]*', '')) AS bare FROM rep),
       c AS (SELECT *, CASE WHEN bare IN ({CATS}) THEN bare ELSE list_filter([{CATS}], lambda x: contains(bare, x))[1] END AS category FROM b)
       SELECT event_id, category, CASE WHEN category IS NULL THEN 'LLM returned invalid category: ' || trim(reply) END AS error FROM c""",
)
def clean(v):
    return replies(v).withColumn("l", O.clean_label(F.col("reply"))).select("event_id", "l.category", "l.error")


STRUCTURED = """sr AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('CATEGORÍA: Hate_Speech', chr(10), 'EXPLICACIÓN: El texto: ataca a ', event_type)
   WHEN 1 THEN concat('Category: general', chr(10), 'Texto libre sobre ', event_type, chr(10), 'segunda línea') WHEN 2 THEN '' WHEN 3 THEN 'EXPLICACIÓN: breve'
   WHEN 4 THEN concat('explicación:  suficiente texto ', event_type, chr(10), 'CATEGORÍA: tarde') ELSE event_type END AS reply FROM events)"""


@query(
    "F11_parse_reply",
    f"""WITH {STRUCTURED}, x AS (SELECT event_id, reply, regexp_extract(reply, '(?i)^(?:.*\\n)*?(explicación:)', 1) AS has_ex FROM sr)
       SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'hate_speech' WHEN 1 THEN 'general' END AS category,
        CASE event_id % 6 WHEN 0 THEN trim(regexp_extract(reply, 'EXPLICACIÓN:(.*)', 1)) WHEN 1 THEN trim(replace(split_part(reply, 'Category: general' || chr(10), 2), chr(10), ' '))
          WHEN 2 THEN 'Análisis externo no disponible.' WHEN 3 THEN 'Análisis externo completado sin detalles adicionales.'
          WHEN 4 THEN trim(regexp_extract(reply, 'explicación:(.*)', 1)) ELSE CASE WHEN length(reply) < 10 THEN 'Análisis externo completado sin detalles adicionales.' ELSE reply END END AS explanation FROM x""",
)
def parse_reply(v):
    rows = v.raw("events").selectExpr(
        "event_id",
        "CASE event_id % 6 WHEN 0 THEN concat('CATEGORÍA: Hate_Speech', chr(10), 'EXPLICACIÓN: El texto: ataca a ', event_type) "
        "WHEN 1 THEN concat('Category: general', chr(10), 'Texto libre sobre ', event_type, chr(10), 'segunda línea') WHEN 2 THEN '' "
        "WHEN 3 THEN 'EXPLICACIÓN: breve' WHEN 4 THEN concat('explicación:  suficiente texto ', event_type, chr(10), 'CATEGORÍA: tarde') "
        "ELSE event_type END AS reply",
    )
    return rows.withColumn("r", O.parse_reply(F.col("reply"))).select("event_id", "r.category", "r.explanation")


@query(
    "F12_labels_from_scores",
    """WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'TOXIC' WHEN 'view' THEN 'odio_label' WHEN 'purchase' THEN 'Positive' WHEN 'error' THEN 'hate' ELSE 'other' END AS l,
          CAST(event_id % 10 AS DOUBLE) / 10 AS s1, CAST(event_id % 7 AS DOUBLE) / 7 AS s2 FROM events),
       m AS (SELECT event_id, greatest(CASE WHEN l IN ('odio_label', 'hate') THEN s1 ELSE 0 END) AS hate, CASE WHEN l IN ('TOXIC', 'hate') THEN s1 ELSE 0 END AS toxic,
          greatest(s2, CASE WHEN l = 'Positive' THEN s1 ELSE 0 END) AS pos FROM s),
       f AS (SELECT event_id, list_filter([CASE WHEN hate > 0.3 THEN 'hate_speech' END, CASE WHEN toxic > 0.3 THEN 'toxic_content' END,
          CASE WHEN greatest(hate, toxic) < 0.3 AND pos > 0.6 THEN 'normal_content' END], lambda x: x IS NOT NULL) AS k FROM m)
       SELECT event_id, CASE WHEN len(k) > 0 THEN array_to_string(k, ',') ELSE 'general' END AS labels FROM f""",
)
def scores(v):
    rows = v.raw("events").selectExpr(
        "event_id",
        "array(named_struct('label', CASE event_type WHEN 'click' THEN 'TOXIC' WHEN 'view' THEN 'odio_label' WHEN 'purchase' THEN 'Positive' "
        "WHEN 'error' THEN 'hate' ELSE 'other' END, 'score', CAST(event_id % 10 AS DOUBLE) / 10), "
        "named_struct('label', 'NORMAL', 'score', CAST(event_id % 7 AS DOUBLE) / 7)) AS scores",
    )
    return rows.select("event_id", F.array_join(O.labels_from_scores(F.col("scores")), ",").alias("labels"))


@query(
    "F13_keyword_category",
    "SELECT post_id, CASE " + " ".join(f"WHEN {any_sql('content', w)} THEN '{c}'" for c, w in P.KEYWORD_CATEGORY) + " END AS category FROM posts",
)
def keyword_category(v):
    return v.texts.select("post_id", O.keyword_category(F.col("content")).alias("category"))


MESSAGES = """CASE event_id % 8 WHEN 0 THEN 'Connection reset' WHEN 1 THEN 'Read TIMEOUT after 5s' WHEN 2 THEN 'API key invalid' WHEN 3 THEN 'Rate limit hit'
   WHEN 4 THEN 'Model not found: x' WHEN 5 THEN 'upload failed' WHEN 6 THEN 'bad environment' ELSE props END"""


@query(
    "F14_classify_errors",
    f"""SELECT event_id, CASE WHEN contains(lower(m), 'timeout') THEN 'timeout_error' WHEN {any_sql('m', P.NETWORK_WORDS)} THEN 'network_error' """
    + " ".join(f"WHEN {any_sql('m', w)} THEN '{c}'" for c, w, _, _ in P.ERROR_CLASSES)
    + f""" ELSE 'unknown_error' END AS error_class, CASE WHEN {any_sql('m', P.NETWORK_WORDS)} THEN TRUE """
    + " ".join(f"WHEN {any_sql('m', w)} THEN {str(r).upper()}" for _, w, r, _ in P.ERROR_CLASSES)
    + f""" ELSE FALSE END AS recoverable, CAST(CASE WHEN contains(lower(m), 'timeout') THEN 5 WHEN {any_sql('m', P.NETWORK_WORDS)} THEN 2 """
    + " ".join(f"WHEN {any_sql('m', w)} THEN {'NULL' if d is None else d}" for _, w, _, d in P.ERROR_CLASSES)
    + f""" END AS INTEGER) AS retry_delay FROM (SELECT event_id, {MESSAGES} AS m FROM events) e""",
)
def errors(v):
    rows = v.raw("events").select("event_id", F.expr(MESSAGES).alias("error_message"))
    return O.classify_errors(rows).select("event_id", "error_class", "recoverable", "retry_delay")


def tags_sql(text, rules):
    parts = ", ".join(f"CASE WHEN {any_sql(text, w)} THEN [{', '.join(lit(t) for t in tags)}] ELSE [] END" for w, tags in rules)
    return f"array_to_string(list_sort(list_distinct(flatten([{parts}]))), ',')"


@query(
    "F15_topic_tags",
    f"SELECT post_id, {tags_sql('content', P.SPANISH_TAGS)} AS spanish, {tags_sql('content', P.ENGLISH_TAGS)} AS english FROM posts",
)
def tags(v):
    return v.texts.select(
        "post_id",
        F.array_join(O.topic_tags(F.col("content"), "maldita"), ",").alias("spanish"),
        F.array_join(O.topic_tags(F.col("content"), "snopes"), ",").alias("english"),
    )


def verdict_sql(text, rules):
    head = "CASE " + " ".join(f"WHEN {any_sql(text, w)} THEN '{n}'" for n, _, w in rules) + " ELSE 'unverified' END"
    tail = "CAST(CASE " + " ".join(f"WHEN {any_sql(text, w)} THEN {c}" for _, c, w in rules) + " ELSE 0.3 END AS DOUBLE)"
    return head, tail


VT = """CASE page_id % 6 WHEN 0 THEN concat(url, ' es FALSO') WHEN 1 THEN concat('Cierto: ', url) WHEN 2 THEN 'parcialmente' WHEN 3 THEN 'contenido engañoso y mixta' WHEN 4 THEN 'incorrecto, mixed' ELSE url END"""


@query(
    "F16_normalize_verdict",
    "SELECT page_id, {} AS verdict, {} AS confidence FROM (SELECT page_id, {} AS t FROM pages) p".format(*verdict_sql("t", P.VERDICT_WORDS), VT),
)
def verdicts(v):
    rows = v.raw("pages").select("page_id", F.expr(VT).alias("t")).withColumn("r", O.normalize_verdict(F.col("t")))
    return rows.select("page_id", "r.verdict", "r.confidence")


@query(
    "F17_infer_verdict",
    " UNION ALL ".join(
        "SELECT page_id, '{}' AS source, {} AS verdict, {} AS confidence FROM (SELECT page_id, concat({}, ' ', url) AS t FROM pages) p".format(
            s, *verdict_sql("t", rules), VT
        )
        for s, rules in P.SOURCE_VERDICTS.items()
    ),
)
def infer(v):
    rows = v.raw("pages").select("page_id", "url", F.expr(VT).alias("t"))
    parts = [
        rows.withColumn("r", O.infer_verdict(F.col("t"), F.col("url"), s)).select("page_id", F.lit(s).alias("source"), "r.verdict", "r.confidence")
        for s in P.SOURCE_VERDICTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query(
    "F18_relevance",
    f"""WITH t AS (SELECT page_id, list_distinct(list_filter(string_split({TITLE}, ' '), lambda x: x <> '')) AS q, list_distinct(list_filter(regexp_split_to_array(html, '\\s+'), lambda x: x <> '')) AS w FROM pages)
       SELECT page_id, round(CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: list_contains(w, x))) / len(q) ELSE 0 END, 6) AS relevance FROM t""",
)
def relevance(v):
    return v.raw("pages").select("page_id", F.round(C.relevance(F.expr(TITLE), F.col("html")), 6).alias("relevance"))


FAMILY = "CASE " + " ".join(f"WHEN {any_sql('q', w)} THEN {i}" for i, (w, _) in enumerate(P.TOPIC_FAMILIES)) + " END"
COVERS = "CASE " + " ".join(f"WHEN fam = {i} THEN {any_sql('t', w)}" for i, (_, w) in enumerate(P.TOPIC_FAMILIES)) + " ELSE FALSE END"


@query(
    "F19_relevant_articles",
    f"""WITH q AS (SELECT page_id AS query_id, lower(concat({TITLE}, CASE page_id % 40 WHEN 0 THEN ' pib' WHEN 1 THEN ' covid' ELSE '' END)) AS q FROM pages WHERE length({TITLE}) > 0),
       w AS (SELECT query_id, q, {FAMILY} AS fam, list_filter(regexp_split_to_array(q, '\\s+'), lambda x: x <> '') AS ws FROM q),
       a AS (SELECT doc_id AS article_id, lower(concat(source, ' ', CASE doc_id % 9 WHEN 0 THEN 'crecimiento bruto' WHEN 1 THEN 'vacuna' ELSE '' END, ' ', text)) AS t FROM documents),
       m AS (SELECT query_id, article_id, len(list_filter(ws, lambda x: contains(t, x))) AS n, len(ws) AS total, {COVERS} AS cov FROM w CROSS JOIN a)
       SELECT query_id, article_id, round(n / total, 6) AS relevance FROM m WHERE n > 0 OR cov""",
)
def relevant(v):
    title = F.expr(f"concat({TITLE}, CASE page_id % 40 WHEN 0 THEN ' pib' WHEN 1 THEN ' covid' ELSE '' END)")
    asked = v.raw("pages").filter(F.expr(f"length({TITLE}) > 0")).select(F.col("page_id").alias("query_id"), title.alias("query"))
    articles = v.raw("documents").select(
        F.col("doc_id").alias("article_id"),
        F.col("source").alias("title"),
        F.expr("concat(CASE doc_id % 9 WHEN 0 THEN 'crecimiento bruto' WHEN 1 THEN 'vacuna' ELSE '' END, ' ', text)").alias("description"),
    )
    return O.relevant_articles(asked, articles, digits=6)


@query(
    "F20_page_text",
    """WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs') AS h FROM pages)
       SELECT page_id, trim(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(h, '(?s)<p[^>]*>(.*?)</p>', 1), ' '), '&[^;]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS page_text FROM b""",
)
def page_text(v):
    return spread(v.raw("pages").select("page_id", "html")).select("page_id", C.page_text(F.col("html")).alias("page_text"))


LINKS = """CASE event_id % 5 WHEN 0 THEN concat('/', event_type, '/status/', CAST(event_id AS VARCHAR(32)), '?s=20') WHEN 1 THEN concat(event_type, '/status/', CAST(event_id AS VARCHAR(32)), '/photo/1')
   WHEN 2 THEN concat('/', event_type, '/likes') WHEN 3 THEN '' ELSE concat('/i/status/', CAST(event_id AS VARCHAR(32))) END"""


@query(
    "F21_author_and_id",
    f"""WITH l AS (SELECT event_id, event_type, string_split(trim({LINKS}, '/'), '/') AS p FROM events)
       SELECT event_id, CASE WHEN len(p) >= 3 AND p[2] = 'status' THEN p[1] END AS author, CASE WHEN len(p) >= 3 AND p[2] = 'status' THEN split_part(p[3], '?', 1) END AS post_id,
       coalesce(len(p) >= 3 AND p[2] = 'status' AND p[1] = event_type, FALSE) AS own FROM l""",
)
def links(v):
    href = F.expr(LINKS.replace("VARCHAR(32)", "STRING"))
    return v.raw("events").withColumn("l", C.author_and_id(href)).select(
        "event_id", "l.author", "l.post_id", C.by_author(href, F.col("event_type")).alias("own")
    )


COUNTS = """CASE event_id % 6 WHEN 0 THEN concat(CAST(event_id % 50 AS VARCHAR(32)), ',5K') WHEN 1 THEN concat(CAST(event_id % 9 AS VARCHAR(32)), 'm') WHEN 2 THEN CAST(event_id AS VARCHAR(32))
   WHEN 3 THEN 'abc' WHEN 4 THEN '' ELSE concat(' ', CAST(event_id % 7 AS VARCHAR(32)), '.25k') END"""


@query(
    "F22_parse_count",
    """SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN (event_id % 50) * 1000 + 500 WHEN 1 THEN (event_id % 9) * 1000000 WHEN 2 THEN event_id
       WHEN 5 THEN (event_id % 7) * 1000 + 250 ELSE 0 END AS BIGINT) AS n FROM events""",
)
def counts(v):
    return v.raw("events").select("event_id", C.parse_count(F.expr(COUNTS.replace("VARCHAR(32)", "STRING"))).alias("n"))


def post_pages(v):
    """Stored post pages built from the documents' texts."""
    return v.posts.select(
        F.col("post_id").alias("page_id"),
        F.expr(
            "concat('<article data-testid=\"tweet\"><div data-testid=\"socialContext\">', CASE post_num % 10 WHEN 0 THEN 'Pinned' WHEN 1 THEN concat(username, ' retweeted') ELSE '' END, "
            "'</div><a href=\"/', CASE post_num % 7 WHEN 0 THEN 'other' ELSE username END, '/status/', post_id, '?s=1\"><time datetime=\"2024-01-01T00:00:00Z\"></time></a>"
            "<div data-testid=\"tweetText\">', replace(replace(content, '&', '&amp;'), '<', '&lt;'), '</div>"
            "<img src=\"https://pbs.twimg.com/media/', post_id, '.jpg\"><div data-testid=\"like\" aria-label=\"', cast(likes as string), ',5K likes\"></div>', "
            "CASE post_num % 5 WHEN 0 THEN '<i class=\"x r-1bimlpy\"></i>' ELSE '' END, '</article>')"
        ).alias("html"),
        "username",
    )


STRIPPED = "trim({0}, chr(32) || chr(10) || chr(9) || chr(13))"


@query(
    "F23_parse_post_html",
    f"""SELECT post_id AS page_id, CASE post_num % 7 WHEN 0 THEN 'other_author' ELSE 'ok' END AS status, post_id, CASE post_num % 7 WHEN 0 THEN 'other' ELSE username END AS username,
       CASE WHEN post_num % 7 <> 0 THEN {STRIPPED.format('content')} END AS content, CAST(CASE WHEN post_num % 7 <> 0 THEN 1 END AS INTEGER) AS media_count,
       CASE WHEN post_num % 7 <> 0 THEN likes * 1000 + 500 END AS likes, CASE WHEN post_num % 7 <> 0 THEN CASE post_num % 10 WHEN 0 THEN 'pinned' WHEN 1 THEN 'repost_own' ELSE 'original' END END AS post_type,
       CASE WHEN post_num % 7 <> 0 THEN post_num % 5 = 0 END AS has_thread_line FROM posts""",
)
def post_html(v):
    return O.parse_post_html(spread(post_pages(v))).select(
        "page_id", "status", "post_id", "username", "content", "media_count", "likes", "post_type", "has_thread_line"
    )


VIDEO = "(" + " OR ".join(f"contains(u, '{m}') OR contains(u, 'format={m[1:]}')" for m in P.VIDEO_MARKS) + ")"
IMAGE = "(" + " OR ".join(f"contains(u, '{m}') OR contains(u, 'format={m[1:]}')" for m in P.IMAGE_MARKS) + ")"
URLS = "list_filter(list_transform(string_split(coalesce(media_links, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(
    "F24_media_type",
    f"""WITH u AS (SELECT post_id, unnest(CASE WHEN len({URLS}) = 0 THEN [NULL] ELSE {URLS} END) AS u FROM posts),
       k AS (SELECT post_id, bool_or(coalesce({VIDEO} OR contains(u, 'video'), FALSE)) AS v, bool_or(coalesce(NOT ({VIDEO} OR contains(u, 'video')) AND ({IMAGE} OR contains(u, 'image')), FALSE)) AS i FROM u GROUP BY post_id)
       SELECT post_id, CASE WHEN v AND i THEN 'mixed' WHEN v THEN 'video' WHEN i THEN 'image' ELSE '' END AS media_type FROM k""",
)
def media_type(v):
    from plazalens.sources.tables import with_media_list

    return with_media_list(v.posts).select("post_id", C.media_type(F.col("media_urls")).alias("media_type"))


@query(
    "F25_pick_media",
    f"""WITH u AS (SELECT post_id, {URLS} AS us FROM posts),
       x AS (SELECT post_id, unnest(CASE WHEN len(us) = 0 THEN [NULL] ELSE us END) AS u, us FROM u)
       SELECT post_id, any_value(coalesce(list_filter(us, lambda u: contains(u, '.mp4'))[1], list_filter(us, lambda u: contains(u, '.m3u8'))[1], list_filter(us, lambda u: contains(u, 'video') OR contains(u, 'vid/'))[1], us[1])) AS picked,
        bool_or(coalesce(NOT {IMAGE} AND {VIDEO}, FALSE)) AND NOT bool_or(coalesce({IMAGE}, FALSE)) AS only_videos FROM x GROUP BY post_id""",
)
def pick(v):
    from plazalens.sources.tables import with_media_list

    urls = F.col("media_urls")
    return with_media_list(v.posts).select("post_id", C.pick_media(urls).alias("picked"), C.only_videos(urls).alias("only_videos"))


@query(
    "F26_stages",
    """SELECT post_id, list_contains(string_split(coalesce(analysis_stages, ''), ','), 'explanation') AS explanation,
       array_to_string(list_filter(['pattern', 'category_detection', 'media_analysis', 'explanation', 'external'], lambda s: list_contains(string_split(coalesce(analysis_stages, ''), ','), s)), ',') AS stages FROM content_analyses""",
)
def stages(v):
    flags = v.content_analyses.withColumn("s", C.stage_flags(F.col("analysis_stages")))
    return flags.select("post_id", "s.explanation", C.stage_text({k: F.col(f"s.{k}") for k in P.STAGES}).alias("stages"))


@query(
    "F27_best_explanation",
    """SELECT post_id, CASE WHEN length(trim(coalesce(external_explanation, ''), chr(32) || chr(10) || chr(9) || chr(13))) > 0 THEN external_explanation WHEN coalesce(local_explanation, '') <> '' THEN local_explanation ELSE 'Sin análisis disponible' END AS best,
       length(trim(coalesce(external_explanation, ''), chr(32) || chr(10) || chr(9) || chr(13))) > 0 AND length(trim(coalesce(local_explanation, ''), chr(32) || chr(10) || chr(9) || chr(13))) > 0 AS dual,
       concat(coalesce(analysis_stages, 'pattern'), CASE WHEN external_analysis_used THEN ' (external)' ELSE '' END) AS method FROM content_analyses""",
)
def best(v):
    ext, loc = F.col("external_explanation"), F.col("local_explanation")
    return v.content_analyses.select(
        "post_id", C.best_explanation(ext, loc).alias("best"), C.dual_explanations(ext, loc).alias("dual"),
        C.display_method(F.col("analysis_stages"), F.col("external_analysis_used")).alias("method"),
    )


DECODED = """CASE WHEN a.categories_detected IS NOT NULL AND json_valid(a.categories_detected) THEN CAST(from_json(CASE WHEN json_valid(a.categories_detected) THEN a.categories_detected ELSE '[]' END, '["VARCHAR"]') AS VARCHAR[])
   WHEN coalesce(a.category, '') <> '' THEN [a.category] ELSE [] END"""


@query(
    "F28_display_flags",
    f"""SELECT p.post_id, p.post_type IN ('repost_other', 'repost_own', 'repost_reply') AS is_repost, CASE WHEN p.post_type IN ('repost_other', 'repost_own', 'repost_reply') THEN p.post_type END AS repost_kind,
       array_to_string(list_filter([CASE WHEN p.is_deleted THEN 'deleted' END, CASE WHEN p.is_edited THEN 'edited' END], lambda x: x IS NOT NULL), ',') AS warnings, coalesce(a.category, 'general') AS category,
       len({DECODED}) > 1 AS has_multiple_categories FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id""",
)
def flags(v):
    joined = v.posts.join(v.content_analyses, "post_id", "left")
    return O.display_flags(joined).select(
        "post_id", "is_repost", "repost_kind", F.array_join(F.col("warnings.type"), ",").alias("warnings"), "category", "has_multiple_categories"
    )


@query(
    "F29_secondary_categories",
    f"SELECT a.post_id, array_to_string(list_filter({DECODED}, lambda c: c <> a.category), ',') AS secondary, len({DECODED}) > 1 AS has_multiple FROM content_analyses a",
)
def secondary(v):
    return O.secondary_categories(v.content_analyses).select("post_id", F.array_join("secondary", ",").alias("secondary"), "has_multiple")


@query("F30_decode_categories", f"SELECT a.post_id, array_to_string({DECODED}, ',') AS categories FROM content_analyses a")
def decode(v):
    return O.decode_categories(v.content_analyses).select("post_id", F.array_join("categories", ",").alias("categories"))


@query(
    "F31_resolve_category",
    f"""WITH s AS (SELECT a.post_id, a.category AS pattern_category, m.category AS model_category, a.local_explanation, json_extract_string(a.verification_data, '$.overall_verdict') AS verdict,
         CASE WHEN x.error_message IS NULL THEN x.category END AS external_category FROM content_analyses a LEFT JOIN model_analyses m ON m.post_id = a.post_id AND m.model_name = 'm_fast' AND m.error_message IS NULL
         LEFT JOIN model_analyses x ON x.post_id = a.post_id AND x.model_name = 'm_large' AND x.confidence_score > 0.6),
       l AS (SELECT *, CASE WHEN verdict = 'debunked' THEN 'disinformation' WHEN NOT {any_sql('local_explanation', P.LOCAL_NEGATIVE)} AND {any_sql('local_explanation', P.LOCAL_POSITIVE)} THEN 'disinformation'
         ELSE coalesce(model_category, pattern_category, 'general') END AS local_category FROM s)
       SELECT post_id, local_category, coalesce(external_category, local_category) AS final_category FROM l""",
)
def resolve(v):
    fast = v.model_analyses.filter("model_name = 'm_fast' AND error_message IS NULL").select("post_id", F.col("category").alias("model_category"))
    large = v.model_analyses.filter("model_name = 'm_large' AND confidence_score > 0.6 AND error_message IS NULL").select(
        "post_id", F.col("category").alias("external_category")
    )
    stages = (
        v.content_analyses.select(
            "post_id", F.col("category").alias("pattern_category"), "local_explanation",
            F.get_json_object("verification_data", "$.overall_verdict").alias("verdict"),
        )
        .join(fast, "post_id", "left")
        .join(large, "post_id", "left")
    )
    return O.resolve_category(stages).select("post_id", "local_category", "final_category")


@query(
    "F32_external_eligible",
    "SELECT post_id, model_name FROM model_analyses WHERE category NOT IN ('general', 'political_general')",
)
def eligible(v):
    return O.external_eligible(v.model_analyses).select("post_id", "model_name")


@query(
    "F33_score_models",
    """SELECT post_id, 'length' AS model_name, CASE WHEN length(content) > 1000 THEN 'political_general' ELSE 'general' END AS category, CAST(NULL AS VARCHAR) AS error_message FROM posts
       UNION ALL SELECT post_id, 'fragile', 'general', CASE WHEN contains(content, 'Todos a las calles') THEN 'refused' END FROM posts""",
)
def score(v):
    return O.score_models(v.texts, {"length": by_length, "fragile": refusing}).select("post_id", "model_name", "category", "error_message")


def search_pages(v):
    """Stored search pages: each document becomes an article of one of them."""
    return v.raw("documents").select(
        F.col("doc_id").cast("string").alias("page_id"),
        F.expr(
            "concat('<article><h2>', CASE doc_id % 4 WHEN 0 THEN 'Falso: ' WHEN 1 THEN 'Cierto: ' WHEN 2 THEN 'Parcialmente ' ELSE '' END, source, '</h2><a href=\"/f/', "
            "cast(doc_id as string), '\">x</a><p>', replace(replace(text, '&', '&amp;'), '<', '&lt;'), '</p><time datetime=\"2024-05-0', cast(1 + doc_id % 9 as string), 'T10:00:00Z\"></time></article>')"
        ).alias("html"),
    )


def fact_check_sql():
    both = "concat(title, ' ', excerpt)"
    verdict, confidence = verdict_sql(both, P.SOURCE_VERDICTS["maldita"])
    return f"""WITH a AS (SELECT doc_id, {STRIPPED.format("concat(CASE doc_id % 4 WHEN 0 THEN 'Falso: ' WHEN 1 THEN 'Cierto: ' WHEN 2 THEN 'Parcialmente ' ELSE '' END, source)")} AS title, {STRIPPED.format('text')} AS excerpt FROM documents),
      b AS (SELECT *, {verdict} AS verdict, {confidence} AS confidence FROM a)
      SELECT CAST(doc_id AS VARCHAR) AS page_id, title AS claim, verdict, confidence, concat('https://maldita.es/f/', CAST(doc_id AS VARCHAR)) AS url, concat('2024-05-0', CAST(1 + doc_id % 9 AS VARCHAR)) AS published,
        {tags_sql(both, P.SPANISH_TAGS)} AS tags FROM b WHERE verdict <> 'unverified'"""


@query("F34_parse_fact_checks", fact_check_sql())
def fact_check_pages(v):
    return O.parse_fact_checks(spread(search_pages(v)), "maldita").select(
        "page_id", "claim", "verdict", "confidence", "url", F.date_format("publication_date", "yyyy-MM-dd").alias("published"), F.array_join("tags", ",").alias("tags")
    )


def stat_payloads(v, source):
    """Stored statistics answers: one JSON text per user, filled from the events."""
    base = v.raw("events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum(F.col("event_id") % 100).alias("s")
    )
    shapes = {
        "ine": "concat('[{\"Data\":[{\"Valor\":\"', cast(n as string), ',', lpad(cast(s % 1000 as string), 3, '0'), '\",\"Anyo\":2023},{\"Valor\":\"1\",\"Anyo\":2000}]}]')",
        "eurostat_gdp": "concat('{\"value\":{', array_join(transform(sequence(0, 6), i -> concat('\"', cast(i as string), '\":', cast(n + i as string), '.5')), ','), "
        "'},\"dimension\":{\"time\":{\"category\":{\"index\":{', array_join(transform(sequence(0, 7), i -> concat('\"', cast(2015 + i as string), '\":', cast(i as string))), ','), '}}}}}')",
        "who": "concat('{\"value\":[{\"Year\":2019,\"NumericValue\":', cast(n as string), '.25},{\"Year\":2020,\"NumericValue\":null}]}')",
        "worldbank": "concat('[{\"page\":1},[', array_join(transform(sequence(1, 7), i -> concat('{\"date\":\"', cast(2014 + i as string), '\",\"value\":', cast(s + i as string), '}')), ','), ']]')",
    }
    return base.select(F.col("user_id").alias("payload_id"), F.expr(shapes[source]).alias("payload"))


@query(
    "F35_normalize_statistics",
    """WITH b AS (SELECT user_id, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS s FROM events GROUP BY user_id)
       SELECT user_id AS payload_id, 'INE' AS source, 'population' AS indicator, 2023 AS year, CAST(n || lpad(CAST(s % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS value FROM b
       UNION ALL SELECT user_id, 'Eurostat', 'gdp', CAST(2015 + i AS INTEGER), (n + i + 0.5) * 1000000.0 FROM b CROSS JOIN (SELECT unnest(range(0, 7)) AS i) r
       UNION ALL SELECT user_id, 'WHO', 'life_expectancy', 2019, n + 0.25 FROM b
       UNION ALL SELECT user_id, 'World Bank', 'gdp_per_capita', CAST(2014 + i AS INTEGER), CAST(s + i AS DOUBLE) FROM b CROSS JOIN (SELECT unnest(range(1, 8)) AS i) r""",
)
def statistics(v):
    parts = [O.normalize_statistics(stat_payloads(v, s), s) for s in ("ine", "eurostat_gdp", "who", "worldbank")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("payload_id", "source", "indicator", "year", "value")
