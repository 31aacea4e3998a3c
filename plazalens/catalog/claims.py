"""Queries for claim extraction, parsing and search queries."""

from pyspark.sql import functions as F

from plazalens.catalog.registry import query
from plazalens.operators import claims as O
from plazalens.rules import claims as R



def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


# RE2 has no Unicode \b: boundaries are spelled out.
W = "[^0-9A-Za-zÀ-ÿ_]"
NUM = f"(^|{W})([0-9]{{1,3}}(,[0-9]{{3}})*(\\.[0-9]+)?($|{W})|[0-9]+(\\.[0-9]+)?%[0-9A-Za-zÀ-ÿ_]|[0-9]+(\\.[0-9]+)?\\s+(millones?|billones?|mil|trillones?)($|{W})|[0-9]+(\\.[0-9]+)?\\s*(euros?|dólares?)($|{W})|[0-9]+(\\.[0-9]+)?\\s*[€$£][0-9A-Za-zÀ-ÿ_])"
TEMP = f"(^|{W})([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|(19|20)[0-9]{{2}}|(hace|en|desde|durante)\\s+[0-9]+\\s+(días?|meses?|años?|horas?))($|{W})"


def has(col, words):
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


SENTENCES = """s AS (SELECT post_id, content, unnest(string_split(regexp_replace(trim(content, chr(32) || chr(10) || chr(9) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence,
   unnest(range(len(string_split(regexp_replace(trim(content, chr(32) || chr(10) || chr(9) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))) AS sentence_no FROM posts)"""

CONTEXTUAL = f"""{SENTENCES}, q AS (SELECT post_id, content, sentence, sentence_no, regexp_matches(sentence, '{NUM}', 'i') AS num, regexp_matches(sentence, '{TEMP}', 'i') AS tmp,
     regexp_extract(sentence, '([0-9]+(?:[.,][0-9]+)*)', 1) AS n1, lower(regexp_extract(sentence, '[0-9]+(?:[.,][0-9]+)*(.*)$', 1, 's')) AS rest,
     nullif(regexp_extract(sentence, '([0-9]{{4}})', 1), '') AS yr FROM s WHERE sentence <> ''),
   v AS (SELECT *, CASE WHEN num AND n1 <> '' THEN CASE WHEN contains(rest, 'millones') OR contains(rest, 'million') THEN n1 || ' millones'
       WHEN contains(rest, 'billones') OR contains(rest, 'billion') THEN n1 || ' billones' WHEN contains(rest, '%') THEN n1 || '%' ELSE n1 END END AS val FROM q WHERE num OR tmp),
   t AS (SELECT *, (tmp AND yr IS NOT NULL AND (val IS NULL OR (NOT {has('sentence', R.NUMERIC_LEAD)} AND {has('sentence', R.TEMPORAL_LEAD)}))) AS dated FROM v),
   claims AS (SELECT post_id, sentence_no AS rule, CASE WHEN dated THEN 'temporal' ELSE 'numerical' END AS claim_type, sentence AS claim_text, CASE WHEN dated THEN yr ELSE val END AS extracted_value,
       CAST(instr(content, sentence) - 1 AS INTEGER) AS start_pos FROM t)"""

SCORED = f"""{CONTEXTUAL}, b AS (SELECT *, (contains(claim_text, '2024') OR contains(claim_text, '2023')) AS recent, {has('claim_text', R.ECONOMY_NUMBERS)} AS eco,
     contains(claim_text, '%') AS pct, {has('claim_text', R.IMPORTANT_TOPICS)} AS topic, {has('claim_text', R.OFFICIAL_CONTEXT)} AS off FROM claims),
   c0 AS (SELECT *, CASE WHEN recent THEN 0.8 WHEN eco THEN 0.9 WHEN pct THEN 0.85 ELSE 0.7 END AS cf, CASE WHEN recent THEN 8 WHEN eco THEN 10 WHEN pct THEN 9 ELSE 6 END AS pr FROM b),
   scored AS (SELECT post_id, rule, claim_type, claim_text, extracted_value, start_pos,
     CAST(round(least(CASE WHEN topic THEN greatest(cf, 0.85) ELSE cf END + CASE WHEN off THEN 0.1 ELSE 0 END, 1.0), 4) AS DOUBLE) AS confidence,
     CAST(least(CASE WHEN topic THEN greatest(pr, 9) ELSE pr END + CASE WHEN off THEN 1 ELSE 0 END, 10) AS INTEGER) AS priority FROM c0)"""

TOP = f"""{SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY priority DESC, confidence DESC, rule, start_pos) AS rn FROM scored)"""


def scored(v):
    return O.score_claims(O.contextual_claims(v.texts), as_of())


def re2_claim(rule):
    """A claim rule in RE2 notation: ASCII boundaries, which the texts' numbers and keywords have."""
    return rule.replace("'", "''")


MATCHES = " UNION ALL ".join(
    f"SELECT post_id, '{kind}' AS claim_type, {i} AS rule, unnest(regexp_extract_all(content, '(?i){re2_claim(p)}')) AS claim_text FROM posts"
    for kind, (_, patterns) in R.CLAIM_RULES.items()
    for i, p in enumerate(patterns)
)


@query(
    "E1_extract_matches",
    f"SELECT post_id, claim_type, rule, claim_text, CASE WHEN claim_type IN ('numerical', 'temporal') THEN claim_text END AS extracted_value FROM ({MATCHES}) m",
)
def matches(v):
    return O.extract_matches(v.texts).select("post_id", "claim_type", "rule", "claim_text", "extracted_value")


def located(pattern, text):
    """All matches of a pattern with their places: the k-th begins after the pieces and matches before it."""
    return f"""unnest(list_transform(range(1, len(m) + 1), lambda k: struct_pack(t := m[k], at := CAST(coalesce(list_sum(list_transform(s[1:k], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER)))) AS x FROM (SELECT *, regexp_extract_all({text}, {pattern}) AS m, string_split_regex({text}, {pattern}) AS s FROM posts) q"""


def around(text, start, stop, width):
    """The text from ``width`` characters before a match to as many after it, without white space at its ends."""
    return f"trim(substring({text}, greatest({start} - {width}, 0) + 1, {stop} + {width} - greatest({start} - {width}, 0)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


LOCATED = " UNION ALL ".join(
    f"SELECT post_id, content, '{kind}' AS phase, {i} AS rule, {width} AS w, {located(f"'(?i){re2_claim(p)}'", 'content')}"
    for kind, (width, patterns) in R.CLAIM_RULES.items()
    for i, p in enumerate(patterns)
)
SPANS = f"""ml AS (SELECT post_id, phase, rule, x.t AS claim_text, {around('content', 'x.at', '(x.at + length(x.t))', 'w')} AS context,
  x.at AS start_pos, CAST(x.at + length(x.t) AS INTEGER) AS end_pos FROM ({LOCATED}) l)"""


@query(
    "E1_match_spans",
    f"""WITH {SPANS} SELECT post_id, phase AS claim_type, phase, rule, claim_text, context, CASE WHEN phase IN ('numerical', 'temporal') THEN claim_text END AS extracted_value, start_pos, end_pos FROM ml""",
)
def spans(v):
    return O.extract_matches(v.texts)


def dbl(x):
    return f"CAST({x} AS DOUBLE)"


CT, CX = "claim_text", "context"
FIGURE, SERIOUS = has(CT, R.FIGURES), has(CT, R.SERIOUS_ACTIONS)
RECENT = "(contains(claim_text, '2024') OR contains(claim_text, '2023'))"
OFF, SAID, SOURCE = (f"CAST({has(CX, w)} AS INTEGER)" for w in (R.OFFICIAL_CONTEXT, R.STATISTICAL_CONTEXT, R.SOURCED))
START_C = f"CASE WHEN {RECENT} THEN {dbl(0.8)} WHEN {has(CT, R.ECONOMY_NUMBERS)} THEN {dbl(0.9)} WHEN contains(claim_text, '%') THEN {dbl(0.85)} ELSE {dbl(0.7)} END"
START_P = f"CASE WHEN {RECENT} THEN 8 WHEN {has(CT, R.ECONOMY_NUMBERS)} THEN 10 WHEN contains(claim_text, '%') THEN 9 ELSE 6 END"
PHASE_SCORES = {
    "numerical": (
        f"least(CASE WHEN contains(claim_text, '%') THEN {dbl(0.9)} WHEN {has(CT, R.BIG_NUMBERS)} THEN {dbl(0.95)} ELSE {dbl(0.8)} END + {SAID} * {dbl(0.1)}, {dbl(1)})",
        f"least(CASE WHEN contains(claim_text, '%') THEN 9 WHEN {has(CT, R.BIG_NUMBERS)} THEN 10 ELSE 7 END + {SAID}, 10)",
    ),
    "temporal": (
        f"CASE WHEN contains(claim_text, '/') OR contains(claim_text, '-') THEN {dbl(0.9)} WHEN {RECENT} THEN {dbl(0.85)} ELSE {dbl(0.7)} END",
        f"CASE WHEN contains(claim_text, '/') OR contains(claim_text, '-') THEN 9 WHEN {RECENT} THEN 8 ELSE 6 END",
    ),
    "attribution": (f"CASE WHEN {has(CT, R.OFFICIAL_SOURCES)} THEN {dbl(0.8)} ELSE {dbl(0.6)} END", f"CASE WHEN {has(CT, R.OFFICIAL_SOURCES)} THEN 8 ELSE 5 END"),
    "causal": (f"CASE WHEN {has(CX, R.CAUSAL_EVIDENCE)} THEN {dbl(0.7)} ELSE {dbl(0.5)} END", f"CASE WHEN {has(CX, R.CAUSAL_EVIDENCE)} THEN 6 ELSE 4 END"),
    "legal_event": (
        f"greatest(CASE WHEN {FIGURE} THEN {dbl(0.95)} WHEN {SERIOUS} THEN {dbl(0.9)} ELSE {dbl(0.8)} END - CAST(NOT {has(CT, R.LEGAL_SPECIFICS)} AS INTEGER) * {dbl(0.1)}, {dbl(0)})",
        f"CASE WHEN {FIGURE} OR {SERIOUS} THEN 10 ELSE 9 END",
    ),
    "breaking_news": (
        f"greatest(CASE WHEN {FIGURE} THEN {dbl(0.95)} ELSE {dbl(0.85)} END - {SOURCE} * {dbl(0.2)}, {dbl(0)})",
        f"least(CASE WHEN {FIGURE} THEN 10 ELSE 9 END - {SOURCE}, 10)",
    ),
    "contextual": (
        f"least(CASE WHEN {has(CT, R.IMPORTANT_TOPICS)} THEN greatest({START_C}, {dbl(0.85)}) ELSE {START_C} END + {OFF} * {dbl(0.1)}, {dbl(1)})",
        f"least(CASE WHEN {has(CT, R.IMPORTANT_TOPICS)} THEN greatest({START_P}, 9) ELSE {START_P} END + {OFF}, 10)",
    ),
}
PHASE_CASE = [" ".join(f"WHEN '{k}' THEN {pair[i]}" for k, pair in PHASE_SCORES.items()) for i in (0, 1)]
TURNS = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(O.PHASES))
ALL_CLAIMS = f"""{CONTEXTUAL}, {SPANS}, ac AS (SELECT post_id, phase AS claim_type, phase, rule, claim_text, context, start_pos FROM ml
    UNION ALL SELECT post_id, claim_type, 'contextual', rule, claim_text, claim_text, start_pos FROM claims),
  sa AS (SELECT *, CASE phase {PHASE_CASE[0]} END AS confidence, CASE phase {PHASE_CASE[1]} END AS priority FROM ac),
  na AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY priority DESC, confidence DESC, CASE phase {TURNS} END, rule, start_pos) - 1 AS claim_no FROM sa)"""


@query(
    "E1_scored_claims",
    f"""WITH {ALL_CLAIMS} SELECT post_id, CAST(claim_no AS INTEGER) AS claim_no, claim_type, claim_text, CAST(priority AS INTEGER) AS priority, round(confidence, 4) AS confidence FROM na WHERE claim_no < 5""",
)
def scored_matches(v):
    return O.top_claims(O.score_claims(O.all_claims(v.texts), as_of())).select(
        "post_id", "claim_no", "claim_type", "claim_text", "priority", F.round("confidence", 4).alias("confidence")
    )


@query(
    "E2_contextual_claims",
    f"WITH {CONTEXTUAL} SELECT post_id, CAST(rule AS INTEGER) AS rule, claim_type, claim_text, extracted_value, start_pos FROM claims",
)
def contextual(v):
    return O.contextual_claims(v.texts).select("post_id", "rule", "claim_type", "claim_text", "extracted_value", "start_pos")


@query("E3_sentences", f"WITH {SENTENCES} SELECT post_id, CAST(sentence_no AS INTEGER) AS sentence_no, sentence FROM s WHERE sentence <> ''")
def sentences(v):
    return O.sentences(v.texts)


@query("E4_score_claims", f"WITH {SCORED} SELECT post_id, claim_type, claim_text, confidence, priority FROM scored")
def score(v):
    return scored(v).select("post_id", "claim_type", "claim_text", F.round("confidence", 4).alias("confidence"), "priority")


@query(
    "E5_top_claims",
    f"WITH {TOP} SELECT post_id, claim_text, confidence, priority, CAST(rn - 1 AS INTEGER) AS claim_no FROM top WHERE rn <= 2",
)
def top(v):
    return O.top_claims(scored(v), 2).select(
        "post_id", "claim_text", F.round("confidence", 4).alias("confidence"), "priority", "claim_no"
    )


NUMBERS = f"""{CONTEXTUAL}, nr AS (
     SELECT post_id, rule, claim_text, 0 AS pat, unnest(regexp_extract_all(claim_text, '\\b[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?\\b')) AS txt FROM claims
     UNION ALL SELECT post_id, rule, claim_text, 1, unnest(regexp_extract_all(claim_text, '\\b[0-9]+\\.[0-9]+\\b')) FROM claims
     UNION ALL SELECT post_id, rule, claim_text, 2, unnest(regexp_extract_all(claim_text, '\\b[0-9]+\\b')) FROM claims),
   nu AS (SELECT post_id, rule, claim_text, txt, min(pat) AS pat, CAST(replace(txt, ',', '') AS DOUBLE) AS value, instr(claim_text, txt) AS ps FROM nr WHERE NOT regexp_matches(txt, '^(19|20)[0-9][0-9]$') GROUP BY post_id, rule, claim_text, txt),
   nc AS (SELECT *, lower(substring(claim_text, greatest(ps - 50, 1), ps + 49 - greatest(ps - 50, 1) + 1)) AS ctx FROM nu)"""


@query(
    "E6_parse_numbers",
    f"""WITH {NUMBERS} SELECT post_id, CAST(rule AS INTEGER) AS rule, txt AS number_text, value,
       CASE WHEN contains(ctx, 'millon') THEN 'million' WHEN contains(ctx, 'billon') THEN 'billion' WHEN contains(ctx, '%') OR contains(ctx, 'por ciento') THEN 'percent'
         WHEN contains(ctx, 'euro') OR contains(ctx, '€') THEN 'euro' WHEN contains(ctx, 'persona') OR contains(ctx, 'habitante') THEN 'people' ELSE 'unknown' END AS unit,
       CASE WHEN contains(ctx, 'población') OR contains(ctx, 'habitantes') THEN 'population' WHEN contains(ctx, 'pib') OR contains(ctx, 'paro') OR contains(ctx, 'economía') THEN 'economic' ELSE 'general' END AS number_kind FROM nc""",
)
def numbers(v):
    return O.parse_numbers(O.contextual_claims(v.texts), ["post_id", "rule"]).select(
        "post_id", "rule", "number_text", "value", "unit", "number_kind"
    )


@query(
    "E7_parse_magnitude",
    f"""WITH {CONTEXTUAL} SELECT post_id, rule_no AS rule, CASE WHEN regexp_matches(claim_text, '(^|{W})millones($|{W})', 'i') THEN
        CAST(replace(regexp_extract(right(regexp_extract(claim_text, '^(.*?)(?:^|{W})millones', 1, 'is') || ' ', 20), '([0-9]+(?:[.,][0-9]+)*)', 1), ',', '') AS DOUBLE) * 1000000
        ELSE TRY_CAST(regexp_replace(extracted_value, '[%, ]', '', 'g') AS DOUBLE) END AS magnitude FROM
       (SELECT *, CAST(rule AS INTEGER) AS rule_no FROM claims) z""",
)
def magnitude(v):
    claims = O.contextual_claims(v.texts)
    text = F.when(F.col("claim_text").rlike(r"(?iU)\bmillones\b"), F.col("claim_text")).otherwise(F.col("extracted_value"))
    return claims.select("post_id", "rule", O.parse_magnitude(text).alias("magnitude"))


@query(
    "E8_temporal_check",
    f"""WITH {CONTEXTUAL}, d AS (SELECT post_id, CAST(rule AS INTEGER) AS rule, claim_text || ' ' || claim_text AS t FROM claims),
       e AS (SELECT *, CASE WHEN regexp_matches(t, '(^|{W})[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}($|{W})') THEN
           try_cast(regexp_replace(regexp_extract(t, '(?:^|{W})([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}})(?:$|{W})', 1), '^([0-9]+)[/-]([0-9]+)[/-]([0-9]+)$', '\\3-\\2-\\1') AS DATE) END AS dt,
           try_cast(nullif(regexp_extract(t, '(?:^|{W})((?:19|20)[0-9]{{2}})(?:$|{W})', 1), '') AS INTEGER) AS y FROM d)
       SELECT post_id, rule, CASE WHEN dt IS NOT NULL THEN dt <= DATE '2024-06-01' WHEN y IS NOT NULL THEN y <= 2026 ELSE regexp_matches(t, '(^|{W})(hace\\s+[0-9]+\\s+(días?|meses?|años?)|en\\s+(el\\s+)?[0-9]{{4}})($|{W})', 'i') END AS plausible,
         CASE WHEN dt > DATE '2024-06-01' THEN 'Fecha futura: ' || strftime(dt, '%d/%m/%Y') WHEN dt IS NOT NULL THEN 'Fecha plausible: ' || strftime(dt, '%d/%m/%Y')
          WHEN y > 2026 THEN 'Año improbable: ' || y WHEN y IS NOT NULL THEN 'Año plausible: ' || y
          WHEN regexp_matches(t, '(^|{W})(hace\\s+[0-9]+\\s+(días?|meses?|años?)|en\\s+(el\\s+)?[0-9]{{4}})($|{W})', 'i') THEN 'Tiempo relativo plausible'
          ELSE 'No se pudo verificar información temporal' END AS temporal_note,
         CAST(coalesce(dt, make_date(y, 1, 1)) AS VARCHAR) AS verified_date FROM e""",
)
def temporal(v):
    return O.temporal_check(O.contextual_claims(v.texts), as_of()).select(
        "post_id", "rule", "plausible", "temporal_note", F.col("verified_date").cast("string").alias("verified_date")
    )


STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
WORD = "[0-9A-Za-zÀ-ÖØ-öø-ÿ_]"


def words_sql(col, n):
    """Word runs of n or more characters of the lower-cased text without links."""
    return f"list_filter(regexp_split_to_array(lower(regexp_replace({col}, 'https?://\\S+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= {n})"


@query(
    "E9_claim_queries",
    f"""WITH {TOP}, k AS (SELECT post_id, rn - 1 AS claim_no, claim_type, extracted_value AS val, claim_text, {words_sql('claim_text', 3)} AS w FROM top WHERE rn <= 3),
       k2 AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i AND x NOT IN ({STOP})) AS u FROM k),
       k3 AS (SELECT *, array_to_string(u[1:5], ' ') AS ctx FROM k2),
       r AS (SELECT post_id, claim_no, 0 AS template_no, '"' || val || '" ' || ctx AS q FROM k3 WHERE val <> ''
         UNION ALL SELECT post_id, claim_no, 1, ctx || CASE claim_type WHEN 'numerical' THEN ' datos estadísticas' ELSE ' fecha verificación' END FROM k3
         UNION ALL SELECT post_id, claim_no, 2, val || CASE claim_type WHEN 'numerical' THEN ' verificación comprobación' ELSE ' acontecimiento histórico' END FROM k3 WHERE val <> ''),
       z AS (SELECT post_id, claim_no, template_no, array_to_string(string_split(trim(regexp_replace(q, '\\s+', ' ', 'g')), ' ')[1:10], ' ') AS query FROM r WHERE length(trim(regexp_replace(q, '\\s+', ' ', 'g'))) >= 5)
       SELECT post_id, query, CAST(claim_no AS INTEGER) AS claim_no, template_no FROM (SELECT *, row_number() OVER (PARTITION BY post_id, query ORDER BY claim_no, template_no) AS o FROM z WHERE query LIKE '% %') y WHERE o = 1""",
)
def queries(v):
    return O.claim_queries(O.top_claims(scored(v), 3))


KEY_TERMS = f"""kt AS (SELECT post_id, term, freq, row_number() OVER (PARTITION BY post_id ORDER BY freq DESC, term) - 1 AS term_no FROM (
   SELECT post_id, term, count(*) AS freq FROM (SELECT post_id, unnest({words_sql('content', 4)}) AS term FROM posts) x WHERE term NOT IN ({STOP}) GROUP BY post_id, term) y)"""


@query("E10_key_terms", f"WITH {KEY_TERMS} SELECT post_id, CAST(term_no AS INTEGER) AS term_no, term, freq FROM kt WHERE term_no < 8")
def key_terms(v):
    return O.key_terms(v.texts)


@query(
    "E11_fallback_queries",
    f"""WITH {KEY_TERMS}, k AS (SELECT * FROM kt WHERE term_no < 8),
       p AS (SELECT a.post_id, '"' || a.term || '" "' || b.term || '" verificación' AS q, a.term_no * 100 + b.term_no AS o FROM k a JOIN k b ON b.post_id = a.post_id AND a.term_no < b.term_no
         UNION ALL SELECT post_id, string_agg(term, ' ' ORDER BY term_no) FILTER (WHERE term_no < 3) || s.suffix, 10000 + s.i FROM k CROSS JOIN
           (SELECT ' desmentido' AS suffix, 1 AS i UNION ALL SELECT ' comprobación', 2 UNION ALL SELECT ' evidencia', 3) s GROUP BY post_id, s.suffix, s.i),
       o AS (SELECT post_id, q, row_number() OVER (PARTITION BY post_id ORDER BY o) - 1 AS query_no FROM p)
       SELECT post_id, CAST(query_no AS INTEGER) AS query_no, q AS query FROM o WHERE query_no < 5""",
)
def fallback(v):
    return O.fallback_queries(O.key_terms(v.texts))


@query(
    "E12_claim_topic",
    "SELECT post_id, CASE " + " ".join(f"WHEN {has('content', w)} THEN '{t}'" for t, w in R.TOPICS) + " ELSE 'general' END AS topic FROM posts",
)
def topic(v):
    return v.texts.select("post_id", O.claim_topic(F.col("content")).alias("topic"))


EVENTS_TEXT = """et AS (SELECT post_id, concat(content, CASE post_num % 6 WHEN 0 THEN ' Ingresa en prisión Ábalos' WHEN 1 THEN ' La jueza cita a Sánchez'
   WHEN 2 THEN ' Detenido Juan Pérez' WHEN 3 THEN ' Montero ha dimitido' ELSE '' END) AS content FROM posts)"""


def event_posts(v):
    tail = F.expr(
        "CASE post_num % 6 WHEN 0 THEN ' Ingresa en prisión Ábalos' WHEN 1 THEN ' La jueza cita a Sánchez' "
        "WHEN 2 THEN ' Detenido Juan Pérez' WHEN 3 THEN ' Montero ha dimitido' ELSE '' END"
    )
    return v.posts.withColumn("content", F.concat("content", tail))


FIRST_FIGURE = "CASE " + " ".join(f"WHEN contains(lower(content), '{f}') THEN '{f}'" for f in R.FIGURES)


@query(
    "E13_arrest_claims",
    f"WITH {EVENTS_TEXT} SELECT post_id, {FIRST_FIGURE} END AS person_name, 'arrest' AS event_type FROM et "
    f"WHERE {has('content', R.ARREST_WORDS)} AND {has('content', R.FIGURES)}",
)
def arrests(v):
    return O.arrest_claims(event_posts(v)).select("post_id", "person_name", "event_type")


@query(
    "E14_parse_events",
    f"WITH {EVENTS_TEXT} SELECT post_id, {FIRST_FIGURE} ELSE 'desconocido' END AS judicial_person, CASE "
    + " ".join(f"WHEN {has('content', w)} THEN '{n}'" for n, w in R.JUDICIAL_TYPES)
    + " ELSE 'judicial_event' END AS judicial_type, coalesce(nullif(regexp_extract(content, '([A-ZÁ-Ú][a-zá-úñ]+(?:\\s+[A-ZÁ-Ú][a-zá-úñ]+)*)', 1), ''), 'desconocido') AS event_person, CASE "
    + " ".join(f"WHEN {has('content', w)} THEN '{n}'" for n, w in R.EVENT_TYPES)
    + " ELSE 'political_event' END AS event_type FROM et",
)
def events(v):
    return O.parse_events(event_posts(v))
