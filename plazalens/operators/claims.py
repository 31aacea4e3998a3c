"""Claim extraction, scoring, parsing and search queries."""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalens.functions.spans import SpanRule, find_spans
from plazalens.functions.tables import ranked
from plazalens.functions.text import (
    FLAGS,
    blank_links_and_marks,
    contains_any,
    extract_or_null,
    first_contained,
    squeeze,
    strip,
    unicode_words,
)
from plazalens.rules import claims as R

PHASES = [*R.CLAIM_RULES, "contextual"]
NUMERICAL = FLAGS + "(?:" + "|".join(R.CLAIM_RULES["numerical"][1]) + ")"
TEMPORAL = FLAGS + "(?:" + "|".join(R.CLAIM_RULES["temporal"][1]) + ")"
FLOAT_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def to_float(col: Column) -> Column:
    return F.when(col.rlike(FLOAT_TEXT), col.try_cast("double"))


# -- extraction -------------------------------------------------------------


def extract_matches(posts: DataFrame) -> DataFrame:
    """Typed matches: (post_id, claim_type, rule, claim_text, context, extracted_value, start_pos, end_pos)."""
    rules = [
        SpanRule(kind, i, pattern, window, window)
        for kind, (window, patterns) in R.CLAIM_RULES.items()
        for i, pattern in enumerate(patterns)
    ]
    spans = find_spans(posts, ["post_id"], "content", rules)
    valued = F.col("kind").isin("numerical", "temporal")
    return spans.select(
        "post_id",
        F.col("kind").alias("claim_type"),
        F.col("kind").alias("phase"),
        F.col("rule_no").alias("rule"),
        F.col("matched").alias("claim_text"),
        "context",
        F.when(valued, F.col("matched")).alias("extracted_value"),
        "start_pos",
        "end_pos",
    )


def sentence_array(col: Column) -> Column:
    parts = F.split(strip(col), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def sentences(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", F.posexplode(sentence_array(F.col("content"))).alias("sentence_no", "sentence"))


def contextual_claims(posts: DataFrame) -> DataFrame:
    """Sentences that hold a number or a date, with the value and the primary type.

    Only posts with a digit can have one, so the others never reach the split.
    """
    rows = (
        posts.filter(F.col("content").rlike(r"(?U)\d"))
        .select("post_id", "content", F.posexplode(sentence_array(F.col("content"))).alias("sentence_no", "sentence"))
        .filter(F.col("sentence").rlike(r"(?U)\d"))
        .withColumn("_num", F.col("sentence").rlike(NUMERICAL))
        .withColumn("_temp", F.col("sentence").rlike(TEMPORAL))
        .filter(F.col("_num") | F.col("_temp"))
    )
    sentence = F.col("sentence")
    first = r"(?Us)^.*?(\d+(?:[.,]\d+)*)(.*)$"
    number = F.regexp_extract(sentence, first, 1)
    rest = F.lower(F.regexp_extract(sentence, first, 2))
    value = (
        F.when(contains_any(rest, ["millones", "million"]), F.concat(number, F.lit(" millones")))
        .when(contains_any(rest, ["billones", "billion"]), F.concat(number, F.lit(" billones")))
        .when(rest.contains("%"), F.concat(number, F.lit("%")))
        .otherwise(number)
    )
    numeric = F.when(F.col("_num") & (number != ""), value)
    year = extract_or_null(sentence, r"(?U)(\d{4})")
    dated = F.col("_temp") & year.isNotNull()
    both = dated & F.col("_num") & numeric.isNotNull()
    late = both & ~contains_any(sentence, R.NUMERIC_LEAD) & contains_any(sentence, R.TEMPORAL_LEAD)
    pure = dated & ~(F.col("_num") & numeric.isNotNull())
    start = F.instr(F.col("content"), sentence) - 1
    return rows.select(
        "post_id",
        F.when(late | pure, "temporal").otherwise("numerical").alias("claim_type"),
        F.lit("contextual").alias("phase"),
        F.col("sentence_no").alias("rule"),
        sentence.alias("claim_text"),
        sentence.alias("context"),
        F.when(late | pure, year).otherwise(numeric).alias("extracted_value"),
        start.cast("int").alias("start_pos"),
        (start + F.length(sentence)).cast("int").alias("end_pos"),
    )


def all_claims(posts: DataFrame) -> DataFrame:
    return extract_matches(posts).unionByName(contextual_claims(posts))


# -- scoring ----------------------------------------------------------------


def score_claims(claims: DataFrame, as_of: Column) -> DataFrame:
    """Add ``confidence`` and ``priority``; ``as_of`` gives the recent years."""
    text, context = F.col("claim_text"), F.col("context")
    this_year = F.year(as_of)
    recent = text.contains(this_year.cast("string")) | text.contains((this_year - 1).cast("string"))
    percent = text.contains("%")

    def pair(confidence: Column | float, priority: Column | int) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_col(confidence).cast("double").alias("c"), as_col(priority).cast("int").alias("p"))

    base = F.when(percent, pair(0.9, 9)).when(contains_any(text, R.BIG_NUMBERS), pair(0.95, 10)).otherwise(pair(0.8, 7))
    said = contains_any(context, R.STATISTICAL_CONTEXT).cast("int")
    numerical = pair(F.least(base["c"] + said * 0.1, F.lit(1.0)), F.least(base["p"] + said, F.lit(10)))

    temporal = (
        F.when(text.contains("/") | text.contains("-"), pair(0.9, 9)).when(recent, pair(0.85, 8)).otherwise(pair(0.7, 6))
    )
    attribution = F.when(contains_any(text, R.OFFICIAL_SOURCES), pair(0.8, 8)).otherwise(pair(0.6, 5))
    causal = F.when(contains_any(context, R.CAUSAL_EVIDENCE), pair(0.7, 6)).otherwise(pair(0.5, 4))

    figure, serious = contains_any(text, R.FIGURES), contains_any(text, R.SERIOUS_ACTIONS)
    vague = (~contains_any(text, R.LEGAL_SPECIFICS)).cast("int")
    legal_c = F.when(figure, 0.95).when(serious, 0.9).otherwise(0.8)
    legal = pair(F.greatest(legal_c - vague * 0.1, F.lit(0.0)), F.when(figure | serious, 10).otherwise(9))

    sourced = contains_any(context, R.SOURCED).cast("int")
    breaking = pair(
        F.greatest(F.when(figure, 0.95).otherwise(0.85) - sourced * 0.2, F.lit(0.0)),
        F.least(F.when(figure, 10).otherwise(9) - sourced, F.lit(10)),
    )

    start = (
        F.when(recent, pair(0.8, 8))
        .when(contains_any(text, R.ECONOMY_NUMBERS), pair(0.9, 10))
        .when(percent, pair(0.85, 9))
        .otherwise(pair(0.7, 6))
    )
    topic, official = contains_any(text, R.IMPORTANT_TOPICS), contains_any(text, R.OFFICIAL_CONTEXT).cast("int")
    lifted = F.when(topic, pair(F.greatest(start["c"], F.lit(0.85)), F.greatest(start["p"], F.lit(9)))).otherwise(start)
    contextual = pair(F.least(lifted["c"] + official * 0.1, F.lit(1.0)), F.least(lifted["p"] + official, F.lit(10)))

    phase = F.col("phase")
    score = (
        F.when(phase == "contextual", contextual)
        .when(phase == "numerical", numerical)
        .when(phase == "temporal", temporal)
        .when(phase == "attribution", attribution)
        .when(phase == "causal", causal)
        .when(phase == "legal_event", legal)
        .when(phase == "breaking_news", breaking)
    )
    scored = claims.withColumn("_s", score)
    return scored.withColumn("confidence", F.col("_s.c")).withColumn("priority", F.col("_s.p")).drop("_s")


def top_claims(claims: DataFrame, n: int = 5) -> DataFrame:
    """Best claims per post with ``claim_no`` from 0; ties keep the extraction order."""
    turn = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    order = [F.col("priority").desc(), F.col("confidence").desc(), turn, F.col("rule"), F.col("start_pos")]
    return ranked(claims, ["post_id"], order, n, "_no").withColumn("claim_no", F.col("_no") - 1).drop("_no")


# -- parsing ----------------------------------------------------------------


def parse_numbers(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of each claim text with unit and kind; unique (value, text), first kept."""
    rules = [SpanRule("number", i, p, 50, 50, after_start=True) for i, p in enumerate(R.NUMBER_RULES)]
    spans = find_spans(claims, keys, "claim_text", rules, strip=False).filter(~F.col("matched").rlike("(?U)" + R.BARE_YEAR))
    low = F.lower("context")
    unit = F.coalesce(*[F.when(low.rlike(FLAGS + p), F.lit(name)) for name, p in R.UNITS], F.lit("unknown"))
    kind = F.coalesce(*[F.when(contains_any(low, words), F.lit(name)) for name, words in R.NUMBER_KINDS], F.lit("general"))
    parsed = spans.withColumn("value", to_float(F.regexp_replace("matched", ",", ""))).filter(F.col("value").isNotNull())
    first = ranked(parsed, [*keys, "value", "matched"], [F.col("rule_no"), F.col("start_pos")], 1)
    numbered = ranked(first, keys, [F.col("rule_no"), F.col("start_pos")], 2**31 - 1, "number_no")
    return numbered.select(
        *keys, (F.col("number_no") - 1).alias("number_no"), F.col("matched").alias("number_text"), "value",
        unit.alias("unit"), kind.alias("number_kind"), "context",
    )


def parse_magnitude(col: Column, long_scale: bool = False) -> Column:
    """Number in front of the longest multiplier word, scaled; else the plain number; else null."""
    tries = []
    for word, factor in R.MULTIPLIERS:
        factor = R.LONG_SCALE.get(word, factor) if long_scale else factor
        before = F.regexp_extract(col, rf"(?iUs)^(.*?)\b{word}\b", 1)
        near = F.substring(before, F.greatest(F.length(before) - 19, F.lit(1)), F.lit(20))
        number = extract_or_null(near, r"(?U)(\d+(?:[.,]\d+)*)")
        hit = col.rlike(rf"(?iU)\b{word}\b") & number.isNotNull()
        tries.append((hit, to_float(F.regexp_replace(number, ",", "")) * F.lit(factor)))
    plain = to_float(F.regexp_replace(F.regexp_replace(col, "%", ""), r"(?U)[,\s]", ""))
    chain = F.when(tries[0][0], tries[0][1])
    for hit, scaled in tries[1:]:
        chain = chain.when(hit, scaled)
    return chain.otherwise(plain)


def temporal_check(claims: DataFrame, as_of: Column) -> DataFrame:
    """Add ``plausible``, ``temporal_note`` and ``verified_date``."""
    text = F.concat_ws(" ", "claim_text", F.coalesce("context", F.lit("")))
    day_first, year_first = "(?U)" + R.DAY_FIRST, "(?U)" + R.YEAR_FIRST

    def date(pattern: str, y: int, m: int, d: int) -> Column:
        joined = F.concat_ws("-", *[F.regexp_extract("_t", pattern, g) for g in (y, m, d)])
        return F.when(F.col("_t").rlike(pattern), F.try_to_timestamp(joined, F.lit("yyyy-M-d")))

    rows = claims.withColumn("_t", text)
    rows = rows.withColumn("_d", F.coalesce(date(day_first, 3, 2, 1), date(year_first, 1, 2, 3)))
    rows = rows.withColumn("_y", extract_or_null(F.col("_t"), "(?U)" + R.ANY_YEAR).cast("int"))
    shown = F.date_format("_d", "dd/MM/yyyy")
    far = F.col("_y") > F.year(as_of) + 2
    relative = F.col("_t").rlike(FLAGS + R.RELATIVE_TIME)
    note = (
        F.when(F.col("_d") > as_of, F.concat(F.lit("Fecha futura: "), shown))
        .when(F.col("_d").isNotNull(), F.concat(F.lit("Fecha plausible: "), shown))
        .when(far, F.concat(F.lit("Año improbable: "), F.col("_y").cast("string")))
        .when(F.col("_y").isNotNull(), F.concat(F.lit("Año plausible: "), F.col("_y").cast("string")))
        .when(relative, F.lit("Tiempo relativo plausible"))
        .otherwise(F.lit("No se pudo verificar información temporal"))
    )
    ok = (
        F.when(F.col("_d").isNotNull(), F.col("_d") <= as_of)
        .when(F.col("_y").isNotNull(), ~far)
        .otherwise(relative)
    )
    day = F.coalesce(F.to_date("_d"), F.make_date("_y", F.lit(1), F.lit(1)))
    return (
        rows.withColumn("plausible", ok).withColumn("temporal_note", note).withColumn("verified_date", day).drop("_t", "_d", "_y")
    )


# -- queries ----------------------------------------------------------------


def terms(col: Column, min_length: int) -> Column:
    words = unicode_words(blank_links_and_marks(col), min_length)
    return F.array_except(words, F.array(*[F.lit(w) for w in R.STOPWORDS]))


def clean_query(col: Column) -> Column:
    """Squeezed query of at most ten words; '' below five characters."""
    tidy = squeeze(col)
    return F.when(F.length(tidy) < 5, "").otherwise(F.array_join(F.slice(F.split(tidy, " "), 1, 10), " "))


def claim_queries(claims: DataFrame, per_claim: int = 3) -> DataFrame:
    """Search queries per post in claim order, each query once; claims carry ``claim_no``."""
    context = F.array_join(F.slice(terms(F.col("context"), 3), 1, 5), " ")
    value = F.when(F.coalesce("extracted_value", F.lit("")) != "", F.col("extracted_value"))

    def filled(template: str) -> Column:
        parts, rest = [], template
        while rest:
            spots = [(rest.find(k), k) for k in ("{value}", "{context}") if k in rest]
            if not spots:
                parts.append(F.lit(rest))
                break
            at, key = min(spots)
            if at:
                parts.append(F.lit(rest[:at]))
            parts.append(value if key == "{value}" else context)
            rest = rest[at + len(key):]
        return F.concat(*parts)  # null when a needed value is missing

    default = F.array(*[filled(t) for t in R.DEFAULT_TEMPLATES[:per_claim]])
    built = default
    for kind, templates in R.QUERY_TEMPLATES.items():
        built = F.when(F.col("claim_type") == kind, F.array(*[filled(t) for t in templates[:per_claim]])).otherwise(built)
    rows = (
        claims.select("post_id", "claim_no", F.posexplode(built).alias("template_no", "raw"))
        .withColumn("query", clean_query(F.col("raw")))
        .filter(F.size(F.split("query", " ")) >= 2)
    )
    first = rows.groupBy("post_id", "query").agg(F.min(F.struct("claim_no", "template_no")).alias("_at"))
    return first.select("post_id", "query", F.col("_at.claim_no").alias("claim_no"), F.col("_at.template_no").alias("template_no"))


def key_terms(posts: DataFrame, n: int | None = 8) -> DataFrame:
    """Most frequent words of at least four letters per post: (post_id, term_no, term, freq).

    A post is one row, so its words are counted there; nothing is shuffled.
    """
    stop = frozenset(R.STOPWORDS)

    @F.pandas_udf("array<struct<term:string,freq:bigint>>")
    def most_frequent(words: pd.Series) -> pd.Series:
        counts = (Counter(w for w in ([] if row is None else row) if w not in stop) for row in words)
        return pd.Series([[{"term": t, "freq": c} for t, c in heapq.nsmallest(len(k) if n is None else n, k.items(), key=lambda x: (-x[1], x[0]))] for k in counts])

    words = unicode_words(blank_links_and_marks(F.col("content")), 4)
    return posts.select("post_id", F.posexplode(most_frequent(words)).alias("term_no", "t")).select("post_id", "term_no", "t.term", "t.freq")


def fallback_queries(key_terms_: DataFrame, n: int = 5) -> DataFrame:
    """Queries from the key terms: word pairs in order, then three suffix forms; first ``n``."""
    # At most eight terms per post.
    per_post = key_terms_.groupBy("post_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("term_no", "term"))), lambda x: x["term"]).alias("t")
    )
    pairs = F.expr(
        "flatten(transform(t, (a, i) -> transform(slice(t, i + 2, size(t)), "
        f"b -> concat('\"', a, '\" \"', b, '\" {R.PAIR_QUERY_SUFFIX}'))))"
    )
    lead = F.array_join(F.slice("t", 1, 3), " ")
    suffixes = F.array(*[F.concat(lead, F.lit(" " + s)) for s in R.FALLBACK_SUFFIXES])
    cleaned = F.transform(F.slice(F.concat(pairs, suffixes), 1, n), lambda q: clean_query(q))
    unique = F.array_distinct(F.filter(cleaned, lambda q: q != ""))
    return per_post.select("post_id", F.posexplode(unique).alias("query_no", "query"))


def claim_topic(col: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(col, words), F.lit(t)) for t, words in R.TOPICS], F.lit(R.OTHER_TOPIC))


def arrest_claims(posts: DataFrame) -> DataFrame:
    """Posts that claim an arrest of a listed figure."""
    hit = posts.filter(contains_any(F.col("content"), R.ARREST_WORDS) & contains_any(F.col("content"), R.FIGURES))
    return hit.select(
        "post_id",
        first_contained(F.col("content"), R.FIGURES).alias("person_name"),
        F.lit("arrest").alias("event_type"),
        F.col("content").alias("context"),
    )


def _first_rule(col: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    return F.coalesce(*[F.when(contains_any(col, words), F.lit(name)) for name, words in rules], F.lit(default))


def parse_events(posts: DataFrame) -> DataFrame:
    """Judicial reading (listed figure) and event reading (first capitalised name) of a text."""
    text = F.col("content")
    return posts.select(
        "post_id",
        F.coalesce(first_contained(text, R.FIGURES), F.lit(R.UNKNOWN_PERSON)).alias("judicial_person"),
        _first_rule(text, R.JUDICIAL_TYPES, "judicial_event").alias("judicial_type"),
        F.coalesce(extract_or_null(text, "(?U)" + R.CAPITALISED_NAME), F.lit(R.UNKNOWN_PERSON)).alias("event_person"),
        _first_rule(text, R.EVENT_TYPES, "political_event").alias("event_type"),
    )
