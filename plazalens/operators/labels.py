"""Labelling, enrichment, display columns, model scoring and bulk HTML parsing."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plazalens.functions import dom
from plazalens.functions import posts as C
from plazalens.functions.anchors import merged
from plazalens.functions.joins import BLANK, holding, tokens_of
from plazalens.functions.literals import Group, seen
from plazalens.functions.spans import SpanRule, find_spans
from plazalens.functions.tables import ranked
from plazalens.functions.text import any_of, contains_any, extract_or_null, first_contained, folded, found_in_order, strip, with_lower
from plazalens.rules import categories as R
from plazalens.rules import phrases as P
from plazalens.session import durable

# -- rule labelling ---------------------------------------------------------


def folded_pattern(rules: list[str]) -> str:
    """The rules as one expression for folded text (see ``folded``). Lower-case rules
    need no case folding, and the leading word boundary is tested once for all."""
    lowered = [f"(?iu:{r})" if re.search(r"\\[A-Z]", r) else r.lower() for r in rules]
    bounded = [r[2:] for r in lowered if r.startswith(r"\b")]
    parts = [r for r in lowered if not r.startswith(r"\b")]
    if bounded:
        parts.append(r"\b(?:" + "|".join(bounded) + ")")
    return "(?Ud)" + "|".join(parts)


def _rule_groups(rules: dict[str, list[str]], group: int) -> list[tuple[str, list[str], Group]]:
    """(category, rules, literals): groups of rules with what every match of one must hold; no literals
    where none can be derived."""
    out = []
    for category, patterns in rules.items():
        for at in range(0, len(patterns), group):
            part = patterns[at : at + group]
            need = merged(part)
            out.append((category, part, (need.heads, need.parts)))
    return out


def literals_seen(content: Column, rules: dict[str, list[str]] | None = None, entities: list[tuple[str, str]] | None = None, group: int = 3) -> Column:
    """What one automaton over the rules' literals and the names finds in a text (see ``seen``)."""
    groups = [literals for _, _, literals in _rule_groups(R.LABEL_RULES if rules is None else rules, group)]
    return seen(F.lower(content), groups, [name for _, name in (R.ENTITIES if entities is None else entities)])


def detected_categories(content: Column, rules: dict[str, list[str]] | None = None, group: int = 3, found: Column | None = None) -> Column:
    """Categories with at least one hit, in rule order; short texts have none.

    A group of rules is tried only where the automaton saw one of its literals (``found``), which most texts
    do not have; the test is a necessary condition and changes no result. The lower-cased text is bound by a lambda:
    wherever Catalyst moves the expression, it is computed once per row.
    """
    rules = rules or R.LABEL_RULES
    fired = (literals_seen(content, rules, [], group) if found is None else found)["groups"]
    tests: dict[str, list] = {c: [] for c in rules}
    for k, (category, part, literals) in enumerate(_rule_groups(rules, group)):
        tests[category].append((k, folded_pattern(part), any(literals)))

    def hits(bound: Column) -> Column:
        def hit(k: int, pattern: str, needs: bool) -> Column:
            test = bound["low"].rlike(pattern)
            return F.coalesce(F.array_contains(bound["fired"], k), F.lit(False)) & test if needs else test

        return F.array_compact(F.array(*[F.when(any_of(hit(*t) for t in found), F.lit(c)) for c, found in tests.items()]))

    detected = F.transform(F.array(F.struct(folded(content).alias("low"), fired.alias("fired"))), hits)[0]
    none = F.array().cast("array<string>")
    if all(needs for found in tests.values() for _, _, needs in found):
        detected = F.when(fired.isNotNull(), detected).otherwise(none)
    return F.when(F.length(strip(content)) >= 5, detected).otherwise(none)


def with_categories(posts: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    return posts.withColumn("categories", detected_categories(F.col("content"), rules))


def primary_category(categories: Column) -> Column:
    return F.coalesce(F.try_element_at(categories, F.lit(1)), F.lit(R.NO_MATCH))


def category_keywords(categories: Column) -> Column:
    """Sorted union of the keywords configured for the categories."""
    lists = [
        F.when(F.array_contains(categories, c), F.array(*[F.lit(k) for k in words])).otherwise(F.array().cast("array<string>"))
        for c, words in R.CATEGORY_KEYWORDS.items()
    ]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))


def entity_tags(content: Column, entities: list[tuple[str, str]] | None = None, limit: int | None = None, found: Column | None = None) -> Column:
    """`kind:name` of the listed entities on word boundaries, in list order, or the first ``limit``.

    The automaton finds all names in one pass, however many there are.
    """
    entities = R.ENTITIES if entities is None else entities
    places = (seen(F.lower(content), [], [name for _, name in entities]) if found is None else found)["names"]
    tags = F.array(*[F.lit(f"{kind}:{name}") for kind, name in entities]).cast("array<string>")
    named = F.coalesce(F.transform(places, lambda k: F.get(tags, k)), F.array().cast("array<string>"))
    return named if limit is None else F.slice(named, 1, limit)


def label(posts: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Add categories, primary category, keywords and entity tags. Works on streams."""
    found = F.col("_seen")
    return (
        posts.withColumn("_seen", literals_seen(F.col("content"), rules))
        .withColumn("categories", detected_categories(F.col("content"), rules, found=found))
        .withColumn("entities", entity_tags(F.col("content"), found=found))
        .drop("_seen")
        .withColumn("primary_category", primary_category(F.col("categories")))
        .withColumn("keywords", category_keywords(F.col("categories")))
        .select(*posts.columns, "categories", "primary_category", "keywords", "entities")
    )


def label_matches(posts: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Every rule hit with text, description and 20 characters around it.

    Posts without any category are dropped on the JVM side before the span pass.
    """
    rules = rules or R.LABEL_RULES
    hit = with_categories(posts.select("post_id", "content"), rules).filter(F.size("categories") > 0)
    spans = [SpanRule(c, i, p, 20, 20) for c, patterns in rules.items() for i, p in enumerate(patterns)]
    found = find_spans(hit, ["post_id"], "content", spans, on_lower=True)
    described = F.coalesce(*[F.when(F.col("kind") == c, F.lit(d)) for c, d in R.CATEGORY_DESCRIPTIONS.items()], F.lit(""))
    return found.select(
        "post_id", F.col("kind").alias("category"), "rule_no", "matched", described.alias("description"), "start_pos", "end_pos", "context"
    )


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    """NFKD, lower case, NFC. Spark has no built-in decomposition."""
    return text.str.normalize("NFKD").str.lower().str.normalize("NFC")


def normalize(col: str) -> Column:
    """NFKD, lower case, NFC; null becomes ''. ASCII texts stay in the JVM."""
    text = F.coalesce(F.col(col), F.lit(""))
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_decomposed(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


# -- conclusions and triggers -----------------------------------------------


def concludes_disinfo(explanation: Column) -> Column:
    return ~contains_any(explanation, P.LOCAL_NEGATIVE) & contains_any(explanation, P.LOCAL_POSITIVE)


def external_disinfo(explanation: Column) -> Column:
    return contains_any(explanation, P.EXTERNAL_POSITIVE)


def needs_verification(posts: DataFrame, claims: DataFrame, min_claims: int = 1) -> DataFrame:
    """Decide with reason from (post_id, content, category, confidence) and the claims."""
    counts = (
        claims.filter(F.col("claim_type").isin(P.TRIGGER_CLAIM_TYPES)).groupBy("post_id").agg(F.count("*").alias("_claims"))
    )
    found = found_in_order(F.col("content"), P.TRIGGER_KEYWORDS)
    by_category = F.coalesce(F.col("category").isin(P.TRIGGER_CATEGORIES), F.lit(False))
    confident = F.coalesce(F.col("confidence"), F.lit(0.0)) >= P.TRIGGER_CONFIDENCE
    n = F.coalesce("_claims", F.lit(0))
    reason = (
        F.when(by_category, F.concat(F.lit("Categoría de contenido: "), "category"))
        .when(confident, F.concat(F.lit("Confianza del analizador: "), F.format_number("confidence", 2)))
        .when(F.size("_found") > 0, F.concat(F.lit("Palabras clave encontradas: "), F.array_join(F.slice("_found", 1, 3), ", ")))
        .when(n >= min_claims, F.concat(F.lit("Afirmaciones verificables encontradas: "), n.cast("string")))
    )
    return (
        posts.join(counts, "post_id", "left")
        .withColumn("_found", found)
        .withColumn("_reason", reason)
        .withColumn("triggered", F.col("_reason").isNotNull())
        .withColumn("reason", F.coalesce("_reason", F.lit(P.NO_TRIGGER)))
        .drop("_reason", "_found", "_claims")
    )


# -- model replies ----------------------------------------------------------


def clean_label(reply: Column) -> Column:
    """Struct (category, error) of a model's label reply."""
    low = F.lower(strip(reply))
    bare = strip(F.regexp_replace(low, P.LEAD_IN, ""))
    category = F.when(bare.isin(R.CATEGORIES), bare).otherwise(first_contained(bare, R.CATEGORIES))
    error = F.when(category.isNull(), F.concat(F.lit("LLM returned invalid category: "), strip(reply)))
    return F.struct(category.alias("category"), error.alias("error"))


def parse_reply(reply: Column) -> Column:
    """Struct (category, explanation) of a structured external reply."""
    trimmed = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    lines = F.split(trimmed, "\n")
    marks = ("CATEGORÍA:", "CATEGORY:")

    def is_category(line: Column) -> Column:
        return any_of(F.upper(line).startswith(m) for m in marks)

    def after_colon(line: Column) -> Column:
        return strip(F.regexp_replace(line, r"(?s)^[^:]*:", ""))

    stripped = F.transform(lines, lambda s: strip(s))
    at = F.array_position(F.transform(stripped, lambda s: F.upper(s).startswith("EXPLICACIÓN:")), True)
    head = F.when(at > 0, F.slice(stripped, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(stripped)
    category = F.lower(after_colon(F.try_element_at(F.filter(head, is_category), F.lit(-1))))
    rest = F.filter(lines, lambda s: ~is_category(s))
    text = F.when(at > 0, after_colon(F.try_element_at(stripped, at.cast("int")))).otherwise(
        F.when(F.size(rest) > 0, strip(F.array_join(rest, " "))).otherwise(reply)
    )
    blank = F.coalesce(trimmed, F.lit("")) == ""
    explanation = (
        F.when(blank, P.NO_EXTERNAL).when(F.length(strip(text)) < 10, P.EXTERNAL_DONE).otherwise(text)
    )
    return F.struct(F.when(~blank, category).alias("category"), explanation.alias("explanation"))


def labels_from_scores(scores: Column) -> Column:
    """Labels of an array<struct<label, score>>; null or empty gives an empty list."""

    def best(words: list[str]) -> Column:
        kept = F.filter(scores, lambda x: any_of(F.lower(x["label"]).contains(w) for w in words))
        return F.greatest(F.coalesce(F.array_max(F.transform(kept, lambda x: x["score"])), F.lit(0.0)), F.lit(0.0))

    hate, toxic, positive = best(P.HATE_LABELS), best(P.TOXIC_LABELS), best(P.POSITIVE_LABELS)
    found = F.array_compact(
        F.array(
            F.when(hate > 0.3, "hate_speech"),
            F.when(toxic > 0.3, "toxic_content"),
            F.when((F.greatest(hate, toxic) < 0.3) & (positive > 0.6), "normal_content"),
        )
    )
    none = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, none)
        .when(F.size(found) > 0, found)
        .otherwise(F.array(F.lit("general")))
    )


def keyword_category(text: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(c)) for c, words in P.KEYWORD_CATEGORY])


def error_class(message: Column) -> Column:
    """Struct (error_class, recoverable, retry_delay); the first rule wins."""

    def row(name: str, recoverable: bool, delay: int | None) -> Column:
        return F.struct(
            F.lit(name).alias("error_class"), F.lit(recoverable).alias("recoverable"), F.lit(delay).cast("int").alias("retry_delay")
        )

    chain = F.when(contains_any(message, ["timeout"]), row("timeout_error", True, 5)).when(
        contains_any(message, P.NETWORK_WORDS), row("network_error", True, 2)
    )
    for name, words, recoverable, delay in P.ERROR_CLASSES:
        chain = chain.when(contains_any(message, words), row(name, recoverable, delay))
    return chain.otherwise(row("unknown_error", False, None))


def classify_errors(df: DataFrame, message: str = "error_message") -> DataFrame:
    return df.withColumn("_e", error_class(F.col(message))).select(*df.columns, "_e.*")


# -- fact-check texts -------------------------------------------------------


def topic_tags(text: Column, source: str) -> Column:
    def found(low: Column) -> Column:
        lists = [
            F.when(any_of(low.contains(w) for w in words), F.array(*[F.lit(t) for t in tags])).otherwise(F.array().cast("array<string>"))
            for words, tags in P.SOURCE_TAGS[source]
        ]
        return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))

    return with_lower(text, found)


def _verdict(text: Column, rules: list[tuple[str, float, list[str]]]) -> Column:
    def row(verdict: str, confidence: float) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"))

    chain = F.when(F.lit(False), row(*P.NO_VERDICT))
    for verdict, confidence, words in rules:
        chain = chain.when(contains_any(text, words), row(verdict, confidence))
    return chain.otherwise(row(*P.NO_VERDICT))


def normalize_verdict(text: Column) -> Column:
    return _verdict(text, P.VERDICT_WORDS)


def infer_verdict(title: Column, excerpt: Column, source: str) -> Column:
    return _verdict(F.concat_ws(" ", title, excerpt), P.SOURCE_VERDICTS[source])


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of every query with their repeats; text, number of words and topic family per query."""
    parts = F.filter(F.split(F.lower("query"), BLANK), lambda w: w != "")
    words = queries.select("query_id", F.explode(parts).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("_times"))
    low = F.lower("query")
    family = F.coalesce(*[F.when(contains_any(low, asks), F.lit(i)) for i, (asks, _) in enumerate(P.TOPIC_FAMILIES)])
    return words, queries.select("query_id", F.size(parts).alias("_total"), family.alias("family"))


def _families(text: Column) -> Column:
    """Numbers of the topic families a text covers."""
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(i)) for i, (_, words) in enumerate(P.TOPIC_FAMILIES)]))


def _bodies(articles: DataFrame, *others: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", "description"))
    return articles.select("article_id", *others, text.alias("_text")).filter(strip(F.col("_text")) != "")


#: Queries and articles that meet in one group.
ASKED_BLOCK, HELD_BLOCK = 8192, 2048
#: Distinct query words looked for in one pass over the articles, words of a slice of them, and queries of a batch of results.
WORDS_PASS, WORDS_SLICE, ASKED_BATCH = 1 << 16, 1 << 13, 32
#: Takes the place of a word where a block's article ids are; families are words with a blank, too.
IDS = "  "


def _family_word(family: int) -> str:
    return f" {family}"


def _holding_bits(words: Broadcast, part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(article_id, _part, bits): which words of a part each article holds, as substrings of what blanks part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = words.value[part]
        machine = ahocorasick.Automaton()
        for k, word in enumerate(listed):
            if word[0] != " ":
                machine.add_word(word, k)
        if len(machine):
            machine.make_automaton()
        family = {int(word): k for k, word in enumerate(listed) if word[0] == " "}
        known: dict[str, tuple[int, ...]] = {}

        def inside(token: str) -> tuple[int, ...]:
            held = tuple([k for _, k in machine.iter(token)])
            if len(token) < 64:
                if len(known) >= 1 << 17:
                    known.clear()
                known[token] = held
            return held

        for batch in batches:
            rows, bits = [], []
            for i, (text, covers) in enumerate(zip(batch["_text"].to_pylist(), batch["_covers"].to_pylist(), strict=True)):
                found = {family[f] for f in covers if f in family}
                if len(machine):
                    # No query word has one of these three, so it lies within a piece.
                    for token in set(text.replace("\n", " ").replace("\t", " ").split(" ")):
                        held = known.get(token)
                        found.update(inside(token) if held is None else held)
                if found:
                    flags = np.zeros(len(listed), bool)
                    flags[list(found)] = True
                    rows.append(i)
                    bits.append(np.packbits(flags).tobytes().rstrip(b"\0"))
            ids = batch["article_id"].take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([part] * len(rows), pa.int32()), pa.array(bits, pa.binary())], ["article_id", "_part", "bits"])

    return run


def _turned(words: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """(word, _held, bits, ids): for every word of a block's articles which of them hold it, and a row with their ids."""

    def run(rows: pa.Table) -> pa.Table:
        held = rows["article_id"].combine_chunks().dictionary_encode()
        places, n = held.indices.to_numpy(), len(held.dictionary)
        found, bits = [], []
        packed, parts = rows["bits"].to_pylist(), rows["_part"].to_numpy()
        for part in np.unique(parts).tolist():
            listed = words.value[part]
            own = np.flatnonzero(parts == part).tolist()
            for start in range(0, len(listed), WORDS_SLICE):
                lines = np.zeros((n, WORDS_SLICE // 8), "uint8")
                for i in own:
                    line = np.frombuffer(packed[i], "uint8")[start // 8:(start + WORDS_SLICE) // 8]
                    lines[places[i], :len(line)] |= line
                turned = np.packbits(np.ascontiguousarray(np.unpackbits(lines, axis=1).T), axis=1)
                for k in np.flatnonzero(turned.any(axis=1)).tolist():
                    found.append(listed[start + k])
                    bits.append(turned[k].tobytes())
        block = pa.array([rows["_held"][0].as_py()] * (len(found) + 1), pa.int32())
        ids = pa.concat_arrays([pa.nulls(len(found), pa.list_(held.dictionary.type)), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held.dictionary)])
        return pa.table({"word": pa.array([*found, IDS], pa.string()), "_held": block, "bits": pa.array([*bits, None], pa.binary()), "ids": ids})

    return run


@lru_cache(maxsize=1 << 16)
def _share(n: int, total: int, digits: int | None) -> float:
    """n / total, 1 at most, rounded as Spark rounds a double."""
    share = min(n / total, 1.0)
    return share if digits is None else float(Decimal(repr(share)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _meeting(digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every pair of a block of queries and a block of articles, a few queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        word = rows["word"].combine_chunks()
        lists = rows.filter(pc.and_kleene(word.is_valid(), pc.not_equal(word, IDS)))
        marks = rows.filter(pc.equal(word, IDS))
        asked = rows.filter(word.is_null())
        if not marks.num_rows or not asked.num_rows or not lists.num_rows:
            return
        ids = marks["ids"].combine_chunks().flatten()
        held = np.unpackbits(np.frombuffer(b"".join(lists["bits"].to_pylist()), "uint8").reshape(lists.num_rows, -1), axis=1, count=len(ids))
        places = np.tile(np.arange(len(ids), dtype="int32"), ASKED_BATCH)
        row = {w: i for i, w in enumerate(lists["word"].to_pylist())}
        queries, totals = asked["query_id"].combine_chunks(), asked["_total"].to_pylist()
        texts = list(zip(asked["words"].to_pylist(), asked["times"].to_pylist(), strict=True))
        for start in range(0, len(texts), ASKED_BATCH):
            some = texts[start:start + ASKED_BATCH]
            most = [sum(times) for _, times in some]
            # The widest count decides; families count nothing.
            n = np.zeros((len(some), len(ids)), np.min_scalar_type(max(most)))
            hit = np.zeros(n.shape, bool)
            for q, (words, times) in enumerate(some):
                for w, t in zip(words, times, strict=True):
                    at = row.get(w)
                    if at is None:
                        continue
                    if t:
                        n[q] += held[at] if t == 1 else held[at] * n.dtype.type(t)
                    else:
                        hit[q] |= held[at].view(bool)
            hit |= n > 0
            counts = hit.sum(axis=1)
            shares = np.empty(n.shape)
            for q, (m, total) in enumerate(zip(most, totals[start:start + ASKED_BATCH], strict=True)):
                np.take(np.array([_share(k, total, digits) for k in range(m + 1)]), n[q], out=shares[q])
            of = pa.array(np.repeat(np.arange(start, start + len(some), dtype="int32"), counts))
            pairs = np.flatnonzero(hit)
            at = pa.array(places[:hit.size].take(pairs))
            yield pa.RecordBatch.from_arrays([queries.take(of), ids.take(at), pa.array(shares.ravel().take(pairs))], ["query_id", "article_id", "relevance"])

    return run


def relevant_articles(queries: DataFrame, articles: DataFrame, digits: int | None = None) -> DataFrame:
    """(query_id, article_id, relevance): articles that hold a query word as a substring,
    or words of the query's topic family. Relevance is the share of the query's words
    (repeats included) that the article holds, rounded to ``digits`` where given: each value once, not once a pair.

    The result has a row for every such pair; searches that keep a few articles use
    ``top_articles`` or ``first_articles``, which never build it. An article's text is scanned once for each WORDS_PASS
    distinct query words (which reach the driver and the workers); what it holds is a bit for each word. Blocks of
    queries meet blocks of articles: a bit for each word of the queries and article is shuffled, and no pair.
    """
    spark = queries.sparkSession
    queries = durable(queries.select("query_id", "query"))
    wanted, totals = _asked(queries)
    bodies = _bodies(articles).filter(F.col("article_id").isNotNull()).withColumn("_covers", _families(F.col("_text")))
    listed = [_family_word(i) for i in range(len(P.TOPIC_FAMILIES))] + [r.word for r in wanted.select("word").distinct().toLocalIterator()]
    words = spark.sparkContext.broadcast([listed[i:i + WORDS_PASS] for i in range(0, len(listed), WORDS_PASS)])
    n_asked, n_held = (max(1, -(-df.count() // size)) for df, size in ((queries, ASKED_BLOCK), (articles, HELD_BLOCK)))
    # Small tables are cut finer, so that every core has pairs to make.
    n_asked = max(n_asked, min(-(-2 * spark.sparkContext.defaultParallelism // n_held), 64))

    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    id_type = articles.schema["article_id"].dataType.simpleString()
    holders = reduce(
        DataFrame.unionByName,
        [bodies.mapInArrow(_holding_bits(words, i), f"article_id {id_type}, _part int, bits binary") for i in range(len(words.value))],
    ).withColumn("_held", block("article_id", n_held))
    postings = holders.groupBy("_held").applyInArrow(_turned(words), f"word string, _held int, bits binary, ids array<{id_type}>")

    # A family counts nothing.
    family = F.concat(F.lit(" "), F.col("family").cast("string"))
    topics = totals.filter(F.col("family").isNotNull()).select("query_id", family.alias("word"), F.lit(0).cast("bigint").alias("_times"))
    asked = wanted.unionByName(topics.distinct()).withColumn("_asked", block("query_id", n_asked))
    marks = spark.range(n_asked).select(F.lit(IDS).alias("word"), F.col("id").cast("int").alias("_asked"))
    left = postings.join(asked.select("word", "_asked").distinct().unionByName(marks), "word")
    lists = asked.groupBy("query_id", "_asked").agg(F.collect_list(F.struct("word", "_times")).alias("words"))
    right = lists.join(totals.select("query_id", "_total"), "query_id").select(
        F.col("_asked").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(n_held - 1))).alias("_b"),
        "query_id", "_total", F.col("words.word").alias("words"), F.col("words._times").alias("times"),
    )
    left = left.select(F.col("_asked").alias("_p"), F.col("_held").alias("_b"), "word", "bits", "ids")
    groups = n_asked * n_held
    both = left.unionByName(right, allowMissingColumns=True).repartition(max(min(2 * groups, 256), groups // 4), "_p", "_b")
    kinds = queries.schema["query_id"], articles.schema["article_id"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kinds), T.StructField("relevance", T.DoubleType())])
    return both.groupBy("_p", "_b").applyInArrow(_meeting(digits), schema)


def relevance_of(pairs: DataFrame, queries: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, article_id, relevance) of chosen pairs."""
    parts = F.filter(F.split(F.lower("query"), BLANK), lambda w: w != "")
    both = pairs.join(queries.select("query_id", parts.alias("_words")), "query_id").join(_bodies(articles), "article_id")
    held = F.size(F.filter("_words", lambda w: F.col("_text").contains(w)))
    return both.select("query_id", "article_id", F.least(held / F.size("_words"), F.lit(1.0)).alias("relevance"))


def first_articles(queries: DataFrame, articles: DataFrame, order: list[Column], k: int) -> DataFrame:
    """(query_id, article_id): of the articles related to a query the first ``k`` per source, by
    ``order``, rising values of the articles alone.

    The first k of a union are among the first k of its parts, so every token, word and family
    keeps k articles per source before queries meet them.
    """
    wanted, totals = _asked(queries)
    keys = [f"_o{i}" for i in range(len(order))]
    bodies = durable(_bodies(articles.withColumns(dict(zip(keys, order))), "source_name", *keys))
    by = [F.col(c).asc_nulls_last() for c in keys]
    article = ["article_id", "source_name", *keys]
    tokens = tokens_of(bodies.select(F.struct(*article).alias("doc_id"), F.col("_text").alias("text"))).select("token", "doc_id.*")
    few = ranked(tokens, ["token", "source_name"], by, k)
    words = ranked(few.join(holding(wanted, few), "token").drop("token").distinct(), ["word", "source_name"], by, k)
    direct = wanted.join(words, "word").select("query_id", *article)
    covers = ranked(bodies.select(*article, F.explode(_families(F.col("_text"))).alias("family")), ["family", "source_name"], by, k)
    related = totals.join(covers, "family").select("query_id", *article)
    return ranked(direct.unionByName(related).distinct(), ["query_id", "source_name"], by, k).select("query_id", "article_id")


#: Words that most articles hold; an article is known by which of them it has.
COMMON_WORDS = 12
#: A word's articles are all met by its queries where they are no more than so many for each of the k.
CHEAP = 32
#: Articles of a block.
BLOCK = 256


def _posting_blocks(hits: DataFrame, words: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, source_name, mask, ids): the articles that hold a word, in blocks of about BLOCK with one source and
    one set of common words. What a block can give a query is known from its mask; ids rise in a block."""
    sizes = words.select("word", F.ceil(F.col("n") / BLOCK).cast("int").alias("_salts")).distinct()
    rows = hits.join(sizes, "word").join(docs.select("article_id", "source_name", "mask"), "article_id")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("article_id"), F.col("_salts")))
    return rows.groupBy("word", "source_name", "mask", "_salt").agg(F.sort_array(F.collect_list("article_id")).alias("ids")).drop("_salt")


def _kept_ids(met: DataFrame, k: int) -> DataFrame:
    """(query_id, article_id) of the blocks that can still change a query's ``k`` best of their source.

    ``met`` has a row for each query, word and block: ``bound``, the most an article of the block can have that is
    not found by a rarer word; ``alone``, where no commoner word follows; and the k-th row so far (low, last).
    A tie with the k-th counts for smaller ids only. Where no word follows, a block's articles are equal but for
    what rarer words give, so its first k stand for it.
    """
    tied = F.col("bound") == F.col("low")
    ids = F.when(tied, F.filter("ids", lambda i: i < F.col("last"))).otherwise(F.col("ids"))
    ids = F.when(F.col("low").isNull(), F.col("ids")).otherwise(ids)
    open_ = met.filter(F.col("low").isNull() | (F.col("bound") >= F.col("low"))).withColumn("_ids", ids)
    first = F.when(F.col("alone"), F.slice("_ids", 1, k)).otherwise(F.col("_ids"))
    return open_.select("query_id", F.explode(first).alias("article_id")).distinct()


def top_articles(queries: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """(query_id, article_id, relevance): as ``relevant_articles``, but only the ``k`` best per query
    and source, by relevance and article_id. Exact, and without all pairs.

    The most common words join nothing: articles are grouped by source and by which of them they hold,
    and each group's first k stand for it. Words that few articles hold are met in full. Both give a k-th score; of the
    other words only those are visited without which an article could still reach it, and of their
    postings only the blocks whose best possible score does. Queries with one text are one query.
    """
    texts = queries.select(F.col("query_id").alias("_query"), F.md5(F.coalesce("query", F.lit("")).cast("binary")).alias("query_id"), "query")
    one_each = texts.groupBy("query_id").agg(F.first("query").alias("query"))
    found = _top_of_texts(one_each, articles, k)
    return texts.select("_query", "query_id").join(found, "query_id").select(F.col("_query").alias("query_id"), "article_id", "relevance")


def _top_of_texts(queries: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    wanted, totals = _asked(queries)
    wanted = durable(wanted)
    bodies = durable(_bodies(articles, "source_name"))
    tokens = tokens_of(bodies.select(F.col("article_id").alias("doc_id"), F.col("_text").alias("text")))
    holds = durable(holding(wanted, tokens))
    sizes = tokens.groupBy("token").agg(F.count("*").alias("n"))
    spread = durable(holds.join(sizes, "token").groupBy("word").agg(F.sum("n").alias("n")))
    common = [r.word for r in spread.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect()]
    mask = sum((F.when(F.col("_text").contains(w), F.lit(1 << i)).otherwise(F.lit(0)) for i, w in enumerate(common)), F.lit(0))
    docs = durable(bodies.select("article_id", "source_name", mask.alias("mask"), _families(F.col("_text")).alias("families")))

    # Queries by their common words: (place, repeats) pairs; few differ.
    number = F.coalesce(*[F.when(F.col("word") == w, F.lit(i)) for i, w in enumerate(common)], F.lit(None).cast("int"))
    split = wanted.withColumn("_common", number)
    signature = split.filter(F.col("_common").isNotNull()).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("_common", "_times"))).alias("signature"), F.sum("_times").alias("_common_weight")
    )
    held_bits = F.array(*[F.col("mask").bitwiseAND(F.lit(1 << i)) > 0 for i in range(COMMON_WORDS)])
    shared = F.aggregate(
        "signature", F.lit(0).cast("bigint"), lambda n, s: n + F.when(F.get(held_bits, s["_common"]), s["_times"]).otherwise(0)
    )
    first = ranked(docs, ["source_name", "mask"], [F.col("article_id")], k)
    bits = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(i)) for i in range(COMMON_WORDS)]))
    kinds = signature.select("signature").distinct()
    met = (
        kinds.select("signature", F.explode("signature").alias("s")).select("signature", F.col("s._common").alias("_common"))
        .join(first.select("source_name", "article_id", "mask", F.explode(bits).alias("_common")), "_common")
        .select("signature", "source_name", "article_id", "mask").distinct().withColumn("_n", shared)
    )
    met = ranked(met, ["signature", "source_name"], [F.desc("_n"), F.col("article_id")], k)
    by_common = signature.join(met, "signature").select("query_id", "article_id", "source_name", "_n")
    covers = ranked(docs.select("article_id", "source_name", F.explode("families").alias("family")), ["family", "source_name"], [F.col("article_id")], k)
    by_family = totals.join(covers, "family").select("query_id", "article_id", "source_name", F.lit(0).cast("bigint").alias("_n"))
    settled = by_common.unionByName(by_family)

    rare = split.filter(F.col("_common").isNull()).join(spread, "word")
    onward = W.partitionBy("query_id").orderBy(F.desc("n"), F.desc("word"))
    rare = rare.withColumn("_onward", F.sum("_times").over(onward)).withColumn("alone", F.row_number().over(onward) == 1)
    rare = durable(rare.select("query_id", "word", "_times", "n", "_onward", "alone"))
    hits = durable(tokens.join(holds.join(rare.select("word").distinct(), "word"), "token").select(F.col("doc_id").alias("article_id"), "word").distinct())

    def scored(pairs: DataFrame) -> DataFrame:
        held = pairs.join(rare.select("query_id", "word", "_times"), "query_id").join(hits, ["article_id", "word"])
        held = held.groupBy("query_id", "article_id").agg(F.sum("_times").alias("_rare"))
        full = held.join(docs, "article_id").join(signature, "query_id", "left")
        return full.select("query_id", "article_id", "source_name", (F.col("_rare") + F.coalesce(shared, F.lit(0))).alias("_n"))

    def kept(best: DataFrame) -> DataFrame:
        most = best.groupBy("query_id", "article_id", "source_name").agg(F.max("_n").alias("_n"))
        return durable(ranked(most, ["query_id", "source_name"], [F.desc("_n"), F.col("article_id")], k))

    met = rare.filter(F.col("n") <= CHEAP * k).select("query_id", "word").join(hits, "word").select("query_id", "article_id").distinct()
    best = kept(settled.unionByName(scored(met)))
    dear = rare.filter(F.col("n") > CHEAP * k)
    candidates = _candidates(dear, signature, best, _posting_blocks(hits, dear, docs), docs, shared, k)
    best = kept(best.unionByName(scored(candidates)))
    return best.join(totals.select("query_id", "_total"), "query_id").select(
        "query_id", "article_id", F.least(F.col("_n") / F.col("_total"), F.lit(1.0)).alias("relevance")
    )


def _candidates(dear: DataFrame, signature: DataFrame, best: DataFrame, blocks: DataFrame, docs: DataFrame, shared: Column, k: int) -> DataFrame:
    """(query_id, article_id) that words of many articles may still bring among the ``k`` best."""
    kth = best.groupBy("query_id", "source_name").agg(F.count("*").alias("_m"), F.max(F.struct(-F.col("_n"), "article_id")).alias("_last"))
    kth = kth.filter(F.col("_m") >= k).select("query_id", "source_name", (-F.col("_last.col1")).alias("low"), F.col("_last.article_id").alias("last"))
    kth = durable(kth)
    # A word goes at once where all sources have k articles that no later word can pass.
    sources = docs.select("source_name").distinct().count()
    floor = kth.groupBy("query_id").agg(F.count("*").alias("_sources"), F.min("low").alias("_low")).filter(F.col("_sources") == sources)
    asked = dear.join(signature, "query_id", "left").join(floor.select("query_id", "_low"), "query_id", "left")
    most = F.coalesce("_common_weight", F.lit(0)) + F.col("_onward")
    asked = asked.filter(F.col("_low").isNull() | (most >= F.col("_low")))
    met = asked.join(blocks, "word").withColumn("bound", F.coalesce(shared, F.lit(0)) + F.col("_onward"))
    met = met.filter(F.col("_low").isNull() | (F.col("bound") >= F.col("_low"))).join(kth, ["query_id", "source_name"], "left")
    return _kept_ids(met, k)


# -- display columns --------------------------------------------------------


def display_flags(df: DataFrame) -> DataFrame:
    """Repost flags, warnings, explanation to show and default category."""
    repost = F.col("post_type").isin(P.REPOST_TYPES)
    warnings = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(column, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(text).alias("message")))
                for column, kind, text in P.WARNINGS
            ]
        )
    )
    categories = C.categories_list(F.col("categories_detected"), F.col("category"))
    return (
        df.withColumn("is_repost", F.coalesce(repost, F.lit(False)))
        .withColumn("repost_kind", F.when(repost, F.col("post_type")))
        .withColumn("warnings", warnings)
        .withColumn("analysis_display", C.best_explanation(F.col("external_explanation"), F.col("local_explanation")))
        .withColumn("has_multiple_categories", F.size(categories) > 1)
        .withColumn("category", F.coalesce("category", F.lit("general")))
    )


def secondary_categories(df: DataFrame) -> DataFrame:
    """Detected categories but the primary one, and the several-categories mark."""
    detected = C.categories_list(F.col("categories_detected"), F.col("category"))
    return df.withColumn("secondary", F.filter(detected, lambda c: c != F.col("category"))).withColumn(
        "has_multiple", F.size(detected) > 1
    )


def decode_categories(df: DataFrame) -> DataFrame:
    return df.withColumn("categories", C.categories_list(F.col("categories_detected"), F.col("category")))


def resolve_category(stages: DataFrame) -> DataFrame:
    """Final category from (pattern_category, model_category, local_explanation, verdict, external_category)."""
    first = F.coalesce("model_category", "pattern_category", F.lit("general"))
    local = F.when(concludes_disinfo(F.col("local_explanation")), "disinformation").otherwise(first)
    checked = F.when(F.coalesce(F.col("verdict") == "debunked", F.lit(False)), "disinformation").otherwise(local)
    final = F.when(F.coalesce("external_category", F.lit("")) != "", F.col("external_category")).otherwise(checked)
    return stages.withColumn("local_category", checked).withColumn("final_category", final)


def external_eligible(df: DataFrame, disabled: bool = False, override: bool = False) -> DataFrame:
    if disabled:
        return df.filter(F.lit(False))
    return df if override else df.filter(~F.col("category").isin("general", "political_general"))


# -- model scoring ----------------------------------------------------------

Scorer = Callable[[pd.Series], pd.DataFrame]  # texts -> columns category, explanation

SCORE_SCHEMA = (
    "post_id string, model_name string, category string, explanation string, processing_time_seconds double, "
    "error_message string, attempts int"
)


def score_models(posts: DataFrame, scorers: dict[str, Scorer], retries: int = 0) -> DataFrame:
    """One row per (post, model). A failing batch is retried row by row; a row that keeps
    failing becomes category ``general`` with the error text."""

    def one(scorer: Scorer, text: str) -> tuple[str, str, str | None, int]:
        message = None
        for attempt in range(1, retries + 2):
            try:
                out = scorer(pd.Series([text])).iloc[0]
                return out["category"], out["explanation"], None, attempt
            except Exception as problem:  # the scorer is foreign code
                message = str(problem)
        return "general", f"Error: {message}", message, retries + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("model_name", sort=False):
                start = time.perf_counter()
                try:
                    out = scorers[name](part["content"].reset_index(drop=True))
                    rows = [(c, e, None, 1) for c, e in zip(out["category"], out["explanation"], strict=True)]
                except Exception:  # fall back to single rows
                    rows = [one(scorers[name], text) for text in part["content"]]
                each = (time.perf_counter() - start) / max(len(part), 1)
                yield pd.DataFrame(
                    {
                        "post_id": part["post_id"].to_numpy(),
                        "model_name": name,
                        "category": [r[0] for r in rows],
                        "explanation": [r[1] for r in rows],
                        "processing_time_seconds": each,
                        "error_message": [r[2] for r in rows],
                        "attempts": [r[3] for r in rows],
                    }
                )

    models = posts.sparkSession.createDataFrame([(m,) for m in scorers], "model_name string")
    pairs = posts.select("post_id", "content").crossJoin(F.broadcast(models))  # as many models as scorers
    return pairs.mapInPandas(run, SCORE_SCHEMA)


# -- stored HTML ------------------------------------------------------------

# What a page holds, as it stands there; columns decide what it means.
RAW_POST = (
    "page_id string, target string, read boolean, links array<struct<href:string,role:string,in_card:boolean>>, "
    "images array<struct<src:string,later:string,in_photo:boolean>>, videos array<struct<poster:string,src:string>>, "
    "bodies array<string>, language_spans array<string>, stamps array<string>, marked map<string,struct<label:string,shown:string>>, "
    "labels array<string>, classes array<string>, nested boolean, seconds double"
)


def _raw_post(html: str) -> dict:
    """The raw attributes of a stored post page, in document order."""
    nodes = list(dom.parse(html).walk())
    by_tag = {name: [n for n in nodes if n.tag == name] for name in ("a", "img", "video", "span", "time")}
    marked: dict[str, dict] = {}
    for n in nodes:
        if "data-testid" in n.attrs:
            marked.setdefault(n.attrs["data-testid"], {"label": n.attrs.get("aria-label"), "shown": n.text()})
    card = next((n for n in nodes if n.attrs.get("data-testid") == P.CARD_MARK), None)
    return {
        "read": True,
        "links": [{"href": n.attrs.get("href"), "role": n.attrs.get("role"), "in_card": n.inside(lambda up: up is card)} for n in by_tag["a"]],
        "images": [{"src": n.attrs.get("src"), "later": n.attrs.get("data-src"), "in_photo": n.inside(dom.testid(P.PHOTO_MARK))} for n in by_tag["img"]],
        "videos": [{"poster": n.attrs.get("poster"), "src": n.attrs.get("src")} for n in by_tag["video"] if n.inside(dom.testid(P.PLAYER_MARK))],
        "bodies": [n.text() for n in nodes if n.attrs.get("data-testid") == P.BODY_MARK],
        "language_spans": [n.text() for n in by_tag["span"] if n.inside(lambda up: up.tag == "div" and "lang" in up.attrs)],
        "stamps": [n.attrs.get("datetime") for n in by_tag["time"]],
        "marked": marked,
        "labels": [n.attrs["aria-label"] for n in nodes if n.attrs.get("aria-label")],
        "classes": [n.attrs["class"] for n in nodes if n.attrs.get("class")],
        "nested": any(dom.testid(P.POST_MARK)(n) and n.inside(dom.testid(P.POST_MARK)) for n in nodes),
    }


def raw_posts(pages: DataFrame) -> DataFrame:
    """Stored pages (page_id, html, username) -> RAW_POST rows; an unreadable page has only its id."""
    names = [f.name for f in T._parse_datatype_string(RAW_POST).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html, target in zip(batch["page_id"], batch["html"], batch["username"], strict=True):
                start = time.perf_counter()
                try:
                    row = _raw_post(html or "")
                except Exception:  # malformed page: a failed row
                    row = {"read": False}
                rows.append({**row, "page_id": page_id, "target": target or "", "seconds": time.perf_counter() - start})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "html", "username").mapInPandas(run, RAW_POST)


def _holds(text: Column, marks: list[str]) -> Column:
    return F.coalesce(any_of(text.contains(m) for m in marks), F.lit(False))


def _status_link(links: Column) -> Column:
    """First link to a status; null when there is none."""
    return F.try_element_at(F.filter(links, lambda k: _holds(k["href"], ["/status/"])), F.lit(1))["href"]


def _media_links(images: Column, videos: Column) -> Column:
    """Distinct media links: stored images first, then images of photo frames, then videos."""
    stored = F.filter(images, lambda i: _holds(i["src"], P.STORED_IMAGE_MARKS))
    framed = F.filter(images, lambda i: i["in_photo"])
    shown = F.transform(F.concat(stored, framed), lambda i: F.coalesce(F.nullif(i["src"], F.lit("")), i["later"]))
    kept = F.filter(shown, lambda u: _holds(u, P.MEDIA_HOSTS) & ~_holds(u, P.SKIPPED_IMAGE_MARKS))
    clips = F.flatten(
        F.transform(videos, lambda v: F.array(F.nullif(v["poster"], F.lit("")), F.when(_holds(v["src"], P.CLIP_HOSTS), v["src"])))
    )
    return F.array_distinct(F.concat(kept, F.array_compact(clips)))


def _post_kind(raw: DataFrame) -> DataFrame:
    """post_type and its origin: the first rule of the table that holds decides."""
    said = F.coalesce(F.col("marked")[P.CONTEXT_MARK]["shown"], F.lit(""))
    low = F.lower(said)
    target = F.lower("target")
    reposted = _holds(low, P.REPOST_WORDS)
    profile = F.try_element_at(
        F.filter(
            F.transform(
                F.filter("links", lambda k: (k["role"] == "link") & k["href"].startswith("/") & ~k["href"].contains("/status/")),
                lambda k: F.regexp_replace(k["href"], "^/+|/+$", ""),
            ),
            lambda name: (name != "") & (F.lower(name) != target),
        ),
        F.lit(1),
    )
    actor = F.lower(F.coalesce(*[extract_or_null(said, p) for p in P.REPOST_ACTORS]))
    quoted = C.author_and_id(_status_link(F.filter("links", lambda k: k["in_card"])))
    none = F.lit(None).cast("string")
    rules = [
        ("pinned", _holds(low, P.PINNED_WORDS), none, none),
        ("pinned", F.exists("labels", lambda t: _holds(t, P.PINNED_LABELS)), F.when(reposted, profile), none),
        ("quote", F.coalesce(quoted["author"] != "", F.lit(False)), quoted["author"], quoted["post_id"]),
        ("repost_own", reposted & F.coalesce((actor == target) & (F.lower("link.author") == target), F.lit(False)), profile, none),
        ("retweet", reposted, profile, none),
        ("original", F.lit(True), none, none),
    ]
    found = F.coalesce(
        *[F.when(test, F.struct(F.lit(kind).alias("kind"), author.alias("author"), number.alias("number"))) for kind, test, author, number in rules]
    )
    return raw.withColumn("origin", found)


def parse_post_html(pages: DataFrame) -> DataFrame:
    """Stored post pages (page_id, html, username) -> one row per page with its parse status."""
    raw = raw_posts(pages).withColumn("href", _status_link(F.col("links")))
    raw = _post_kind(raw.withColumn("link", C.author_and_id(F.col("href"))))
    linked = F.coalesce(F.col("read") & (F.col("link.author") != "") & (F.col("link.post_id") != ""), F.lit(False))
    own = F.lower("link.author") == F.lower("target")
    media = _media_links(F.col("images"), F.col("videos"))
    body = F.coalesce(F.try_element_at("bodies", F.lit(1)), F.array_join("language_spans", " "))

    def counted(mark: str) -> Column:
        held = F.col("marked")[mark]
        return C.labelled_count(F.coalesce(F.nullif(held["label"], F.lit("")), held["shown"]))

    post = {
        "url": F.concat(F.lit("https://x.com"), F.col("href")),
        "content": body,
        "post_ts": F.try_element_at("stamps", F.lit(1)),
        "media_links": F.nullif(F.array_join(media, ","), F.lit("")),
        "media_count": F.size(media),
        "reposts": counted("retweet"),
        "likes": counted("like"),
        "replies": counted("reply"),
        "views": C.labelled_count(F.col("marked")[P.VIEWS_MARK]["shown"]),
        "post_type": F.col("origin.kind"),
        "original_author": F.col("origin.author"),
        "original_post_id": F.col("origin.number"),
        "has_thread_line": F.col("nested") | F.exists("classes", lambda c: c.contains(P.THREAD_CLASS)),
    }
    return raw.select(
        "page_id",
        F.when(~linked, "failed").when(own, "ok").otherwise("other_author").alias("status"),
        F.when(linked, F.col("link.post_id")).alias("post_id"),
        F.when(linked, F.col("link.author")).alias("username"),
        *[F.when(linked & own, value).alias(name) for name, value in post.items()],
        "seconds",
    )


# Article markup of the fact-check sources, in search order.
ARTICLE_CLASSES = {
    "maldita": ["post", "entry", "article-item", "search-result"],
    "newtral": ["post", "entry", "article-item", "search-result-item"],
    "snopes": ["article", "search-result", "media"],
}
TITLE_CLASSES = ("entry-title", "post-title", "article-title")
EXCERPT_CLASSES = ("entry-excerpt", "post-excerpt", "summary", "article-excerpt", "article-description")
DATE_CLASSES = ("entry-date", "post-date", "article-date")
RATING_CLASSES = ("rating", "fact-check-rating", "verdict")
DATE_FORMATS = {"maldita": "yyyy-MM-dd", "newtral": "d/M/yyyy", "snopes": "MMMM d, yyyy"}


def parse_fact_checks(pages: DataFrame, source: str) -> DataFrame:
    """Stored search pages (page_id, html) -> fact_checks rows; rows without verdict are dropped."""
    classes = ARTICLE_CLASSES[source]

    def articles(root: dom.Node) -> list[dom.Node]:
        found = root.all(lambda n: n.tag == "article")
        for name in classes:
            if found:
                break
            found = root.all(lambda n, name=name: name in n.classes())
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                for i, article in enumerate(articles(dom.parse(html or ""))):
                    title = article.first(dom.tag_or_class(("h2", "h3"), TITLE_CLASSES))
                    link = article.first(lambda n: n.tag == "a" and "href" in n.attrs)
                    if title is None or link is None:
                        continue
                    excerpt = article.first(dom.tag_or_class(("p",), EXCERPT_CLASSES))
                    date = article.first(dom.tag_or_class(("time",), DATE_CLASSES))
                    rating = article.first(dom.tag_or_class((), RATING_CLASSES))
                    rows.append(
                        (
                            page_id, i, title.text(), link.attrs["href"], excerpt.text() if excerpt else "",
                            (date.attrs.get("datetime") or date.text()) if date else None, rating.text() if rating else None,
                        )
                    )
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "article_no", "claim", "href", "excerpt", "date_text", "rating"])

    raw = pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInPandas(
        run, "page_id string, article_no int, claim string, href string, excerpt string, date_text string, rating string"
    )
    found = infer_verdict(F.col("claim"), F.col("excerpt"), source)
    if source == "snopes":
        rated = _verdict(F.col("rating"), P.RATING_WORDS)
        found = F.when(rated["verdict"] != "unverified", rated).otherwise(found)
    iso = F.regexp_replace("date_text", "Z$", "+00:00")
    published = F.coalesce(
        F.when(F.col("date_text").rlike(r"^\d{4}-\d{2}-\d{2}"), iso.try_cast("timestamp")),
        F.try_to_timestamp("date_text", F.lit(DATE_FORMATS[source])),
    )
    return (
        raw.withColumn("_v", found)
        .filter(F.col("_v.verdict") != "unverified")
        .select(
            "page_id",
            "article_no",
            "claim",
            F.col("_v.verdict").alias("verdict"),
            F.col("_v.confidence").alias("confidence"),
            F.col("excerpt").alias("explanation"),
            F.lit(P.FACT_CHECK_NAMES[source]).alias("source_name"),
            F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(P.FACT_CHECK_SITES[source]), "href")).alias("url"),
            published.alias("publication_date"),
            topic_tags(F.concat_ws(" ", "claim", "excerpt"), source).alias("tags"),
        )
    )


# -- stored statistics ------------------------------------------------------

# Fixed values: (source, indicator, unit, factor).
STATISTICS = {
    "ine": ("INE", "population", "personas", 1.0),
    "eurostat_gdp": ("Eurostat", "gdp", "EUR", 1e6),
    "eurostat_growth": ("Eurostat", "gdp_growth", "%", 1.0),
    "who": ("WHO", "life_expectancy", "años", 1.0),
    "worldbank": ("World Bank", "gdp_per_capita", "USD", 1.0),
}


def normalize_statistics(raw: DataFrame, source: str, latest: int | None = None) -> DataFrame:
    """Stored JSON answers (payload_id, payload) of one source -> reference_stats rows: all of an
    answer, or its ``latest`` years."""
    name, indicator, unit, factor = STATISTICS[source]
    payload = F.col("payload")
    if source == "ine":
        items = raw.select(
            "payload_id", F.explode(F.from_json(payload, "array<struct<Data:array<struct<Valor:string,Anyo:string>>>>")).alias("i")
        ).select("payload_id", F.try_element_at("i.Data", F.lit(1)).alias("d"))
        rows = items.select(
            "payload_id", F.col("d.Anyo").try_cast("int").alias("year"),
            F.regexp_replace("d.Valor", "[,.]", "").try_cast("double").alias("value"),
        )
    elif source in ("eurostat_gdp", "eurostat_growth"):
        shape = "struct<value:map<string,double>,dimension:struct<time:struct<category:struct<index:map<string,int>>>>>"
        body = raw.select("payload_id", F.from_json(payload, shape).alias("b"))
        entries = body.select("payload_id", F.explode("b.dimension.time.category.index").alias("year_text", "at"), "b.value")
        rows = entries.select(
            "payload_id", F.col("year_text").try_cast("int").alias("year"),
            F.try_element_at("value", F.col("at").cast("string")).alias("value"),
        )
    elif source == "who":
        items = raw.select(
            "payload_id", F.explode(F.from_json(payload, "struct<value:array<struct<Year:string,NumericValue:double>>>")["value"]).alias("i")
        )
        rows = items.select("payload_id", F.col("i.Year").try_cast("int").alias("year"), F.col("i.NumericValue").alias("value"))
        rows = rows.filter(F.col("value") != 0)
    else:
        second = F.get_json_object(payload, "$[1]")
        items = raw.select("payload_id", F.explode(F.from_json(second, "array<struct<date:string,value:double>>")).alias("i"))
        rows = items.select("payload_id", F.col("i.date").try_cast("int").alias("year"), F.col("i.value").alias("value"))
        rows = rows.filter(F.col("value") != 0)
    rows = rows.filter(F.col("year").isNotNull() & F.col("value").isNotNull())
    if latest:
        rows = ranked(rows, ["payload_id"], [F.col("year").desc()], latest)
    return rows.select(
        "payload_id", F.lit(name).alias("source"), F.lit(indicator).alias("indicator"), "year",
        (F.col("value") * F.lit(factor)).alias("value"), F.lit(unit).alias("unit"),
    )
