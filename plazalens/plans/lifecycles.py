"""The two batch lifecycles as single Spark jobs: analyse pending posts, verify content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalens.functions import posts as C
from plazalens.functions.tables import ranked
from plazalens.operators import claims as K
from plazalens.operators import evidence as G
from plazalens.operators import labels as L
from plazalens.operators.maintain import failed_rows, upsert_analyses
from plazalens.operators.views import pending_posts
from plazalens.session import durable


def claims_of_posts(posts: DataFrame, as_of: Column, n: int | None = None) -> DataFrame:
    """Scored claims of every post, or the ``n`` best, with a ``claim_id``."""
    top = K.top_claims(K.score_claims(K.all_claims(posts), as_of), n)
    return top.withColumn("claim_id", F.concat_ws("/", "post_id", F.col("claim_no").cast("string")))


BEST_SOURCES = 5
SOURCES = "array<struct<source_name:string,source_type:string,url:string,credibility_score:double,verdict:string,confidence:double>>"


def judge_texts(texts: DataFrame, fact_checks: DataFrame, articles: DataFrame, as_of: Column, per_source: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, urls) of distinct claim texts (text_id, claim_text) by all fact checks and articles that share words
    with them, or the ``per_source`` best of each source.

    A verdict has the weighted shares of its text's evidence, the best credibility and the first BEST_SOURCES
    sources; sums are partial before they are shuffled, and nothing ranks all evidence of a text in one task.
    """
    asked = texts.select(F.col("text_id").alias("query_id"), F.col("claim_text").alias("query"))
    if per_source is None:
        bodies = fact_checks.select(F.col("check_id").alias("article_id"), F.col("claim").alias("title"), F.lit("").alias("description"))
        matched = L.relevant_articles(asked, bodies).select(F.col("query_id").alias("claim_id"), F.col("article_id").alias("check_id"))
        read = L.relevant_articles(asked, articles).select(F.col("query_id").alias("claim_id"), "article_id")
    else:
        claims = texts.select(F.col("text_id").alias("claim_id"), "claim_text")
        matched = G.match_fact_checks(claims, fact_checks, per_source).select("claim_id", "check_id")
        read = G.rank_articles(asked, articles, per_source).select(F.col("query_id").alias("claim_id"), "article_id")
    found = G.to_evidence(matched.join(fact_checks, "check_id"), read.join(articles, "article_id"))
    found = found.withColumnRenamed("claim_id", "text_id").join(texts, "text_id")
    scored = G.blend_priority(G.credibility(found, as_of))
    scored = durable(scored.select("text_id", "source_name", "source_type", "url", "credibility_score", "verdict", "confidence"))
    best = scored.groupBy("text_id").agg(F.max("credibility_score").alias("best"))
    order = [F.col("source_type"), F.desc("credibility_score"), F.desc("confidence"), F.col("source_name"), F.col("url")]
    first = ranked(scored, ["text_id"], order, BEST_SOURCES, "_r")
    item = F.struct("_r", "source_name", "source_type", "url", "credibility_score", "verdict", "confidence")
    listed = first.groupBy("text_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda s: s.dropFields("_r")).cast(SOURCES).alias("sources"))
    verdicts = G.claim_verdict(scored, ["text_id"]).join(best, "text_id").join(listed, "text_id")
    urls = scored.filter(F.coalesce("url", F.lit("")) != "").select("text_id", "url").distinct()
    return verdicts, urls


def sources_of_posts(claims: DataFrame, urls: DataFrame) -> DataFrame:
    """(post_id, n_sources): distinct addresses over the texts of a post. Posts with the same texts are counted once."""
    texts = claims.groupBy("post_id").agg(F.sort_array(F.collect_set("text_id")).alias("texts")).withColumn("set_id", F.md5(F.array_join("texts", ",").cast("binary")))
    texts = durable(texts)
    sets = texts.groupBy("set_id").agg(F.first("texts").alias("texts")).select("set_id", F.explode("texts").alias("text_id"))
    counts = durable(sets.join(urls, "text_id").groupBy("set_id").agg(F.count_distinct("url").alias("n_sources")))
    return texts.select("post_id", "set_id").join(counts, "set_id").select("post_id", "n_sources")


def event_reports(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Reports of posts that claim an arrest, by the pages searched for them (post_id, page_id, source_kind,
    source_name, html): one claim a post, and a page is a source."""
    claims = K.arrest_claims(posts).select(F.col("post_id").alias("claim_id"), "person_name", "event_type")
    evidence = G.event_evidence(claims, pages.withColumnRenamed("post_id", "claim_id"))
    sources = evidence.groupBy("claim_id").agg(F.count("*").alias("n_sources"))
    verdicts = G.event_verdict(evidence, claims).join(sources, "claim_id", "left")
    return verdicts.select(
        F.col("claim_id").alias("post_id"), "verdict", "confidence", F.lit(1).cast("long").alias("n_claims"),
        *[(F.col("verdict") == v).cast("long").alias(f"n_{v}") for v in ("verified", "debunked", "questionable")],
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.lit(True).alias("temporal_consistency"),
        F.array().cast("array<string>").alias("contradictions"),
    )


def verify_content(
    posts: DataFrame,
    reference_stats: DataFrame,
    fact_checks: DataFrame,
    articles: DataFrame,
    as_of: Column,
    per_source: int | None = None,
    event_pages: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reports per post, judged claims). Numbers go to the statistics, dates to the
    rules, everything else to fact checks and articles; all of these are tables.

    With ``event_pages`` a post that claims an arrest is judged by the pages searched for it instead.
    """
    plain = posts
    if event_pages is not None:
        plain = posts.join(K.arrest_claims(posts).select("post_id"), "post_id", "left_anti")
    claims = claims_of_posts(plain, as_of)
    # Claims feed three paths and the roll-up: extract them once. Equal texts are judged once.
    claims = durable(claims.withColumn("text_id", F.md5(F.col("claim_text").cast("binary"))))
    numeric = claims.filter(F.col("claim_type") == "numerical")
    dated = claims.filter(F.col("claim_type") == "temporal")
    other = claims.filter(~F.col("claim_type").isin("numerical", "temporal"))

    texts = posts.select("post_id", F.col("content").alias("post_text"))
    checked = G.verify_numeric(numeric.join(texts, "post_id").select("claim_id", "claim_text", "post_text"), reference_stats)
    timed = G.verify_temporal(dated, as_of)
    by_text, urls = judge_texts(other.groupBy("text_id").agg(F.first("claim_text").alias("claim_text")), fact_checks, articles, as_of, per_source)

    none = F.lit(None).cast(SOURCES)

    def single(rows: DataFrame, name: Column, kind: str, confidence: Column) -> DataFrame:
        own = F.array(F.struct(name, F.lit(kind), F.lit(""), "credibility_score", "verdict", confidence)).cast(SOURCES)
        return rows.select(
            "claim_id", "verdict", "confidence", F.col("credibility_score").alias("best"), F.when(F.col("credibility_score").isNotNull(), own).otherwise(none).alias("sources")
        )

    verdicts = (
        single(checked, G.lookup(G.R.STATISTICS_NAMES, F.col("source")), "statistical", F.col("evidence_confidence"))
        .unionByName(single(timed, F.lit("Verificación Temporal"), "temporal", F.col("confidence")))
        .unionByName(other.select("claim_id", "text_id").join(durable(by_text), "text_id").select("claim_id", "verdict", "confidence", "best", "sources"))
    )
    judged = claims.drop("confidence").join(verdicts, "claim_id", "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit("unverified"))
    ).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    judged = durable(judged)
    reports = G.report_of(plain, judged, G.voted(judged), sources_of_posts(other, urls))
    if event_pages is not None:
        reports = reports.unionByName(event_reports(posts, event_pages))
    return reports, judged.drop("text_id", "best")


def verification_note(report: Column) -> Column:
    """What a report adds to an explanation: its own text, or the numbers checked and contradicted."""
    clashes = F.coalesce(F.size(report["contradictions"]), F.lit(0))
    counted = F.concat(F.lit("Verificación realizada: "), F.coalesce(report["n_claims"], F.lit(0)).cast("string"), F.lit(" afirmaciones analizadas."))
    return F.concat(counted, F.when(clashes > 0, F.concat(F.lit(" Contradicciones detectadas: "), clashes.cast("string"), F.lit("."))).otherwise(""))


def analyse_pending(
    posts: DataFrame,
    analyses: DataFrame,
    scorer: L.Scorer,
    reports: DataFrame,
    as_of: Column,
    users: list[str] | None = None,
    n: int | None = None,
    external: L.Scorer | None = None,
    retries: int = 0,
) -> DataFrame:
    """Label the worklist, ask the model, verify where it matters, write the analyses back.

    ``reports`` are verification reports as ``verify_content`` makes them (post_id, verdict,
    confidence, n_claims, n_sources, contradictions). They count where the label is disinformation or
    the text claims an arrest. ``external`` is asked about the posts whose label asks for it. A post
    whose model fails becomes an ERROR row, so that it can be found and tried again.
    """
    work = durable(pending_posts(posts, analyses, users, n))
    labelled = L.label(work).select("post_id", "username", "categories", F.try_element_at("categories", F.lit(1)).alias("pattern_category"))
    answers = durable(L.score_models(work, {"model": scorer}, retries))
    answered = answers.filter(F.col("error_message").isNull()).select(
        "post_id", F.col("category").alias("model_category"), F.col("explanation").alias("local_explanation")
    )
    none = F.lit(None).cast("string")
    stages = labelled.join(answered, "post_id").withColumn("verdict", none).withColumn("external_category", none)
    first = L.resolve_category(stages).drop("verdict", "external_category")
    arrests = K.arrest_claims(work).select("post_id", F.lit(True).alias("_arrest")).distinct()
    kept = ["verdict", "confidence", "n_claims", "n_sources", "contradictions"]
    joined = first.join(arrests, "post_id", "left").join(reports.select("post_id", F.struct(*kept).alias("_report")), "post_id", "left")
    gate = (F.col("local_category") == "disinformation") | F.coalesce("_arrest", F.lit(False))
    joined = joined.withColumn("_report", F.when(gate, F.col("_report"))).withColumn("verdict", F.col("_report.verdict"))
    checked = L.resolve_category(joined.drop("local_category", "final_category").withColumn("external_category", none)).drop("external_category", "final_category")
    checked = durable(checked)

    outside = checked.select("post_id").limit(0).select("post_id", none.alias("external_category"), none.alias("external_explanation"))
    if external is not None:
        asked = L.external_eligible(checked.select("post_id", F.col("local_category").alias("category"))).join(work.select("post_id", "content"), "post_id")
        outside = L.score_models(asked, {"external": external}, retries).filter(F.col("error_message").isNull()).select(
            "post_id", F.col("category").alias("external_category"), F.col("explanation").alias("external_explanation")
        )
    resolved = L.resolve_category(checked.drop("local_category").join(outside, "post_id", "left"))
    cited = F.coalesce((F.size("_report.contradictions") > 0) | (F.col("_report.n_sources") > 0), F.lit(False))
    explained = F.concat_ws("\n\n", "local_explanation", F.when(cited, verification_note(F.col("_report"))))
    summary = F.struct(
        F.col("_report.verdict").alias("overall_verdict"), F.col("_report.confidence").alias("confidence_score"),
        F.col("_report.n_claims").alias("claims"), F.col("_report.n_sources").alias("sources_cited"),
        F.col("_report.contradictions").alias("contradictions_found"),
    )
    used = F.col("external_category").isNotNull()
    rows = resolved.select(
        "post_id",
        F.col("username").alias("author_username"),
        F.col("final_category").alias("category"),
        F.to_json("categories").alias("categories_detected"),
        explained.alias("local_explanation"),
        "external_explanation",
        C.stage_text({s: used if s == "external" else F.lit(True) for s in ("pattern", "category_detection", "explanation", "external")}).alias("analysis_stages"),
        used.alias("external_analysis_used"),
        F.when(F.col("_report").isNotNull(), F.to_json(summary)).alias("verification_data"),
        F.col("_report.confidence").cast("double").alias("verification_confidence"),
        as_of.alias("analysis_ts"),
    )
    failed = answers.filter(F.col("error_message").isNotNull()).join(work.select("post_id", F.col("username").alias("author_username")), "post_id")
    failures = failed_rows(failed.select("post_id", "author_username", "error_message", F.array().cast("array<string>").alias("media_urls")), as_of)
    shared = [c for c in failures.columns if c in analyses.columns]
    return upsert_analyses(analyses, rows.unionByName(failures.select(*shared), allowMissingColumns=True))
