"""Operators on small literal frames with known results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plazalens.functions import posts as C
from plazalens.operators import claims as K
from plazalens.operators import evidence as G
from plazalens.operators import ingest as H
from plazalens.operators import labels as L
from plazalens.operators import maintain as M
from plazalens.operators import reports as R
from plazalens.operators import threads as D
from plazalens.rules import categories as CATEGORIES
from plazalens.sources import tables as S

AS_OF = "2024-06-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def votes(spark):
    labels = {
        "p1": ["hate_speech", "hate_speech", "general"], "p2": ["general", "nationalism"],
        "p3": ["general", "nationalism", "hate_speech"], "p4": ["general", None, None], "p5": [None, None],
    }
    data = [
        (p, f"m{i}", c, None if c else "timeout", 1.0) for p, cs in labels.items() for i, c in enumerate(cs, 1)
    ]
    return spark.createDataFrame(
        data, "post_id string, model_name string, category string, error_message string, processing_time_seconds double"
    )


def test_consensus(votes):
    got = {r["post_id"]: (r["consensus_category"], round(r["agreement_score"], 3)) for r in R.consensus(votes).collect()}
    assert got == {"p1": ("hate_speech", 0.667), "p2": ("general", 0.5), "p3": ("general", 0.333), "p4": ("general", 1.0)}


def test_agreement(votes):
    r = R.agreement(votes).first()
    assert (r["total_posts"], r["full_agreement"], r["partial_agreement"], r["no_agreement"]) == (3, 0, 2, 1)


def test_agreement_of_nothing_is_zero(votes):
    r = R.agreement(votes.limit(0)).first()
    assert (r["total_posts"], r["avg_agreement"]) == (0, 0.0)


def test_performance_of_failures_only(votes):
    r = R.model_performance(votes.filter("post_id = 'p5'")).orderBy("model_name").first()
    assert (r["successful"], r["avg_processing_time"], r["error_rate"], r["category_distribution"]) == (0, 0.0, 1.0, {})


def reply_posts(spark, data):
    frame = spark.createDataFrame(data, "post_num long, username string, parent long, has_thread_line boolean")
    return frame.select(
        F.col("post_num").cast("string").alias("post_id"), "post_num", "username",
        F.col("parent").cast("string").alias("reply_to_post_id"), "has_thread_line",
    )


def test_reply_threads(spark):
    posts = reply_posts(
        spark,
        [(1, "a", None, False), (2, "A", 1, False), (3, "b", 2, False), (4, "a", 3, False), (5, "a", 2, False), (6, "a", None, False), (7, "a", 99, False)],
    )
    assert rows(D.reply_threads(posts), "thread_id", "thread_position", "post_id") == [("1", 0, "1"), ("1", 1, "2"), ("1", 2, "5")]


def test_reply_threads_long_chain_and_cycle(spark):
    chain = [(i, "a", i - 1 if i > 1 else None, False) for i in range(1, 41)]
    cycle = [(101, "c", 103, False), (102, "c", 101, False), (103, "c", 102, False)]
    got = rows(D.reply_threads(reply_posts(spark, chain + cycle), chunk_width=7), "thread_position", "post_id")
    assert got == sorted((i - 1, str(i)) for i in range(1, 41))


def test_proximity_threads(spark):
    nums = [0, 4 * 10**12, 8 * 10**12, 2 * 10**13, 26 * 10**12, 29 * 10**12]
    posts = reply_posts(spark, [(n, "a", None, True) for n in nums])
    got = rows(D.proximity_threads(posts, chunk_width=10**13), "thread_id", "thread_position", "post_num")
    expected = [("0", 0, 0), ("0", 1, 4 * 10**12), ("0", 2, 8 * 10**12), ("26000000000000", 0, 26 * 10**12), ("26000000000000", 1, 29 * 10**12)]
    assert got == expected


def conversation(spark, authors):
    data = [(1, i, a) for i, a in enumerate(authors, 1)]
    return spark.createDataFrame(data, "conv_id long, post_num long, username string")


def test_conversation_prefix(spark):
    authors = spark.createDataFrame([(1, "a")], "conv_id long, author string")
    assert rows(D.conversation_prefix(conversation(spark, "baaba"), authors), "post_num") == [(2,), (3,)]


def test_contiguous_parents(spark):
    focal = spark.createDataFrame([(1, 4, "a")], "conv_id long, focal_num long, author string")
    assert rows(D.contiguous_parents(conversation(spark, "abaa"), focal), "post_num") == [(3,)]


def test_claim_score(spark):
    posts = spark.createDataFrame(
        [("1", "La población es de 47 millones"), ("2", "Según datos la población es de 47 millones")], "post_id string, content string"
    )
    found = K.score_claims(K.extract_matches(posts), as_of()).filter("claim_text = '47 millones'")
    assert rows(found, "post_id", "priority", "confidence") == [("1", 10, 0.95), ("2", 10, 1.0)]


def test_claim_span_and_context(spark):
    text = "x" * 60 + " 25 euros " + "y" * 60
    posts = spark.createDataFrame([("1", text)], "post_id string, content string")
    r = K.extract_matches(posts).filter("claim_text = '25 euros'").first()
    assert text[r["start_pos"]:r["end_pos"]] == "25 euros"
    assert r["context"] == text[max(0, r["start_pos"] - 50):r["end_pos"] + 50].strip()


@pytest.mark.parametrize(
    ("text", "plausible", "day"),
    [("23/07/2023", True, "2023-07-23"), ("31/12/2030", False, "2030-12-31"), ("hace 3 días", True, None), ("sin fecha", False, None), ("31/02/2020", True, "2020-01-01")],
)
def test_temporal_check(spark, text, plausible, day):
    claims = spark.createDataFrame([(text, "")], "claim_text string, context string")
    r = K.temporal_check(claims, as_of()).first()
    assert r["plausible"] is plausible
    assert (str(r["verified_date"]) if r["verified_date"] else None) == day


@pytest.mark.parametrize(
    ("text", "expected"),
    [("47 millones", 47e6), ("2 billones", 2e9), ("3.5 mil", 3500.0), ("1,250", 1250.0), ("3%", 3.0), ("nada", None), ("millones", None)],
)
def test_magnitude(spark, text, expected):
    assert value(spark, K.parse_magnitude(F.lit(text))) == expected


def test_magnitude_long_scale(spark):
    assert value(spark, K.parse_magnitude(F.lit("2 billones"), long_scale=True)) == 2e12


def evidence(spark, data):
    return spark.createDataFrame(data, "claim_id long, evidence_no long, verdict string, credibility_score double, confidence double")


def test_claim_verdict(spark):
    frame = evidence(spark, [(1, 1, "verified", 0.9, 0.9), (1, 2, "debunked", 0.9, 0.8), (2, 3, "verified", 0.5, 0.5), (3, 4, "verified", 0.0, 0.5)])
    got = {r["claim_id"]: (r["verdict"], round(r["confidence"], 3)) for r in G.claim_verdict(frame).collect()}
    assert got == {1: ("questionable", 0.471), 2: ("verified", 1.0), 3: ("unverified", 0.0)}


def test_aggregate_evidence_names_both_extra_verdicts(spark):
    frame = evidence(spark, [(1, 1, "verified", 0.9, 0.9), (1, 2, "debunked", 0.9, 0.8), (2, 3, "debunked", 0.0, 0.5)]).withColumn(
        "publication_date", F.lit(None).cast("timestamp")
    )
    assert rows(G.aggregate_evidence(frame, as_of()), "claim_id", "verdict") == [(1, "contradictory"), (2, "unclear")]


def test_resolve_conflicts(spark):
    frame = evidence(
        spark,
        [(1, 1, "verified", 1.0, 1.0), (1, 2, "verified", 1.0, 1.0), (1, 3, "debunked", 1.0, 1.0), (2, 4, "verified", 1.0, 1.0), (2, 5, "debunked", 1.0, 1.0)]
        + [(3, n, v, 1.0, 1.0) for n, v in enumerate(["verified", "verified", "debunked", "debunked", "questionable"], 6)],
    )
    got = rows(G.resolve_conflicts(frame), "evidence_no", "credibility_score")
    assert got == [(1, 1.0), (2, 1.0), (4, 1.0), (5, 1.0), (6, 1.0), (7, 1.0), (8, 1.0), (9, 1.0), (10, 0.7)]


def test_upsert_keeps_thread(spark):
    schema = "post_id string, thread_id string, likes long"
    out = M.upsert_posts(spark.createDataFrame([("1", "t1", 5)], schema), spark.createDataFrame([("1", None, 7)], schema))
    assert rows(out, "thread_id", "likes") == [("t1", 7)]


@pytest.mark.parametrize(("text", "n"), [("1,2K", 1200), ("3M", 3000000), ("1.5K", 1500), ("abc", 0), ("", 0), ("1,234", 1234), ("K", 0)])
def test_parse_count(spark, text, n):
    assert value(spark, C.parse_count(F.lit(text))) == n


def test_until_known_run(spark):
    flags = "nkknkkkn"
    incoming = spark.createDataFrame([(str(i), "u", i) for i in range(1, 9)], "post_id string, username string, arrival long")
    stored = spark.createDataFrame([(str(i), "u") for i, f in enumerate(flags, 1) if f == "k"], "post_id string, username string")
    assert rows(H.until_known_run(incoming, stored, 3, chunk_width=3), "post_id") == [("1",), ("4",)]


def test_feedback_needs_state(spark):
    stamp = lambda minute: datetime(2024, 1, 1, minute // 60, minute % 60)
    data = [(i, "p", "flag", None, "ip", stamp(m)) for i, m in enumerate([0, 40, 70, 100, 131])]
    data.append((9, "p", "correction", None, "ip", stamp(300)))
    data.append((10, "zz", "flag", None, "ip", stamp(300)))
    schema = "id long, post_id string, feedback_type string, corrected_category string, user_ip string, submitted_at timestamp"
    posts = spark.createDataFrame([("p",)], "post_id string")
    got = rows(M.accept_feedback(spark.createDataFrame(data, schema), posts), "id", "accepted")
    # 40 is refused and does not block 70; 100 is refused by 70; 131 passes again.
    assert got == [(0, True), (1, False), (2, True), (3, False), (4, True), (9, False), (10, False)]
    stored = spark.createDataFrame([(77, "p", "flag", None, "ip", stamp(20))], schema)
    again = M.accept_feedback(spark.createDataFrame(data[1:3], schema), posts, stored)
    assert rows(again, "id", "accepted") == [(1, False), (2, False)]


def test_labels(spark):
    posts = spark.createDataFrame(
        [("1", "Todos a las calles, hay que actuar ya."), ("2", "Hoy SÁNCHEZ y el PSOE en el Congreso"), ("3", "hola"), ("4", "la vacuna es segura"), ("5", "Puro bulo es falso")],
        "post_id string, content string",
    )
    got = {r["post_id"]: (r["categories"], r["primary_category"], r["entities"]) for r in L.label(posts).collect()}
    assert got["1"][:2] == (["call_to_action"], "call_to_action")
    assert got["2"] == (["political_general"], "political_general", ["personas:sánchez", "partidos:psoe"])
    assert got["3"] == ([], "non_political", [])
    assert got["4"][0] == []
    assert got["5"][0] == []  # the exclusion behind the rule holds


def test_label_matches_context(spark):
    text = "Antes de todo, nos dicen que la MARCHA el domingo será larga y tranquila"
    posts = spark.createDataFrame([("1", text)], "post_id string, content string")
    r = L.label_matches(posts).filter("category = 'call_to_action'").first()
    assert r["matched"] == "marcha el domingo"
    assert r["context"] == text[max(0, r["start_pos"] - 20):r["end_pos"] + 20].strip()


def test_malformed_html_stays_a_row(spark):
    pages = spark.createDataFrame([("1", "<a href='/u/status/5'>", "u"), ("2", "<<<", "u"), ("3", None, "u")], "page_id string, html string, username string")
    assert rows(L.parse_post_html(pages), "page_id", "status") == [("1", "ok"), ("2", "failed"), ("3", "failed")]


def test_statistics_year_option(spark):
    claims = spark.createDataFrame([(1, "El PIB creció", 3.0, 2020), (2, "El PIB creció", 3.0, 2021)], "claim_id long, route_text string, value double, year int")
    stats = spark.createDataFrame([("Eurostat", "gdp_growth", 2020, 3.2)], "source string, indicator string, year int, value double")
    assert rows(G.check_statistics(claims, stats), "claim_id", "verified") == [(1, True), (2, True)]
    assert rows(G.check_statistics(claims, stats, match_year=True), "claim_id", "verified") == [(1, True), (2, False)]


def test_adaptive_windows_tile_the_range(spark):
    data = [("u", datetime(2024, 1, 1 + d)) for d in range(20) for _ in range(d)]
    posts = spark.createDataFrame(data, "username string, post_ts timestamp")
    windows = spark.sql("SELECT 'u' AS username, DATE '2024-01-01' AS start_date, DATE '2024-01-21' AS end_date")
    got = sorted((r["start_date"], r["end_date"], r["n_posts"]) for r in H.adaptive_windows(posts, windows, threshold=25).collect())
    assert [a[1] for a in got[:-1]] == [b[0] for b in got[1:]]
    assert (str(got[0][0]), str(got[-1][1]), sum(g[2] for g in got)) == ("2024-01-01", "2024-01-21", 190)
    assert all(n < 25 or (e - s).days == 1 for s, e, n in got)


def test_odd_white_space_and_letters(spark):
    """Short texts are short without any white space; ı and ſ fold as they do in the rules."""
    posts = spark.createDataFrame([("1", "bulo\n"), ("2", "\t\n bulo \r")], "post_id string, content string")
    assert [r["categories"] for r in L.label(posts).collect()] == [[], []]
    texts = spark.createDataFrame([("\n\t", "local"), ("out", "local"), (None, "local"), (" ", "")], "e string, l string")
    assert [r[0] for r in texts.select(C.best_explanation(F.col("e"), F.col("l"))).collect()][:3] == ["local", "out", "local"]
    said = spark.createDataFrame([("1", "5 mıllones de"), ("2", "ſegún fuentes varias ayer,")], "post_id string, content string")
    assert {r["post_id"] for r in K.extract_matches(said).collect()} == {"1", "2"}
    odd = spark.createDataFrame([("ﬁn x² Ａ",), ("Ünï",), (None,), ("ASCII",)], "content string")
    assert [r[0] for r in odd.select(L.normalize("content")).collect()] == ["fin x2 a", "ünï", "", "ascii"]


def test_nothing_is_cut(spark):
    """Values behind the old cuts still count."""
    page = spark.createDataFrame([("<p>" + "x" * 3000 + "</p>",)], "html string")
    assert page.select(F.length(C.page_text(F.col("html")))).first()[0] == 3000
    claims = spark.createDataFrame([("c", "creció un 3", "y" * 250 + " el PIB creció")], "claim_id string, claim_text string, post_text string")
    stats = spark.createDataFrame([("Eurostat", "gdp_growth", 2020, 3.0)], "source string, indicator string, year int, value double")
    assert rows(G.verify_numeric(claims, stats), "claim_id", "verdict") == [("c", "verified")]
    names = " ".join(n for _, n in CATEGORIES.ENTITIES)
    tags = spark.createDataFrame([("1", names)], "post_id string, content string").select(L.entity_tags(F.col("content"))).first()[0]
    assert len(tags) > 10


def test_files_round_trip(spark, tmp_path):
    """Typed load and both export writers, through files."""
    base = str(tmp_path)
    post = [("1", 'a, "b"\nc', "https://x/1", AS_OF), ("2", None, None, AS_OF)]
    spark.createDataFrame(post, "post_id string, content string, url string, at string").selectExpr("post_id", "content", "url", "timestamp(at) as post_ts", "2L as likes").write.parquet(f"{base}/posts")
    done = [("1", "u", "general", '["general"]', '{"overall_verdict": "verified"}', AS_OF), ("3", "v", "ERROR", "broken", None, AS_OF)]
    spark.createDataFrame(done, "post_id string, author_username string, category string, categories_detected string, verification_data string, at string").selectExpr("* except (at)", "timestamp(at) as analysis_ts").write.parquet(f"{base}/content_analyses")
    tables = S.load(spark, base)
    assert {n: t.schema.simpleString() for n, t in tables.as_dict().items() if n not in ("posts",)} == {n: spark.createDataFrame([], S.SCHEMAS[n]).schema.simpleString() for n in S.SCHEMAS if n != "posts"}
    assert rows(tables.posts, "post_id", "likes", "is_thread_start")[0][:2] == ("1", 2) and tables.post_edits.count() == 0
    M.export_csv(tables.content_analyses, tables.posts, f"{base}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{base}/csv")
    assert back.columns == list(M.CSV_COLUMNS) and [(r["Post ID"], r["Post Content"]) for r in back.collect()] == [("1", post[0][1])]
    M.export_json(tables.content_analyses, tables.posts, f"{base}/json", as_of())
    data = {r.post_id: r for r in spark.read.json(f"{base}/json/data").collect()}
    assert data["1"].post_content == post[0][1] and data["1"].verification_data.overall_verdict == "verified" and data["3"].category == "ERROR"
    assert spark.read.json(f"{base}/json/envelope").first().total_records == 2
