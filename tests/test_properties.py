"""Randomized checks against brute force in plain Python."""

import random
import re
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plazalens import catalog
from plazalens.functions import limiter
from plazalens.functions.anchors import anchors_of
from plazalens.functions.joins import substring_hits
from plazalens.functions.limiter import admit
from plazalens.functions.scan import by_width, positions, running
from plazalens.operators import claims as C
from plazalens.operators import evidence as E
from plazalens.operators import ingest as H
from plazalens.operators import labels as L
from plazalens.operators import maintain as M
from plazalens.operators import reports as R
from plazalens.rules import phrases as PHRASES
from plazalens.rules.categories import LABEL_RULES
from plazalens.rules.claims import CLAIM_RULES
from plazalens.session import prepare
from plazalens.streaming import jobs as J


def sample(rule: str, rng: random.Random) -> str:
    """A random text that the rule matches, from its parsed form."""
    from re import _parser

    def grow(items) -> str:
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "SUBPATTERN":
                out += grow(arg[3])
            elif name == "BRANCH":
                out += grow(rng.choice(arg[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(grow(inner) for _ in range(rng.randint(low, min(int(high), low + 1))))
            elif name == "IN":
                kind, what = arg[0]
                out += {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "x", "CATEGORY_DIGIT": "7"}.get(str(what)) or chr(what if str(kind) == "LITERAL" else what[0])
            elif name == "ANY":
                out += " "
        return out

    return grow(list(_parser.parse(rule)))


def test_anchors_are_necessary():
    rng = random.Random(7)
    checked = 0
    for rules in LABEL_RULES.values():
        for rule in rules:
            need, pattern = anchors_of(rule), re.compile(rule, re.IGNORECASE)
            for _ in range(60):
                text = f"aa {sample(rule, rng)} zz".lower()
                if not pattern.search(text):
                    continue
                checked += 1
                heads = set(re.findall(r"\b\w{4}", text))
                assert need.always or need.heads & heads or any(p in text for p in need.parts), (rule, text)
    assert checked > 5000


def test_labels_equal_plain_regex(spark):
    rng = random.Random(11)
    every = [r for rules in LABEL_RULES.values() for r in rules]
    texts = [" ".join(sample(rng.choice(every), rng) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    posts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "post_id string, content string")
    compiled = {c: [re.compile(r, re.IGNORECASE) for r in rules] for c, rules in LABEL_RULES.items()}
    got = {r["post_id"]: r["categories"] for r in L.with_categories(posts).collect()}
    for i, text in enumerate(texts):
        want = [c for c, rules in compiled.items() if any(r.search(text.lower()) for r in rules)] if len(text.strip()) >= 5 else []
        assert got[str(i)] == want, text


def test_chunked_scans(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), n, rng.randint(0, 9)) for n in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "k string, n long, v long")
    order, chunk = [F.col("n")], by_width(F.col("n"), 37)
    out = running(df, ["k"], order, chunk, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    prev = running(df, ["k"], order, chunk, {"p": ("max", F.col("n"))}, exclusive=True)
    pos = positions(df, ["k"], order, chunk)
    sums = {(r["k"], r["n"]): (r["s"], r["m"]) for r in out.collect()}
    prevs = {(r["k"], r["n"]): r["p"] for r in prev.collect()}
    places = {(r["k"], r["n"]): r["pos"] for r in pos.collect()}
    for k in "ab":
        mine = sorted((n, v) for kk, n, v in data if kk == k)
        for i, (n, _) in enumerate(mine):
            values = [v for _, v in mine[:i + 1]]
            assert sums[k, n] == (sum(values), max(values))
            assert prevs[k, n] == (mine[i - 1][0] if i else None)
            assert places[k, n] == i + 1


def test_limiter_is_exact_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(limiter, "SMALL_LOG", 0)
    rng = random.Random(5)
    base = datetime(2024, 1, 1)
    data = [(i, rng.choice(["hot", "hot", "hot", "cold"]), base + timedelta(seconds=rng.randint(0, 3000))) for i in range(600)]
    log = spark.createDataFrame(data, "event_id long, key string, ts timestamp")
    out = admit(log, ["key"], "ts", ["event_id"], F.lit(3), F.lit(60), chunk_seconds=90)
    got = {r["event_id"]: r["admitted"] for r in out.collect()}
    for key in ("hot", "cold"):
        passed = []
        for i, _, ts in sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0])):
            ok = sum(1 for p in passed if p > ts - timedelta(seconds=60)) < 3
            assert got[i] is ok
            if ok:
                passed.append(ts)


def test_request_volume_counts_across_chunks(spark):
    rng = random.Random(9)
    base = datetime(2024, 1, 1)
    data = [(i, "k", rng.choice(["a", "b"]), base + timedelta(seconds=rng.randint(0, 900))) for i in range(300)]
    log = spark.createDataFrame(data, "event_id long, key string, endpoint string, ts timestamp")
    limits = {"a": (2, 60), "b": (5, 100)}
    got = {r["event_id"]: r["in_window"] for r in H.request_volume(log, limits, chunk_seconds=70).collect()}
    for i, _, e, ts in data:
        want = sum(1 for _, _, e2, t2 in data if e2 == e and ts - timedelta(seconds=limits[e][1]) < t2 <= ts)
        assert got[i] == want


def test_substring_hits(spark):
    rng = random.Random(2)
    words = ["ab", "abc", "a", "bca", "cab", "zz"]
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(4)) for _ in range(60)]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["word"]) for r in substring_hits(w, t).collect()}
    assert got == {(i, x) for i, text in enumerate(texts) for x in words if x in text}


def test_upserts_are_idempotent(spark):
    schema = "post_id string, content string, username string, post_type string, likes long, thread_id string"
    rng = random.Random(4)
    row = lambda i: (str(i), f"c{rng.randint(0, 3)}", "u", rng.choice(["original", "thread"]), rng.randint(0, 9), rng.choice([None, "t"]))
    current = spark.createDataFrame([row(i) for i in range(30)], schema)
    incoming = spark.createDataFrame([row(i) for i in range(15, 45)], schema)
    once = M.upsert_posts(current, incoming)
    twice = M.upsert_posts(once, incoming)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    first = M.upsert_analyses(current, incoming, [F.col("likes").desc()])
    again = M.upsert_analyses(first, incoming, [F.col("likes").desc()])
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    batch = M.clean_batch(incoming.unionByName(incoming), [F.col("likes")])
    assert batch.count() == 30


def test_split_cuts_at_the_share(spark, monkeypatch):
    monkeypatch.setattr(R, "RANKED_ROWS", 10)
    ids = random.Random(6).sample(range(100_000), 997)
    df = spark.createDataFrame([(i,) for i in ids], "n long")
    train = {r["n"] for r in R.split_by_order(df, "n", 0.8, chunks=16).filter("is_train").collect()}
    assert train == set(sorted(ids)[:int(997 * 0.8)])


def test_breach_stream_equals_batch(spark, tmp_path):
    """Shuffled files, one a micro-batch: late rows meet newer ones that came first."""
    rng = random.Random(8)
    base = datetime(2024, 1, 1)
    data = [(i, "k", "api", base + timedelta(seconds=rng.randint(0, 400))) for i in range(200)]
    rng.shuffle(data)
    log = spark.createDataFrame(data, "event_id long, key string, endpoint string, ts timestamp")
    limits = {"api": (4, 60)}
    for part in range(4):
        spark.createDataFrame(data[part * 50:][:50], log.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    J.end_mark(log, 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.append_to(J.breach_stream(stream, limits, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"), settings=J.ROCKS_STORE).awaitTermination()
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["event_id"] for r in H.rate_breaches(log, limits).collect())


def test_long_windows_and_busy_clients(spark):
    """Windows over a million seconds keep their values; a busy client needs one checkpoint, however
    many days it is busy."""
    base = datetime(2024, 1, 1)
    data = [(i, "k", "api", base + timedelta(hours=7 * i)) for i in range(300)]
    log = spark.createDataFrame(data, "event_id long, key string, endpoint string, ts timestamp")
    limits = {"api": (5, 2_592_000)}
    wanted, passed = [], []
    for i, _, _, t in data:
        passed = [p for p in passed if p > t - timedelta(seconds=2_592_000)]
        if len(passed) < 5:
            passed.append(t)
        else:
            wanted.append(i)
    assert sorted(r["event_id"] for r in H.rate_breaches(log, limits).collect()) == wanted
    assert {(r["max_requests"]) for r in H.request_volume(log, limits).collect()} == {5}


def test_stream_upsert_replay(spark, tmp_path):
    schema = "post_id string, content string, username string, post_type string, likes long, thread_id string, n long"
    stored = spark.createDataFrame([("1", "a", "u", "original", 1, "t", 0)], schema)
    batch = spark.createDataFrame([("1", "b", "x", "original", 2, None, 1), ("2", "c", "u", "original", 3, None, 2), ("2", "d", "u", "original", 4, None, 3)], schema)
    path = str(tmp_path / "posts")
    J.create_table(stored, path, buckets=4)
    for _ in range(2):
        J.upsert_batch(batch, path, [F.col("n")], stored.schema, 0, buckets=4)
    got = sorted((r["post_id"], r["content"], r["username"], r["thread_id"]) for r in J.read_table(spark, path, stored.columns).collect())
    assert got == [("1", "b", "u", "t"), ("2", "c", "u", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_searches_keep_the_best_of_all_pairs(spark, seed):
    """Both top-k searches against ranking the full set of pairs."""
    from plazalens.operators import evidence as G

    rng = random.Random(seed)
    words = ["de", "la", "que", "y"] * 6 + [f"palabra{i}" for i in range(40)] + ["pib", "desempleo", "vacuna", "ab", "paro"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    queries = spark.createDataFrame([(f"q{i}", text(rng.randrange(0, 7))) for i in range(60)] + [("q60", None)], "query_id string, query string")
    rows = [(f"a{i:03}", text(rng.randrange(0, 4)), text(rng.randrange(0, 30)), rng.choice(["Maldita", "Newtral", "El País"]), rng.choice([0.2, 0.5, None]), f"2024-01-{rng.randrange(1, 29):02}") for i in range(120)]
    articles = spark.createDataFrame(rows, "article_id string, title string, description string, source_name string, confidence double, day string").repartition(3)
    for k in (1, 3):
        every = {tuple(r) for r in G.rank_articles(queries, articles, None).filter(f"rank <= {k}").select("query_id", "article_id", "relevance", "rank").collect()}
        best = {tuple(r) for r in G.rank_articles(queries, articles, k).select("query_id", "article_id", "relevance", "rank").collect()}
        assert best == every
        checks = articles.selectExpr("article_id as check_id", "concat_ws(' ', title, description) as claim", "'Falso' as verdict", "confidence", "source_name", "to_date(day) as publication_date")
        claims = queries.selectExpr("query_id as claim_id", "query as claim_text")
        order = ["claim_id", "check_id", "source_name", "relevance"]
        w = "row_number() over (partition by claim_id, source_name order by confidence desc, publication_date desc, check_id)"
        whole = G.match_fact_checks(claims, checks, None).selectExpr(*order, f"{w} as place").filter(f"place <= {k}").select(*order)
        assert {tuple(r) for r in G.match_fact_checks(claims, checks, k).select(*order).collect()} == {tuple(r) for r in whole.collect()}


def test_upsert_survives_a_failure(spark, tmp_path, monkeypatch):
    """Three batches with repeats; every one is written, fails after it and runs again, or fails before it is written."""
    schema = "post_id string, content string, username string, post_type string, likes long, thread_id string, n long"
    stored = spark.createDataFrame([(str(i), "old", "u", "original", i, "t", 0) for i in range(20)], schema)
    batches = [[(str(i), f"b{k}", "x", "original", k, None, k) for i in range(5 * k, 5 * k + 15)] for k in range(3)]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    paths = [str(tmp_path / name) for name in ("plain", "failing")]
    for path in paths:
        J.create_table(stored, path, buckets=4)
    append = J._append
    for number, frame in enumerate(frames):
        J.upsert_batch(frame, paths[0], [F.col("n")], stored.schema, number, 4)
        monkeypatch.setattr(J, "_append", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            J.upsert_batch(frame, paths[1], [F.col("n")], stored.schema, number, 4)
        monkeypatch.setattr(J, "_append", append)
        for _ in range(2):
            J.upsert_batch(frame, paths[1], [F.col("n")], stored.schema, number, 4)
    tables = [sorted(map(tuple, J.read_table(spark, p, stored.columns, stored.schema).collect())) for p in paths]
    assert tables[0] == tables[1] and {r[1] for r in tables[0]} == {"b0", "b1", "b2"}
    assert tables[0] == sorted(map(tuple, M.upsert_posts(M.upsert_posts(M.upsert_posts(stored, frames[0]), frames[1]), frames[2]).collect()))
    written = spark.read.parquet(paths[0]).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in written} == {-1: 20, 0: 15, 1: 15, 2: 15}  # a batch writes the rows it touches
    J.create_table(J.read_table(spark, paths[0], stored.columns), str(tmp_path / "compact"), buckets=4)
    assert sorted(map(tuple, J.read_table(spark, str(tmp_path / "compact"), stored.columns).collect())) == tables[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_outcomes_of_chunks_equal_one_replay(seed):
    """States passed from chunk to chunk, and through compositions of chunks, are those of a sequential replay."""
    rng = random.Random(seed)
    for _ in range(60):
        n, window, rows = rng.randrange(1, 5), rng.choice([5, 17, 60]), rng.randrange(1, 400)
        size = rng.choice([window, 2 * window, 100])
        times = np.sort(np.array([rng.randrange(rng.choice([300, 1500])) for _ in range(rows)], np.int64))
        passed, all_passed = deque(), []
        for t in times.tolist():
            while passed and passed[0] <= t - window:
                passed.popleft()
            if len(passed) < n:
                passed.append(t)
                all_passed.append(t)
        assert [t for t, ok in zip(times.tolist(), limiter.replay(times.tolist(), n, window, deque())) if ok] == all_passed
        chunks = [(c * size, times[times // size == c]) for c in range(int(times.max()) // size + 1)]
        tables = [(begin, limiter.Outcome.of(t, n, window, begin, limiter._depth(n, 1))) for begin, t in chunks if len(t)]
        for width in (1, 4):
            state = np.full((1, n), limiter.NEVER)
            for k in range(0, len(tables), width):
                assert [t for t in state[0].tolist() if t > limiter.NEVER] == [t for t in all_passed if t < tables[k][0]][-n:]
                whole = tables[k][1]
                for _, later in tables[k + 1 : k + width]:
                    whole = whole.then(later, n, window, limiter._depth(n, 0))
                _, state = whole.after(state, n, window, n)


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_a_client_always_at_its_limit(spark, monkeypatch, small):
    """64 days without a pause: every day is a chunk of its own, and null keys are a key."""
    monkeypatch.setattr(limiter, "SMALL_LOG", small)
    base = datetime(2024, 1, 1)
    rng = random.Random(3)
    data = [(i, key, "api", base + timedelta(minutes=20 * i + rng.randrange(20))) for key in ("hot", None) for i in range(64 * 72)]
    log = spark.createDataFrame([(n, *d[1:]) for n, d in enumerate(data)], "event_id long, key string, endpoint string, ts timestamp").repartition(6)
    wanted = set()
    for key in ("hot", None):
        passed = deque()
        for n, d in enumerate(data):
            if d[1] == key:
                while passed and passed[0] <= d[3] - timedelta(hours=5):
                    passed.popleft()
                if len(passed) < 3:
                    passed.append(d[3])
                else:
                    wanted.add(n)
    got = [r["event_id"] for r in H.rate_breaches(log, {"api": (3, 18_000)}).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    refused_all = H.rate_breaches(log.limit(50), {"api": (0, 60)})
    assert refused_all.count() == 50


def test_feedback_against_stored_rows(spark):
    """Any stored row of the hour before refuses, whether or not it would pass the limit itself."""
    rng = random.Random(12)
    base = datetime(2024, 1, 1)
    stamp = lambda minute: base + timedelta(minutes=minute)
    schema = "id long, post_id string, feedback_type string, corrected_category string, user_ip string, submitted_at timestamp"
    posts = spark.createDataFrame([("p",), ("q",)], "post_id string")
    stored = [(1000 + i, rng.choice("pq"), "flag", None, rng.choice(["a", "b", None]), stamp(rng.randrange(6000))) for i in range(60)]
    stored += [(1, "p", "flag", None, "c", stamp(0)), (2, "p", "flag", None, "c", stamp(30))]
    data = [(i, rng.choice("pq"), "flag", None, rng.choice(["a", "b", None]), stamp(rng.randrange(6000))) for i in range(300)]
    data.append((500, "p", "flag", None, "c", stamp(75)))
    got = {r["id"]: r["accepted"] for r in M.accept_feedback(spark.createDataFrame(data, schema), posts, spark.createDataFrame(stored, schema)).collect()}
    assert got[500] is False
    accepted = {}
    for i, post, _, _, ip, at in sorted(data, key=lambda d: (d[5], d[0])):
        recent = any(s[1] == post and s[4] == ip and at - timedelta(hours=1) < s[5] <= at for s in stored)
        last = accepted.get((post, ip))
        ok = not recent and (last is None or at - last >= timedelta(hours=1))
        if ok:
            accepted[post, ip] = at
        assert got[i] is ok, i


def test_verification_uses_every_hit(spark):
    """A text is judged by all fact checks and articles that are related to it, by default without a limit per source."""
    from plazalens.plans.lifecycles import judge_texts

    rng = random.Random(21)
    words = [f"palabra{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = spark.createDataFrame([(f"t{i}", text(3)) for i in range(12)], "text_id string, claim_text string")
    day = datetime(2024, 1, 1)
    checks = spark.createDataFrame(
        [(f"c{i}", text(6), rng.choice(["Falso", "true"]), 0.9, "Maldita", day, text(5), f"https://a/{i}") for i in range(40)],
        "check_id string, claim string, verdict string, confidence double, source_name string, publication_date timestamp, explanation string, url string",
    )
    articles = spark.createDataFrame(
        [(f"n{i}", text(2), text(5), text(5), "ABC", f"https://b/{i}", day) for i in range(40)],
        "article_id string, title string, description string, content string, source_name string, url string, publication_date timestamp",
    )
    as_of = F.lit(datetime(2024, 6, 1))
    held = lambda asked, body: any(w in body for w in asked.split())
    want = {
        t.text_id: sum(held(t.claim_text, c.claim) for c in checks.collect()) + sum(held(t.claim_text, f"{n.title} {n.description}") for n in articles.collect())
        for t in texts.collect()
    }
    verdicts, urls = judge_texts(texts, checks, articles, as_of)
    rows = {r["text_id"]: r for r in verdicts.collect()}
    assert max(want.values()) > 6 and {t: r["n_evidence"] for t, r in rows.items()} == {t: n for t, n in want.items() if n}
    assert all(len(r["sources"]) == min(5, r["n_evidence"]) for r in rows.values())
    assert urls.count() == sum(want.values())
    few, _ = judge_texts(texts, checks, articles, as_of, per_source=1)
    assert max(r["n_evidence"] for r in few.collect()) == 2


def test_label_stream_of_a_table_in_many_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    label = catalog.queries()["H11_label_stream"]
    got = [tuple(r) for r in label(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(tuple(r) for r in label(spark, "/root/testdata/sf0.001").collect())
    assert len(got) == docs.count()


def test_event_indicators_list_every_claim(spark, monkeypatch):
    """Claims with one person and event are rows of their own, however many shares they are dealt into."""
    monkeypatch.setattr(E, "ASKED_TOGETHER", 2)
    claims = spark.createDataFrame([(i, "Ana" if i < 7 else "Eva", "arrest") for i in range(9)], "claim_id long, person_name string, event_type string")
    pages = spark.createDataFrame([(1, "ANA arrest falso"), (2, "ana: arrest"), (3, "eva"), (4, "Eva arrest, confirmado")], "page_id long, html string")
    got = sorted(tuple(r) for r in E.event_indicators(claims, pages).select("claim_id", "page_id", "contradicts", "confirms").collect())
    assert got == sorted([(i, p, p == 1, False) for i in range(7) for p in (1, 2)] + [(i, 4, False, True) for i in (7, 8)])


def test_event_indicators_shuffle_blocks_only(spark, monkeypatch):
    """Blocks of claims meet blocks of pages, in passes over the probes; repeats and nulls are rows as they were."""
    for name, value in (("ASKED_TOGETHER", 3), ("PAGES_TOGETHER", 2), ("PROBES_PASS", 2), ("PAGES_HELD", 5), ("PAIRS_BATCH", 4)):
        monkeypatch.setattr(E, name, value)
    kinds = [("Ana Ruiz", "arrest"), ("eva", "ARREST"), ("eva", ""), (" ", "arrest"), ("Eva", None), (None, "arrest"), ("ana", "trial")]
    asked = [(i if i % 9 else None, *kinds[i % len(kinds)]) for i in range(40)]
    texts = ["ana ruiz: arrest", "EVA ana", "Eva arrest, confirmado", "nothing", "ana RUIZ trial falso arrest", None]
    pages = [(f"p{i % 20}" if i != 7 else None, texts[i % len(texts)]) for i in range(30)]
    wanted = []
    for claim, person, event in asked:
        for page, html in pages:
            if page and html and person and person.strip() and event is not None and person.lower() in html.lower() and event.lower() in html.lower():
                wanted.append((claim, page, "falso" in html, "confirmado" in html))
    found = E.event_indicators(
        spark.createDataFrame(asked, "claim_id long, person_name string, event_type string"), spark.createDataFrame(pages, "page_id string, html string")
    )
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, wanted)) and len(wanted) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan and plan.count("MapInArrow") > 1
    nobody = spark.createDataFrame([], "claim_id long, person_name string, event_type string")
    assert not E.event_indicators(nobody, spark.createDataFrame(pages, "page_id string, html string")).count()


def test_spans_behind_marks_and_dotted_letters(spark):
    """A combining mark is no word character to the rules, and a capital I with a dot is an i to them."""
    texts = ["caféporque llueve mucho y hace frío. ", "expertos İndican esto", "x́según el informe largo, hoy"]
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, content string")
    got = sorted((r["post_id"], r["claim_type"], r["claim_text"]) for r in C.extract_matches(df).collect())
    wanted = sorted(
        (i, kind, hit.group())
        for i, text in enumerate(texts) for kind, (_, rules) in CLAIM_RULES.items() for rule in rules for hit in re.finditer(rule, text, re.IGNORECASE)
    )
    assert got == wanted and {i for i, _, _ in got} == {0, 1, 2}


def test_breaches_call_the_state_by_batch_not_by_request():
    calls = []

    class State:
        def __init__(self):
            self.held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("get", "getValue"):
                    return iter(self.held or []) if isinstance(self.held, list) else self.held
                if name in ("exists", "containsKey"):
                    return self.held is not None
                self.held = args[-1] if args else None

            return call

    class Handle:
        def __getattr__(self, name):
            return (lambda *args: State()) if name.startswith("get") else lambda *args: calls.append(name)

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 10_000_000_000_000

    states = J._Breaches({"api": (4, 60)}, 1 << 30)
    states.init(Handle())
    rows = pd.DataFrame({"event_id": range(500), "ts": pd.to_datetime([3 * i for i in range(500)], unit="s")})
    assert not list(states.handleInputRows(("k", "api"), iter([rows]), Clock()))
    assert len(calls) <= 4
    due = type("Due", (), {"getExpiryTimeInMs": lambda self: 1 << 40})()
    refused = pd.concat(states.handleExpiredTimer(("k", "api"), Clock(), due))
    assert len(refused) == 500 - 100 and len(calls) <= 10


def test_relevant_articles_by_blocks(spark, monkeypatch):
    """Blocks of queries and articles give every pair once, with repeats of words and topic families."""
    monkeypatch.setattr(L, "ASKED_BLOCK", 3)
    monkeypatch.setattr(L, "HELD_BLOCK", 4)
    rng = random.Random(11)
    words = ["a", "ab", "casa", "pib", "covid", "vacuna", "sol", "crecimiento", "x"]
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(20)]
    texts = [(100 + i, "t", " ".join(rng.choice(words[1:]) for _ in range(rng.randint(0, 3)))) for i in range(30)]
    wanted = []
    for q, text in asked:
        parts = text.split()
        topic = next((i for i, (asks, _) in enumerate(PHRASES.TOPIC_FAMILIES) if any(w in text for w in asks)), None)
        for a, title, body in texts:
            whole = f"{title} {body}"
            n = sum(w in whole for w in parts)
            if n or topic is not None and any(w in whole for w in PHRASES.TOPIC_FAMILIES[topic][1]):
                wanted.append((q, a, n / len(parts)))
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = L.relevant_articles(queries, spark.createDataFrame(texts, "article_id long, title string, description string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)


def test_relevant_articles_shuffle_bits_and_round_once(spark, monkeypatch):
    """What an article holds is a bit for each word, in passes and slices of words; rounding is not a step over pairs."""
    monkeypatch.setattr(L, "WORDS_PASS", 16)
    monkeypatch.setattr(L, "WORDS_SLICE", 8)
    monkeypatch.setattr(L, "HELD_BLOCK", 16)
    rng = random.Random(5)
    words = [a + b for a in "abcdef" for b in ("", "a", "eb", "é")] + ["pib", "x\x1cy"]
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))) for i in range(30)]
    texts = [(f"t{i}", "x", "\u2003".join("".join(rng.choice(words) for _ in range(2)) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    texts += texts[:5] + [(None, "x", "a b")]
    topics = {w for w in PHRASES.TOPIC_FAMILIES[1][1]}
    wanted = set()
    for q, text in asked:
        parts = text.split(" ")
        for a, title, body in texts:
            n = sum(w in f"{title} {body}" for w in parts)
            if a is not None and (n or "pib" in text and any(w in body for w in topics)):
                wanted.add((q, a, round(n / len(parts), 3)))
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = L.relevant_articles(queries, spark.createDataFrame(texts, "article_id string, title string, description string"), digits=3)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(wanted)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "round(" not in plan and "explode(token" not in plan and "generate explode(split" not in plan
    assert L._share(1, 8, 2) == 0.13 and L._share(2, 3, 6) == 0.666667 and L._share(9, 4, 6) == 1.0


def test_python_workers_get_small_batches(spark):
    """A query's Python pass gets few rows at once, and fewer where texts are long, whatever the session had before."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    def most(length: int) -> int:
        rows = spark.range(0, 4000, 1, 1).select(F.lit("x" * length).alias("t"), F.rand().cast("string").alias("r"))
        return max(r["n"] for r in rows.select(F.concat("t", "r").alias("t")).mapInPandas(sizes, "n long").collect())

    assert most(10) <= 500 and most(100_000) <= 100


def test_large_buckets_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "FILE_ROWS", 100)
    posts = spark.range(4000).select(F.col("id").cast("string").alias("post_id"), F.lit("a").alias("content"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins what is small
    try:
        J.create_table(posts, str(tmp_path / "posts"), buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(len(list(folder.glob("*.parquet"))) > 2 for folder in (tmp_path / "posts" / "batch=-1").glob("bucket=*"))
    assert J.read_table(spark, str(tmp_path / "posts"), ["post_id"]).distinct().count() == 4000


def test_upserts_shuffle_no_stored_rows(spark, tmp_path, monkeypatch):
    """A table's last rows are found by keys and row numbers: a reader shuffles no row, an upsert no replaced column."""
    monkeypatch.setattr(J, "FILE_ROWS", 1 << 20)  # one task writes more than a bitmap holds
    path = str(tmp_path / "posts")
    n = 70_000
    stored = spark.range(n).select(F.col("id").cast("string").alias("post_id"), F.concat(F.lit("c"), "id").alias("content"), F.lit("u").alias("username"), F.lit(None).cast("string").alias("thread_id"))
    stored = stored.unionByName(stored.limit(5)).unionByName(stored.limit(3).withColumn("post_id", F.lit(None).cast("string")))
    J.create_table(stored, path, buckets=2)
    for number in range(2):
        some = spark.range(number, n + 10, 2 + number).select(F.col("id").cast("string").alias("post_id"), F.lit(f"new{number}").alias("content"), F.lit("v").alias("username"), F.lit(f"t{number}").alias("thread_id"), F.lit(0).alias("n"))
        J.upsert_batch(some, path, [F.col("n")], stored.schema, number, 2)
    current = J._touched(spark, path, stored.schema, 9, [0, 1], some)
    assert current.schema.names == stored.columns and "content:string" not in current._jdf.queryExecution().executedPlan().toString()

    def wanted(i: int) -> tuple:
        new = [k for k in range(2) if i >= k and (i - k) % (2 + k) == 0]
        return (str(i), f"new{new[-1]}" if new else f"c{i}", "u" if i < n else "v", f"t{new[-1]}" if new else None)

    rows = [wanted(i) for i in range(n + 10) if i < n or wanted(i)[3]]
    for most in (J.BITMAPS, 0):
        monkeypatch.setattr(J, "BITMAPS", most)
        table = J.read_table(spark, path, stored.columns, stored.schema)
        got = [tuple(r) for r in table.collect()]
        assert len([r for r in got if r[0] is None]) == 1
        assert sorted(r for r in got if r[0] is not None) == sorted(rows)
        assert ("Exchange hashpartitioning" in table._jdf.queryExecution().executedPlan().toString()) == (not most)


def test_texts_are_lowered_once_a_row(spark):
    posts = spark.createDataFrame([("VACUNA y fraude",), (None,), ("",)], "content string")
    for made in (L.topic_tags(F.col("content"), "maldita"), L.found_in_order(F.col("content"), PHRASES.TRIGGER_KEYWORDS)):
        assert made._jc.toString().count("lower(") == 1
        assert [len(r["v"]) for r in posts.select(made.alias("v")).collect()][1:] == [0, 0]
