"""Language ID and toxicity: held-out quality, and phrases against a search in plain Python."""

import random

import numpy as np
import pytest

from plazalens.llm import language, toxicity
from plazalens.llm.common import held_out, table

SCHEMA = "doc_id long, text string, lang string, source string, score double, toxic int"


def brute_phrases(sample: bytes, text: bytes) -> int:
    """Greedy longest phrases of a segment; only bytes that break a running phrase count."""
    count, at = 0, 0
    phrase = b""
    while at < len(text):
        one = text[at : at + 1]
        if phrase + one in sample:
            phrase += one
        else:
            count += 1
            phrase = one if one in sample else b""
        at += 1
    return count


@pytest.mark.parametrize("seed", range(4))
def test_phrases(seed):
    rng = random.Random(seed)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    samples = (("a", make(400, "abcd ").encode()), ("b", make(300, "abé ").encode()))
    model = language.Model(samples)
    texts = [make(n, "abcdé ExZ9!") for n in (0, 1, 5, 127, 128, 129, 700)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    places = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    rates = model.rates(data, places)
    for i, t in enumerate(texts):
        raw = language.folded(np.frombuffer(t.encode(), np.uint8)).tobytes()
        for k, (_, s) in enumerate(samples):
            want = sum(brute_phrases(s, raw[j : j + language.SEGMENT]) for j in range(0, len(raw), language.SEGMENT))
            assert round(rates[i, k] * max(1, len(raw))) == want


def test_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


EDGE = [(None, "plain words", None, None, None, None), (1, None, "en", None, None, 1), (2, "", "en", None, None, 1), (3, " 12 ### \n", None, None, None, None), (4, "x" * 300_000, "en", "s", 1.0, None), (4, "x" * 300_000, "en", "s", 1.0, None)]


def test_language_edges(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    rows = language.report(docs).collect()
    und = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == len(EDGE) and und[1] == und[2] == und[3] == ("und", 0.0) and und[4][0] == "en"
    nothing = docs.where("lang is null")
    assert {r.lang_pred for r in language.report(nothing).collect()} == {"und"}
    assert language.report(docs.limit(0)).collect() == []
    kept = language.accepted(docs)
    # The only labelled text has the letter x alone, so that "plain words" is strange.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4"] and kept.columns == docs.columns
    assert language.accepted(nothing).count() == 1


def test_toxicity(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = toxicity.report(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    bad, good = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= 0.9
    assert np.mean([g >= 0.3 for g in good]) <= 0.05


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (4, 0, None), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.report(docs, one).count() == len(EDGE)
    assert toxicity.report(docs.limit(0), one).collect() == []


def test_features_follow_the_text():
    import pyarrow as pa

    known = {"idiot": 4.0, "achlich-": 3.0}
    rows = toxicity.features(pa.array([None, "", "You are an IDIOT!!", "1d10t achlichung", "calm words", "an id1ot"]), known)
    names = toxicity.FEATURES
    assert rows.shape == (6, len(names)) and not rows[0].any() and not rows[1].any()
    at = names.index
    assert rows[2, at("lexicon_share")] == 0.25 and rows[2, at("second_near")] == 0.25 and rows[2, at("exclaimed")] > 0
    assert rows[5, at("obfuscated_hits")] == 1 and rows[3, at("beginning_share")] == 0.5
    assert not rows[4, at("lexicon_share") : at("capital_share")].any()


def test_split(spark):
    import zlib

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
