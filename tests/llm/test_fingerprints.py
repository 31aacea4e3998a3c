"""Fingerprints against plain sets of digests."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from plazalens.llm import fingerprints as fp
from plazalens.llm.common import table


def jaccard(a, b):
    x, y = (set(fp.Digests(pa.array([t or ""])).values.tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def check(docs, key=lambda d: d.doc_id):
    source = sorted(docs.select("doc_id", "text").collect(), key=key, reverse=True)
    got = {r.doc_id: r for r in fp.report(docs).collect()}
    assert len(got) == len(source)
    for d, following in zip(source, source[1:] + source[:1]):
        text, other = d.text or "", following.text or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(text, changed)) and r.near_next == pytest.approx(jaccard(text, other))
    for a in source:
        for b in source:
            if a.text == b.text:
                assert got[a.doc_id].fingerprint == got[b.doc_id].fingerprint
    return got


def test_small(spark, monkeypatch):
    monkeypatch.setattr(fp.with_guests, "__defaults__", (6,))
    rng = random.Random(1)
    line = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n))
    texts = [None, "", " ", "x", "🙂é" * 7, "one line\n" * 9, *("\n".join(line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 40))) for _ in range(40))]
    texts += [texts[10], texts[10] + "\nmore", line(9000)]
    docs = spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, guest string").repartition(6)
    got = check(docs)
    assert got[3 * (len(texts) - 2)].near_next < got[3 * 10].near_edited + 1
    assert fp.report(docs.limit(0)).collect() == []
    one = fp.report(docs.where("doc_id = 30")).collect()
    assert [r.near_next for r in one] == [1.0]


def test_ties_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "c")], "doc_id long, text string")
    assert fp.report(docs).count() == 5


def test_peeling_gives_up_only_for_larger_sketches():
    a = pa.array([" ".join(f"w{i}" for i in range(n)) for n in (5, 300, 4000)])
    b = pa.array([" ".join(f"w{i}" for i in range(7, n)) for n in (5, 340, 9000)])
    x, y = fp.Digests(a), fp.Digests(b)
    only_a, only_b = fp.difference(x, y, np.arange(3), np.arange(3))
    for i in range(3):
        s, t = (set(d.of(np.array([i]))[0].tolist()) for d in (x, y))
        assert (only_a[i], only_b[i]) == (len(s - t), len(t - s))


def test_documents(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"))
