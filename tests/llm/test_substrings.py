"""Substring dedup against counting every window in plain Python."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from plazalens.llm import substrings
from plazalens.llm.common import table


def brute(texts):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    n = substrings.WINDOW
    count = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), sha256(kept).hexdigest()))
    return out


def check(docs):
    source = docs.select("doc_id", "text").collect()
    want = sorted((d.doc_id is None, d.doc_id or 0, *b) for d, b in zip(source, brute([d.text for d in source])))
    got = substrings.report(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyzß")
    line = [[word() for _ in range(rng.choice([8, 20, 34, 35, 36, 50, 90]))] for _ in range(8)]
    rows = [None, "", " \n\t ", "a " * 34, "b " * 35, "c " * 36, "d e " * 400]
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 7)):
            part = list(rng.choice(line)) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(1, 60))]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            text += part
        rows.append(rng.choice([" ", "\n", "  ", "\x0b"]).join(text))
    return rows + rows[20:24] * 3


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, seed):
    texts = made(seed)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1), (None, texts[30], None, None), (None, texts[30], None, None), (9, texts[31], "x", 1)]
    check(spark.createDataFrame(rows, "doc_id long, text string, anchor string, start int").repartition(5))


def test_spans_and_empty(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b {shared} c"), (2, f"{shared} d")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, [tuple(s) for s in r.spans]) for r in substrings.cut(docs).collect()}
    assert got == {1: ("a b c", [(2, 42)]), 2: ("d", [(0, 40)])}
    assert substrings.cut(docs.limit(0)).collect() == []


def test_documents(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"))
