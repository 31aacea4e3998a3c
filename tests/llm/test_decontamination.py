"""Decontamination against scoring every passage with every segment."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from plazalens.llm import decontamination as dc
from plazalens.llm.common import table

SCHEMA = "doc_id long, text string, item_id long, score string"


def made(seed, n_items=90):
    rng = random.Random(seed)
    rare = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.5 else rare()
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", "?", "!\n"])
    items = [" ".join(sentence(rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6))) for _ in range(n_items)]
    clean = [" ".join(sentence(rng.randrange(3, 25)) for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    leaked = [f"{rng.choice(clean)} {items[i].upper() if i % 2 else items[i]} {rng.choice(clean)}" for i in range(25)]
    half = []  # the question alone is not a leak
    for i in range(25, 40):
        words = dc.terms(items[i])
        half.append(clean[i] + " " + " ".join(words[: dc.question_terms(items[i])]))
    return items, clean, leaked, half


def brute(items, texts):
    segments, owner = [], []
    for k, item in enumerate(items):
        words = dc.terms(item)
        for at in range(0, len(words), dc.SEGMENT):
            segments.append(words[at : at + dc.SEGMENT])
            owner.append(k)
    frequency = Counter(t for s in segments for t in set(s))
    mean = sum(map(len, segments)) / len(segments)

    def weights(s):
        return {
            t: math.log(1 + (len(segments) - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (dc.K1 + 1) / (n + dc.K1 * (1 - dc.B + dc.B * len(s) / mean))
            for t, n in Counter(s).items()
        }

    table_of = [weights(s) for s in segments]
    best = {}
    for row, text in enumerate(texts):
        words = dc.terms(text)
        for at in range(0, max(1, len(words) - dc.SEGMENT), dc.SEGMENT):
            passage = set(words[at : at + dc.PASSAGE])
            for w, k in zip(table_of, owner):
                score = sum(x for t, x in w.items() if t in passage) / sum(w.values())
                if score >= dc.THRESHOLD:
                    best[row, k] = max(best.get((row, k), 0), score)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_retrieval_is_complete(seed, monkeypatch):
    items, clean, leaked, half = made(seed)
    monkeypatch.setattr(dc, "BLOCKS", 7)
    parts = [dc._Segment(k, f"{k:05}", at, dc.question_terms(i), dc.terms(i)[at : at + dc.SEGMENT]) for k, i in enumerate(items) for at in range(0, len(dc.terms(i)), dc.SEGMENT)]
    frequency = Counter(t for p in parts for t in set(p.terms))
    index = dc.Index(parts, frequency, len(parts), sum(len(p.terms) for p in parts) / len(parts))
    texts = clean + leaked + half + [None, "", "the " * 900]
    got = {(row, index.items[item][0]): score for row, item, score, *_ in dc.matches(index, pa.array(texts), check=False)}
    want = brute(items, texts)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_leaks(spark, monkeypatch):
    items, clean, leaked, half = made(3)
    texts = clean + leaked + half + [None, "", " . ", "Yes.", "yes indeed it is so"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, leaked[0], None, None)] * 2, SCHEMA).repartition(4)
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(items)] + [(900, "Yes.", 5), (901, None, 5), (902, "", 5), (3, items[3], 5)], "item_id long, text string, doc_id long").repartition(2)
    want = {(len(clean) + i, i) for i in range(25)} | {(len(texts) - 2, 900)}
    for size in (dc.SHARD_BYTES, 4000):  # one index, and several
        monkeypatch.setattr(dc, "SHARD_BYTES", size)
        got = dc.leaks(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == want
        assert sum(r.doc_id is None for r in got) == 2
        kept = dc.cleaned(docs, bench)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
        assert kept.columns == docs.columns
    assert dc.leaks(docs.limit(0), bench).collect() == [] == dc.leaks(docs, bench.limit(0)).collect()
    assert dc.cleaned(docs, bench.limit(0)).count() == docs.count()


def test_documents(spark):
    docs, bench = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    flat = lambda t: " ".join(dc.terms(t))
    items = {r.item_id: flat(r.text) for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    texts = {d.doc_id: flat(d.text) for d in docs.collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {t} "} == got


@pytest.mark.parametrize("part", ["question", "answer"])
def test_one_edited_word(spark, part):
    items = {
        1: "The grey heron waits beside the frozen mill pond until the miller opens his sluice. Carp rise at dusk there.",
        2: "Copper kettles hang above every stove in the northern valley during the winter fair. They ring like bells.",
        3: "Who found it? A surveyor from the coast found the buried lighthouse stairs under nine metres of drifting sand",
    }
    docs, want = [], set()
    for k, text in items.items():
        cut = dc.question_terms(text)
        words = text.split()
        for at in range(*((0, cut) if part == "question" else (cut, len(words)))):
            want.add((len(docs), k))
            edited = " ".join([*words[:at], "zzyzx", *words[at + 1 :]])
            docs.append((len(docs), f"Words that come before it. {edited} Words that follow on it."))
    # The question with another answer, and the answer far from its question, are no leaks.
    question, answer = (" ".join(items[1].split()[s]) for s in (slice(0, 15), slice(15, 20)))
    docs += [(len(docs), f"{question} Nobody has seen them since."), (len(docs) + 1, f"{question} {'other words ' * 20} carp fell at dusk there")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()} == want
