"""The filter audit against plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa

from plazalens.llm import audit
from plazalens.llm.common import buffer


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_counts(text):
    found = words(text)
    return len(found), len(set(found)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def brute(docs, labels):
    texts = {}
    for d in docs:
        if d[0] is not None:
            texts[d[1] or ""] = min(texts.get(d[1] or "", d[0]), d[0])
    rows = []
    for i, text, lang in docs:
        n, m, capitals, points, symbols = plain_counts(text or "")
        fails = {k for k, t in zip("ABCDE", (n < 100, 100 * m < 80 * n, 100 * capitals > 10 * points, symbols > 0, i is not None and i > texts[text or ""])) if t}
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [r for r in rows if r[0] == part], []
            for step, name in enumerate(order, 1):
                lost = [r for r in left if name in r[1]]
                redundant = sum(name in r[1] for r in gone)
                left, gone = [r for r in left if name not in r[1]], gone + lost
                unique = sum(r[0] == part and r[1] == {name} for r in rows)
                out[part, order, step] = [len(left), len(lost), redundant, unique, sum(r[2] for r in lost), sum(r[3] for r in lost)]
                shapley[part, name] += len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def cases():
    rng = random.Random(7)
    texts = [None, "", " \n", "word " * 150, "WORD word " * 60, "A# b", "é" * 30, "a\x1cb c\x0bd", "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y", "🙂 🙂 ñ Ñ | z"]
    texts += [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "épsilon", f"w{rng.randrange(400)}", "longerthaneight", "longerthaneighT", "$"]) for _ in range(rng.randrange(60, 260))) for _ in range(25)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(500), 120)]
    docs += [(900, "same", "en"), (900, "same", "de"), (900, "other", "en"), (None, "same", "en"), (None, None, None), (901, "same", "fr")]
    docs += [(902, "Aé" * 200_000, "en"), (903, "w " * 100_000 + "x" * 50_000, "en")]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in docs[:80]] + [(docs[0][0], 1, 0), (None, 1, 1)]
    return docs, labels


def test_audit(spark):
    docs, labels = cases()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, fails int, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(table, marks)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute(docs, labels)
    assert audit.audit(table.limit(0), marks).collect() == []
    assert {tuple(r)[-3:-1] for r in audit.audit(table, marks.limit(0)).collect()} == {(0, 0)}


def test_counts_of_texts():
    docs, _ = cases()
    rng = random.Random(1)
    texts = [d[1] or "" for d in docs] + ["".join(rng.choice("ab \n\tÉé🙂A#Z|\x1f") for _ in range(rng.randrange(200))) for _ in range(300)]
    found = audit.text_counts(*buffer(pa.array(texts)))
    assert list(zip(*[v.tolist() for v in found.values()])) == [plain_counts(t) for t in texts]


def test_words_with_one_hash_stay_different(monkeypatch):
    monkeypatch.setattr(audit, "mixed", lambda x: x * np.uint64(0))
    texts = ["a b a c", "a a", "longword1 longword2 longword1", "y" * 90 + " " + "y" * 90 + " " + "z" * 90]
    found = audit.text_counts(*buffer(pa.array(texts)))
    assert found["n_distinct"].tolist() == [3, 1, 2, 2]
