"""Near copies against brute-force Jaccard over all pairs."""

import random

import numpy as np

import corpus_pipeline
from plazalens.llm import nearcopies
from plazalens.llm.common import table


def brute(docs):
    """doc_ids that stay: the smallest of every component of 5-word Jaccard 0.8 or more."""
    sets = []
    for d in docs:
        words = (d.text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            low, high = sorted((len(x), len(sets[j])))
            if low >= 0.8 * high and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    low = {}
    for i, d in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d.doc_id), d.doc_id)
    return sorted(low.values())


def test_stage_keeps_no_near_copy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    assert kept == brute(docs.collect())


def test_chains_and_edges(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(12):  # chains of edits, whose ends are far apart, and copies of one base
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 90, 400]))]
        for kind in range(14):
            edited = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 40)):
                edited[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(edited))
            words = edited if kind < 7 else words
    rows += ["", None, " \n", "One two", "one TWO ", "one two three", rows[0], rows[0]]
    ids = rng.sample(range(10_000), len(rows))
    docs = spark.createDataFrame(list(zip(ids, rows)), "doc_id long, text string").repartition(5)
    got = nearcopies.one_of_each(docs)
    assert sorted(r.doc_id for r in got.collect()) == brute(docs.collect()) and got.columns == docs.columns
    clash = docs.selectExpr("*", "doc_id as k1", "1 as _k1", "text as goes", "2 as fp", "3 as _row")
    kept = nearcopies.one_of_each(clash)
    assert sorted(r.doc_id for r in kept.where("k1 = doc_id and _k1 = 1 and fp = 2 and _row = 3").collect()) == brute(docs.collect()) and kept.columns == clash.columns
    twice = docs.union(docs).union(docs.selectExpr("cast(null as long)", "text"))
    assert sorted(r.doc_id for r in nearcopies.one_of_each(twice).collect()) == brute(docs.collect())
    assert nearcopies.one_of_each(docs.limit(0)).collect() == []


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BUCKET", 6)
    monkeypatch.setattr(nearcopies, "PACK", 400)
    rng = random.Random(8)
    rows, base = [], [f"w{rng.randrange(3000)}" for _ in range(60)]
    for k in range(60):
        edited = list(base)
        for _ in range(rng.randrange(0, 4)):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect()) == brute(docs.collect())


def test_sketches_are_majorities_of_distinct_shingles():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (0, 1, 4, 700, 0, 256)]
    texts[3] = np.concatenate([texts[3], np.repeat(texts[3][:2], 900)])  # repeats have no more votes
    heads = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sizes, marks = nearcopies.sketches(np.concatenate(texts), heads)
    for text, size, mark in zip(texts, sizes, marks):
        own = np.unique(text)
        words = np.stack([nearcopies.mixed(own + nearcopies._STEP * np.uint64(i)) for i in range(1, 5)], axis=1)
        votes = np.unpackbits(words.view(np.uint8), axis=1).sum(0, dtype=int)
        assert size == len(own) and (mark == np.packbits(2 * votes > len(own))).all()


def test_links_hold_all_fingerprints_within_reach(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SHARD", 8)  # deep trees in every ring
    rng = np.random.default_rng(11)
    marks, size = [], []
    for _ in range(25):
        base = rng.integers(0, 256, 32).astype(np.uint8)
        for _ in range(9):  # chains of edits, near and at the edge of REACH
            flip = np.zeros(nearcopies.BITS, np.uint8)
            flip[rng.choice(nearcopies.BITS, rng.choice([0, 20, 60, 79, 80, 81, 95]), replace=False)] = 1
            base = base ^ np.packbits(flip)
            marks.append(base)
            size.append(int(rng.integers(60, 130)))
    rows = [(i * 7 - 50, s, m.tobytes()) for i, (s, m) in enumerate(zip(size, marks))]
    nodes = spark.createDataFrame(rows, "fp long, size long, sketch binary").repartition(3)
    got = {(r.a, r.b) for r in nearcopies.candidates(nodes).collect()}
    bits = np.unpackbits(np.array(marks), axis=1)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def joined(pairs):
        parent[:] = range(len(rows))
        for i, j in pairs:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
        return [root(i) for i in range(len(rows))]

    near = set()
    for i in range(len(rows)):
        away = bits[:i] != bits[i]
        for j in np.flatnonzero((away.sum(1) <= nearcopies.REACH) & (away[:, : nearcopies.FIRST].sum(1) <= nearcopies.FIRST_REACH)):
            if min(size[i], size[j]) >= 0.8 * max(size[i], size[j]):
                near.add((i, int(j)))
    links = {((a + 50) // 7, (b + 50) // 7) for a, b in got}
    assert len(near) > 100 and {(max(p), min(p)) for p in links} <= near
    assert joined(links) == joined(near)


def test_deep_trees_keep_no_near_copy(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SHARD", 4)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).select("doc_id").collect()) == brute(docs.collect())
