"""Line dedup against plain Python."""

import hashlib
import random

import numpy as np

from plazalens.llm import linededup

BLANK = " \t\n\v\f\r"
LONG = "this is a line that many documents of the table hold again"


def fold(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    """(doc_id, lines, dropped, kept text) of every row; a missing doc_id is the smallest."""
    holders, last = {}, {}
    place = lambda i: -(1 << 63) if i is None else i
    for i, text in rows:
        for key in {fold(x) for x in (text or "").split("\n")}:
            if len(key) >= 40:
                holders[key] = holders.get(key, 0) + 1
                last[key] = max(last.get(key, place(i)), place(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if holders.get(fold(x), 0) < 5 or last[fold(x)] == place(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cases():
    rng = random.Random(3)
    lines = [LONG, LONG.upper() + "  ", "\t" + LONG + "\r", "é" * 40, "é" * 39, " " * 60, "", "x" * 39, "y" * 40 + "\v", "short", "Ä" + "z" * 45, "ä" + "z" * 45]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for k in rng.sample(range(1000), 60)]
    rows += [(2000, None), (2001, ""), (2002, "\n"), (2003, LONG), (2003, LONG), (None, LONG + "\nfree"), (None, None), (2004, "\n\n" + LONG + "\n")]
    rows += [(1500, (LONG + "\n") * 30_000), (1501, "w" * 300_000 + "\n" + LONG)]
    return rows


def shown(rows):
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in rows)


def test_report(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, keys string, hi int").repartition(5)
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
    assert shown(map(tuple, linededup.report(docs).collect())) == shown(want)
    kept = linededup.deduped(docs)
    assert kept.columns == docs.columns
    assert shown((r.doc_id, r.text or "", r.keys, r.hi) for r in kept.collect()) == shown((i, t, "x", 1) for i, _, _, t in brute(rows))
    assert linededup.report(docs.limit(0)).collect() == []


def test_a_common_line_is_probed_in_copies(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_PROBES", 7)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
    assert shown(map(tuple, linededup.report(docs).collect())) == shown(want)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(1 << 63), 1 << 63, (2, 20_000))
    lo[:50], hi[50:100] = 7, 9  # halves may repeat, pairs do not
    hashes = linededup.PerfectHash.over(hi, lo)
    assert sorted(hashes.numbers(hi, lo).tolist()) == list(range(20_000))
    assert len(hashes.bits) < 5 * 20_000
    assert linededup.PerfectHash.over(hi[:0], lo[:0]).numbers(hi[:5], lo[:5]).tolist() == [-1] * 5
