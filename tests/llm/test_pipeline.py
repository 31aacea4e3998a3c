"""The pipeline against its stages in plain Python."""

import re
import shutil
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plazalens.llm import bpe, decontamination, secrets
from plazalens.llm.common import table
from tests.llm.test_native import base_spans
from tests.llm.test_nearcopies import brute as without_near_copies

SOURCE = "/root/testdata/sf0.001"


def cut(text, spans):
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def brute(docs, bench):
    docs = [d for d in docs if d.text and re.search(r"[^\W\d_]", d.text)]
    kept = set(without_near_copies(docs))
    docs = [d for d in docs if d.doc_id in kept]
    flat = lambda t: " " + " ".join(decontamination.terms(t)) + " "
    docs = [d for d in docs if not any(flat(b.text) in flat(d.text) for b in bench)]
    owners = {}
    value = lambda t, s: (re.match(secrets.ASSIGN, t[s[0] : s[2]])[2] if s[1] == 0 else t[s[0] : s[2]])
    for d in docs:
        for s in base_spans(d.text):
            owners.setdefault(value(d.text, s), set()).add(d.source)
    t = Tokenizer.from_file(bpe.TOKENIZER)
    out = {}
    for d in docs:
        live = [s for s in base_spans(d.text) if len(owners[value(d.text, s)]) < secrets.EXAMPLE_OWNERS]
        out[d.doc_id] = t.encode(cut(d.text, live), add_special_tokens=False).ids
    return out


def test_pipeline(spark):
    got = {r.doc_id: (r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, SOURCE).collect()}
    want = brute(table(spark, SOURCE, "documents").collect(), table(spark, SOURCE, "benchmark").collect())
    assert got == {k: (len(v), v) for k, v in want.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, tmp_path, empty):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, "plain words of a text", "en", "a", 21, "x"), (3, "plain words of a text", "en", "a", 21, "x"), (None, "words of plain text", None, None, None, None), (5, "w " * 60_000, "en", "a", 120_000, "x")]
    names = ("_fp", "_bands", "_row", "_id", "_key", "_found", "_letters", "letters", "k1", "goes", "row", "found")
    rows = [(*r, *range(len(names))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    docs = spark.createDataFrame([] if empty else rows, f"{schema}, {', '.join(f'{n} int' for n in names)}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(Path(SOURCE) / "benchmark.parquet", tmp_path / "benchmark.parquet")
    read = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, read, str(tmp_path))
        assert kept.columns == docs.columns
        assert all([r[n] for n in names] == list(range(len(names))) for r in kept.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == ([] if empty else ["3", "5", "None"])
