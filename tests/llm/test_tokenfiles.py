"""Token files against the tokenizers library and plain prefix sums."""

import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plazalens.llm import tokenfiles
from plazalens.llm.common import table


@pytest.mark.parametrize("numbers", [[], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], list(range(0, 70000, 7))])
def test_packing(numbers):
    control, data = tokenfiles.pack(np.array(numbers, np.int64))
    assert len(control) == -(-len(numbers) // 4)
    assert tokenfiles.unpack(control, data, len(numbers)).tolist() == numbers


def brute(rows):
    t = Tokenizer.from_file(tokenfiles.TOKENIZER)
    out, start = [], 0
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


TEXTS = ["The QUICK brown fox's <|endoftext|> x", None, "", " \n ", "É é ñ 日本語 12.5 foo  bar\x0bbaz\x1cqux", "word " * 40000, "a b c　d", "İstanbul ΣΑΣ ß"]


def test_files(spark):
    rows = [(7 * i % 23, t, "x") for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = [tuple(r) for r in tokenfiles.report(docs).orderBy("doc_id").collect()]
    assert got == brute(sorted((d, t) for d, t, _ in rows))
    assert tokenfiles.report(docs.limit(0)).collect() == []


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (0, "d e f"), (None, None)], "doc_id long, text string")
    got = tokenfiles.report(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 0, 1, 1]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = [tuple(r) for r in tokenfiles.report(docs).orderBy("doc_id").collect()]
    assert got == brute([(d.doc_id, d.text) for d in docs.orderBy("doc_id").collect()])


def test_words_with_signs_go_together(monkeypatch):
    """Latin words and the ASCII signs behind them reach the library many at a time, with the ids it gives them one by one."""
    letters = [chr(c) for c in range(0x41, 0x130) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA)]
    runs = [*string.punctuation, "&&&", ".###", "'\"", "<|", "|>", "]^-\\", "'''"]
    pieces = ["".join(letters), *(f"{x}a{x}" for x in letters), *(f"Straße{x}" for x in runs), *(f"don{x}" for x in runs)]
    texts = [" ".join(pieces), *pieces, "don't you's 'tis a<|endoftext|> (b) c's. l'été' é. x5%"]
    one_by_one = tokenfiles.Words._one_by_one
    alone = []
    monkeypatch.setattr(tokenfiles.Words, "_one_by_one", lambda self, p: alone.extend(p) or one_by_one(self, p))
    tokenfiles._words.cache_clear()
    ids, places = tokenfiles.encoded(pa.array(texts), tokenfiles.TOKENIZER)
    assert sorted(alone) == sorted("don't you's 'tis a<|endoftext|> (b) c's. l'été' é. x5%".split())
    t = Tokenizer.from_file(tokenfiles.TOKENIZER)
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_known_words_are_bounded(monkeypatch):
    """Words that were forgotten are encoded again, with the same ids; few long words are forgotten like many short ones."""
    monkeypatch.setattr(tokenfiles, "CACHED", 40)
    tokenfiles._words.cache_clear()
    t = Tokenizer.from_file(tokenfiles.TOKENIZER)
    for k in (0, 0, 25, 50, 0, 50):
        texts = [" ".join(f"{chr(97 + j % 26)}x{chr(97 + j // 26)}{'!' * (j % 3)}" for j in range(k, k + 30)), "zq" * (300 + k)]
        ids, places = tokenfiles.encoded(pa.array(texts), tokenfiles.TOKENIZER)
        assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
        words = tokenfiles._words(tokenfiles.TOKENIZER)
        assert len(words.known) == len(words.counts) <= 80 and len(words.ids) == words.counts.sum()
    long = [f"{'zq' * 100}{chr(97 + k)}" for k in range(6)]
    tokenfiles._words.cache_clear()
    tokenfiles.encoded(pa.array(long), tokenfiles.TOKENIZER)
    tokenfiles.encoded(pa.array(["a"]), tokenfiles.TOKENIZER)
    assert len(tokenfiles._words(tokenfiles.TOKENIZER).ids) <= 8 * 40
    tokenfiles._words.cache_clear()
