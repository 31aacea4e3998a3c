"""The BPE operator against the tokenizers library."""

import random
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from plazalens.llm import bpe
from plazalens.llm.common import table
from plazalens.llm.lexicon import Lexicon, build

TEXTS = [
    None,
    "",
    " ",
    "   two  spaces \n\n and\ttabs  ",
    "it's they'll I'D we've don't",
    "foo  <|endoftext|> bar<|endoftext|><|endoftext|>baz \n<|endoftext|>",
    "a b   c　d \u0085e",
    "ñandú über façade Ünïcödé 日本語 テスト 🙂🙂 12 345 ٣٤",
    "x" * 3000 + " " + "ab" * 700,
    "\x1c\x1d sep \x0b\x0c",
    " leading and trailing ",
    "snake_case CamelCase 3.14159 1e-10 !!! ... --- ###$$$",
    "é é ﻿ zero​width",
]


def want(texts):
    t = Tokenizer.from_file(bpe.TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def test_lexicon():
    rng = random.Random(5)
    words = {bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 7))): [rng.randrange(99) for _ in range(rng.randrange(1, 4))] for _ in range(800)}
    lexicon = Lexicon(build(words))
    probes = [*words, b"", b"abcdabcdabcd", *(w + b"x" for w in [*words][:50])]
    places = np.concatenate([[0], np.cumsum([len(p) for p in probes])])
    ranks = lexicon.ranks(np.frombuffer(b"".join(probes), np.uint8), places[:-1], places[1:])
    for p, r in zip(probes, ranks):
        assert (lexicon.ids[lexicon.offsets[r] : lexicon.offsets[r + 1]].tolist() if r >= 0 else None) == words.get(p)
    assert lexicon.states < len(b"".join(words)) / 2  # suffixes are shared
    assert Lexicon(build({})).ranks(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


def test_ids_and_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "again", None), (4, TEXTS[4], "x")], "doc_id long, text string, ids string").repartition(2)
    ids, _ = want(TEXTS)
    got = bpe.encode(docs)
    by = {r.doc_id: r.ids for r in got.collect()}
    assert [by[i] for i in range(len(TEXTS))] == ids
    assert got.count() == len(TEXTS) + 2
    back = {r.doc_id: r.text for r in bpe.decode(got).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]
    assert bpe.report(docs.limit(0)).collect() == []


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    source = docs.collect()
    ids, t = want([d.text for d in source])
    rows = [(d.doc_id, len(i), sha256(np.array(i, "<u4").tobytes()).hexdigest(), sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, i in zip(source, ids)]
    assert sorted(tuple(r) for r in bpe.report(docs).collect()) == sorted(rows)


@pytest.mark.parametrize("seed", range(3))
def test_merges_in_any_order(seed):
    rng = random.Random(seed)
    merges, t = bpe.merges_of(bpe.TOKENIZER), Tokenizer.from_file(bpe.TOKENIZER)
    tokens = ["".join(rng.choice("aethinorsßé") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    ids, counts = merges.tokens([x.encode() for x in tokens])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x).ids for x in tokens]
    assert merges.with_heap(("".join(tokens)).encode()).tolist() == t.encode("".join(tokens)).ids
