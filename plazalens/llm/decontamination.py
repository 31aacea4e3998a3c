"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

1. Index. Test items are cut into segments of at most SEGMENT terms. Document frequencies, the
   number of segments and their mean length are counted over the whole benchmark. A segment's weight
   for a term is its BM25 weight divided by the segment's score against itself, so a score is the
   share of a segment that a passage explains.
2. Query. Every text is cut into passages of PASSAGE terms, one beginning every SEGMENT terms, so
   a copied segment lies whole in one of them. All segments with a score of THRESHOLD or more are
   retrieved: block maxima of all passages rule out blocks of segments at once, and block-max WAND with
   a fixed threshold walks the postings of the blocks that are left.
3. Check. A retrieved item leaks if the document holds at least OVERLAP of the word n-grams of its
   question and of its answer (the last sentence; the second half of a single one). In a part of fewer
   than EDITABLE terms one edited word can take more n-grams than that; such a part also counts by its
   terms in order, at the place where the n-grams of the other part put it. Items of fewer than SHORT
   terms leak only where they are the whole document.

The index is broadcast. Its size is bounded: a benchmark of more than SHARD_BYTES of text is indexed
in shards of about that size, each with its own pass over the documents.

Defined results: null and empty texts or items match nothing; a null item_id or doc_id is carried
along; repeated documents give repeated pairs, repeated items count once; an empty benchmark or table gives no rows; other
columns are left aside.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazalens.llm.common import slices

SEGMENT, PASSAGE = 64, 128
THRESHOLD = 0.5
GRAM = 3
OVERLAP = 0.6
SHORT = 5
#: In so many terms, one replaced term leaves OVERLAP of the n-grams whole.
EDITABLE = 10
SHARD_BYTES = 4 << 20
K1, B = 1.2, 0.75
BLOCKS = 64
CELLS = 4 << 20

SIGNS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—¿¡"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def term(word: str) -> str:
    return word.lower().strip(SIGNS)


def terms(text: str | None) -> list[str]:
    """Words at ASCII white space, in lower case, without signs at their ends."""
    return [t for t in map(term, re.split(r"[\x20\x09-\x0D]+", text or "")) if t]


def question_terms(text: str | None) -> int:
    """How many terms of an item belong to its question; the others are its answer."""
    parts = [terms(s) for s in _SENTENCE.split(text or "")]
    sizes = [len(p) for p in parts if p]
    total = sum(sizes)
    if len(sizes) < 2 or sizes[-1] < GRAM:
        return total // 2
    return total - sizes[-1]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words = terms(text)
            for at in range(0, len(words), SEGMENT):
                rows.append({"item_id": item, "at": at, "question": question_terms(text), "terms": words[at : at + SEGMENT]})
        fields = [batch.schema.field("item_id"), ("at", pa.int32()), ("question", pa.int32()), ("terms", pa.list_(pa.string()))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))


class Index:
    """Inverted index of one shard of the benchmark."""

    def __init__(self, rows: list, frequency: dict[str, int], segments: int, mean: float):
        rows = sorted(rows, key=lambda r: (r.key, r.at))
        self.items: list = []  # (item_id, question terms, term numbers) of every item
        self.numbers: dict[str, int] = {}
        self.item_of: list[int] = []
        postings: list[tuple[int, int, float]] = []
        for s, r in enumerate(rows):
            if r.at == 0:
                self.items.append((r.item_id, r.question, []))
            self.item_of.append(len(self.items) - 1)
            ids = [self.numbers.setdefault(t, len(self.numbers)) for t in r.terms]
            self.items[-1][2].extend(ids)
            weights = {}
            for t, n in Counter(r.terms).items():
                idf = math.log(1 + (segments - frequency[t] + 0.5) / (frequency[t] + 0.5))
                weights[self.numbers[t]] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ids) / mean))
            whole = sum(weights.values())
            postings += [(t, s, w / whole) for t, w in weights.items()]
        postings.sort()
        n = len(self.numbers)
        self.segments = np.array([p[1] for p in postings], np.int32)
        self.weights = np.array([p[2] for p in postings], np.float32)
        numbers = np.array([p[0] for p in postings], np.int64)
        self.places = np.searchsorted(numbers, np.arange(n + 1))
        self.highest = np.zeros(n, np.float32)
        np.maximum.at(self.highest, numbers, self.weights)
        blocks = max(1, min(BLOCKS, len(rows), CELLS // max(1, n)))
        self.block_size = -(-len(rows) // blocks) if rows else 1
        self.maxima = np.zeros((n, blocks), np.float32)
        np.maximum.at(self.maxima, (numbers, self.segments // self.block_size), self.weights)

    def wand(self, passage: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """Segments of a block that score ``least`` or more against the terms of a passage."""
        low, high = block * self.block_size, (block + 1) * self.block_size
        lists = []  # [current segment, bound, segments, weights, position]
        for t in passage:
            bound = float(self.maxima[t, block])
            if bound:
                a, b = self.places[t], self.places[t + 1]
                a, b = a + np.searchsorted(self.segments[a:b], (low, high))
                found = self.segments[a:b].tolist()
                lists.append([found[0], bound, found, self.weights[a:b].tolist(), 0])
        out = []

        def move(entry, to):
            entry[4] = bisect_left(entry[2], to, entry[4])
            entry[0] = entry[2][entry[4]] if entry[4] < len(entry[2]) else high

        while True:
            lists = sorted((e for e in lists if e[0] < high), key=lambda e: e[0])
            bound, pivot = 0.0, None
            for e in lists:
                bound += e[1]
                if bound >= least - 1e-6:
                    pivot = e[0]
                    break
            if pivot is None:
                return out
            if lists[0][0] == pivot:
                score = 0.0
                for e in lists:
                    if e[0] != pivot:
                        break
                    score += e[3][e[4]]
                    move(e, pivot + 1)
                if score >= least - 1e-6:
                    out.append((pivot, score))
            else:
                for e in lists:
                    if e[0] >= pivot:
                        break
                    move(e, pivot)

    def leaks(self, item: int, document: list[int], grams: set[tuple[int, ...]]) -> tuple[float, float] | None:
        """Overlap of question and answer with a document, if the item leaks into it."""
        _, cut, ids = self.items[item]
        if len(ids) < SHORT:
            return (1.0, 1.0) if ids == document else None
        shares = []
        for part in (ids[:cut], ids[cut:]):
            n = min(GRAM, len(part))
            wanted = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
            here = grams if n == GRAM else {g[i : i + n] for g in grams for i in range(GRAM - n + 1)}
            shares.append(sum(g in here for g in wanted) / len(wanted) if n else 1.0)
        for short, (a, b), (c, d) in ((0, (0, cut), (cut, len(ids))), (1, (cut, len(ids)), (0, cut))):
            if b - a < EDITABLE and shares[short] < OVERLAP <= shares[1 - short]:
                shares[short] = max(shares[short], beside(document, ids, a, b, c, d))
        return tuple(shares) if min(shares) >= OVERLAP else None


def beside(document: list[int], ids: list[int], a: int, b: int, c: int, d: int) -> float:
    """The largest share of the terms ``a`` to ``b`` of an item that a document holds in order, where
    an n-gram of the terms ``c`` to ``d`` puts them, give or take one term."""
    places: dict[tuple[int, ...], list[int]] = {}
    for i in range(c, d - GRAM + 1):
        places.setdefault(tuple(ids[i : i + GRAM]), []).append(i)
    shifts = {p - i for p, g in enumerate(zip(*(document[i:] for i in range(GRAM)))) for i in places.get(g, ())}
    found = 0
    for shift in shifts:
        best = [0] * (b - a + 1)
        for t in document[max(0, shift + a - 1) : max(0, shift + b + 1)]:
            best = [0, *accumulate((max(best[k + 1], best[k] + (t == ids[a + k])) for k in range(b - a)), max)]
        found = max(found, best[-1])
    return found / (b - a)


def matches(index: Index, column: pa.Array, threshold: float = THRESHOLD, check: bool = True) -> list[tuple]:
    """(row, item, score, question overlap, answer overlap) of the items that leak into each text;
    without ``check`` every retrieved item."""
    split = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    words = split.flatten().dictionary_encode()
    numbers, vocabulary = index.numbers, words.dictionary.to_pylist()
    known = np.fromiter((numbers.get(t, -1) if t else -2 for t in map(term, vocabulary)), np.int64, len(vocabulary))
    ids = known[words.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(column)), split.value_lengths().to_numpy(zero_copy_only=False))
    text, ids = text[ids > -2], ids[ids > -2]
    places = np.searchsorted(text, np.arange(len(column) + 1))
    sizes = np.diff(places)
    windows = np.maximum(1, -(-(sizes - (PASSAGE - SEGMENT)) // SEGMENT))
    first = np.concatenate([[0], np.cumsum(windows)])
    # Every known term belongs to the window that begins in its stretch and to the one before.
    at = np.flatnonzero(ids >= 0)
    stretch = (at - places[text[at]]) // SEGMENT
    keys = []
    for back in (0, 1):
        good = (stretch >= back) & (stretch - back < windows[text[at]])
        keys.append((first[text[at[good]]] + stretch[good] - back) * max(1, len(numbers)) + ids[at[good]])
    window, number = np.divmod(np.unique(np.concatenate(keys)), max(1, len(numbers)))
    bound = np.bincount(window, index.highest[number], minlength=first[-1])
    some = bound[window] >= threshold - 1e-6
    window, number = window[some], number[some]
    heads = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
    edges = np.concatenate([heads, [len(window)]])
    best: dict[tuple[int, int], float] = {}
    step = 1024
    for k in range(0, len(heads), step):
        a, b = edges[k], edges[min(k + step, len(heads))]
        sums = np.add.reduceat(index.maxima[number[a:b]], heads[k : k + step] - a, axis=0)
        for w, block in zip(*np.nonzero(sums >= threshold - 1e-4)):
            span = slice(edges[k + w], edges[k + w + 1])
            row = int(np.searchsorted(first, window[span.start], "right")) - 1
            for segment, score in index.wand(number[span].tolist(), int(block), threshold):
                key = (row, index.item_of[segment])
                best[key] = max(best.get(key, 0.0), score)
    out, seen = [], (-1, [], set())
    for (row, item), score in sorted(best.items()):
        if seen[0] != row:
            document = ids[places[row] : places[row + 1]].tolist()
            seen = (row, document, set(zip(*(document[i:] for i in range(GRAM)))))
        shares = index.leaks(item, seen[1], seen[2]) if check else (0.0, 0.0)
        if shares:
            out.append((row, item, score, *shares))
    return out


def indexes(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes, one after another, that cover the whole benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text")
    kind = items.schema["item_id"].dataType.simpleString()
    cut = items.mapInArrow(_segments, f"item_id {kind}, at int, question int, terms array<string>")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES)
    if not shards:
        return
    total, mean = cut.agg(F.count("*"), F.avg(F.size("terms"))).first()
    if not total:
        return
    frequency = cut.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # ``key`` tells items apart that share an id.
    keyed = items.withColumn("key", F.concat_ws(":", F.col("item_id").cast("string"), F.hex(F.xxhash64("text"))))
    for shard in range(shards):
        some = keyed.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard).dropDuplicates(["key"])
        rows = some.select("item_id", "text", "key")
        collected = rows.collect()  # about SHARD_BYTES
        if not collected:
            continue
        parts = []
        for r in collected:
            words, question = terms(r.text), question_terms(r.text)
            parts += [_Segment(r.item_id, r.key, at, question, words[at : at + SEGMENT]) for at in range(0, len(words), SEGMENT)]
        wanted = rows.select("item_id", "text").mapInArrow(_segments, cut.schema).select(F.explode("terms").alias("term")).distinct()
        counts = {r.term: r.n for r in wanted.join(frequency, "term").collect()}
        yield spark.sparkContext.broadcast(Index(parts, counts, total, mean))


class _Segment:
    def __init__(self, item_id, key: str, at: int, question: int, words: list[str]):
        self.item_id, self.key, self.at, self.question, self.terms = item_id, key, at, question, words


def _pairs(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = matches(index.value, batch.column("text"))
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    pa.array([index.value.items[f[1]][0] for f in found], pa.int64()),
                    *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)),
                ],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for every document and item that leaks into it; clean documents have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    kinds = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], kinds)
    for index in indexes(items):
        out = out.unionByName(rows.mapInArrow(_pairs(index), kinds))
    return out


def _without(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[np.array([f[0] for f in matches(index.value, batch.column("text"))], np.int64)] = False
            yield batch.filter(pa.array(keep))

    return run


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows into which an item leaks; no row is shuffled."""
    for index in indexes(benchmark):
        docs = docs.mapInArrow(_without(index), docs.schema)
    return docs
