"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Texts are cut in front of single spaces between words, where the tokenizer's own pattern always has
a border, so equal pieces have equal ids anywhere. All pieces are counted over all texts; the
most frequent, at most LEXICON_WORDS, are compiled with their ids into a shared-suffix automaton, which
executors memory-map. Other pieces go through the pattern and the merges, exactly: the pair of
lowest rank, leftmost first, until none is left. The lexicon only saves work, so its size never
changes a result.

Defined results: a null text is empty and has no ids; the special token's string is one id, as the
tokenizers library has it by default; texts of any length are encoded whole; repeated rows are encoded like any
other; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plazalens.llm.common import buffer, slices, spans, written
from plazalens.llm.lexicon import Lexicon, build

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LEXICON_WORDS = 32_768
#: A piece of the lexicon occurs so often at least.
LEAST = 8
SLICE = 4 << 20
#: Longer tokens of the pattern are merged with a heap, shorter ones side by side in arrays.
LONG = 256
NONE = np.int32(2**31 - 1)

#: Unicode white space and the tokenizer's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for
    themselves, the others for 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Merges:
    """Vocabulary and merges of a byte-level BPE file, with exact encoding of single tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocabulary = _byte_letters(), file["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for text, i in vocabulary.items():
            strings[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            strings[i] = text
        self.places = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocabulary[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self._hash(keys, np.array([vocabulary[a + b] for a, b in pairs], np.int32))
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile(b"(" + b"|".join(map(regex.escape, self.special)) + b")") if self.special else None

    def _hash(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing: slots of keys, ranks and merged ids."""
        self.bits = 18
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        rest, self.probes = np.arange(len(keys)), 0
        while len(rest):
            slot = (self._slot(keys[rest]) + self.probes) & (1 << self.bits) - 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            take = first[free[first]]
            self.keys[slot[take]], self.rank[slot[take]], self.merged[slot[take]] = keys[rest[take]], rest[take], merged[rest[take]]
            rest = np.delete(rest, take)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of every pair, or -1 if it has no merge."""
        key = left.astype(np.int64) << 32 | right
        slot, out = self._slot(key), np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for probe in range(self.probes):
            here = (slot[todo] + probe) & (1 << self.bits) - 1
            there = self.keys[here]
            hit = there == key[todo]
            out[todo[hit]] = here[hit]
            todo = todo[~hit & (there != -1)]
            if not len(todo):
                break
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.pair(left, right)
        return np.where(slot >= 0, self.rank[slot], NONE)

    def side_by_side(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many tokens, one after another, and how many each has. Lanes are rows of a
        matrix; ``ahead`` and ``back`` link what is left of each."""
        n, wide = len(start), int(length.max())
        column = np.arange(wide)
        inside = column < length[:, None]
        ids = np.where(inside, self.of_byte[data[np.minimum(start[:, None] + column, len(data) - 1)]], 0).astype(np.int32)
        rank = np.full((n, wide), NONE, np.int32)
        paired = inside[:, 1:]
        rank[:, :-1][paired] = self._ranks(ids[:, :-1][paired], ids[:, 1:][paired])
        ahead = np.tile(np.arange(1, wide + 1, dtype=np.int32), (n, 1))
        back = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (n, 1))
        alive = inside.copy()
        lanes = np.arange(n)
        while len(lanes):
            at = rank[lanes].argmin(1)  # the first of the smallest
            some = rank[lanes, at] != NONE
            lanes, at = lanes[some], at[some]
            if not len(lanes):
                break
            gone = ahead[lanes, at]
            ids[lanes, at] = self.merged[self.pair(ids[lanes, at], ids[lanes, gone])]
            alive[lanes, gone] = False
            rank[lanes, gone] = NONE
            after = ahead[lanes, gone]
            ahead[lanes, at] = after
            more = after < length[lanes]
            back[lanes[more], after[more]] = at[more]
            rank[lanes, at] = NONE
            rank[lanes[more], at[more]] = self._ranks(ids[lanes[more], at[more]], ids[lanes[more], after[more]])
            before = back[lanes, at]
            less = before >= 0
            rank[lanes[less], before[less]] = self._ranks(ids[lanes[less], before[less]], ids[lanes[less], at[less]])
        return ids[alive], alive.sum(1)

    def with_heap(self, token: bytes) -> np.ndarray:
        """Ids of one long token."""
        ids = self.of_byte[np.frombuffer(token, np.uint8)].tolist()
        n = len(ids)
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        slots = self.pair(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(self.rank[s]), i, ids[i], ids[i + 1], int(self.merged[s])) for i, s in enumerate(slots) if s >= 0]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def offer(i: int, j: int) -> None:
            two = (ids[i], ids[j])
            if two not in known:
                s = int(self.pair(np.array([two[0]]), np.array([two[1]]))[0])
                known[two] = None if s < 0 else (int(self.rank[s]), int(self.merged[s]))
            if known[two]:
                heapq.heappush(heap, (known[two][0], i, *two, known[two][1]))

        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], ahead[i] = merged, -1, ahead[j]
            if ahead[i] < n:
                back[ahead[i]] = i
                offer(i, ahead[i])
            if back[i] >= 0:
                offer(back[i], i)
        return np.array([i for i in ids if i >= 0], np.int32)

    def tokens(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of tokens of the pattern, one after another, and how many each has."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(tokens), np.uint8)
        counts, parts, rows = np.zeros(len(tokens), np.int64), [], []
        low = 0
        for high in (6, 10, 16, 40, LONG):
            group = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(group), 1 << 15):
                some = group[k : k + (1 << 15)]
                ids, n = self.side_by_side(data, starts[some], lengths[some])
                counts[some] = n
                parts.append(ids)
                rows.append(np.repeat(some, n))
            low = high
        for i in np.flatnonzero(lengths > LONG):
            parts.append(self.with_heap(tokens[i]))
            counts[i] = len(parts[-1])
            rows.append(np.full(counts[i], i))
        if not parts:
            return np.zeros(0, np.int32), counts
        return np.concatenate(parts)[np.argsort(np.concatenate(rows), kind="stable")], counts

    def pieces(self, pieces: list[bytes], lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of text, one after another, and how many each has."""
        numbers: dict[bytes, int] = {}
        order, per_piece = [], []
        for piece in pieces:
            n = len(order)
            for part in self.cut.split(piece) if self.cut else [piece]:
                if part in self.special:
                    order.append(-1 - self.special[part])
                elif part:
                    for token in self.pattern.findall(part.decode()):
                        order.append(numbers.setdefault(token.encode(), len(numbers)))
            per_piece.append(len(order) - n)
        ids, counts = _looked_up(list(numbers), lexicon, self.tokens)
        order = np.array(order, np.int64)
        special = np.unique(-1 - order[order < 0])  # appended as entries of one id
        entry = np.where(order < 0, len(numbers) + np.searchsorted(special, -1 - order), order)
        places = np.concatenate([[0], np.cumsum(np.concatenate([counts, np.ones(len(special), np.int64)]))])
        flat, heads = spans(places, entry)
        edges = np.concatenate([[0], np.cumsum(per_piece)]).astype(np.int64)
        return np.concatenate([ids, special.astype(np.int32)])[flat], np.diff(heads[edges])

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each id begin."""
        flat, heads = spans(self.places, ids)
        return self.bytes[flat], heads


def _looked_up(strings: list[bytes], lexicon: Lexicon | None, other) -> tuple[np.ndarray, np.ndarray]:
    """Ids of strings, one after another, and how many each has: from the lexicon if it has
    them, else from ``other``."""
    if lexicon is None or not strings:
        return other(strings)
    places = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    rank = lexicon.ranks(np.frombuffer(b"".join(strings), np.uint8), places[:-1], places[1:])
    unseen = np.flatnonzero(rank < 0)
    ids, counts = other([strings[i] for i in unseen])
    # Entries of the lexicon first, then the unseen strings in order.
    entry = rank.copy()
    entry[unseen] = len(lexicon.offsets) - 1 + np.arange(len(unseen))
    table = np.concatenate([lexicon.offsets.astype(np.int64), len(lexicon.ids) + np.cumsum(counts)])
    flat, heads = spans(table, entry)
    return np.concatenate([lexicon.ids, ids])[flat], np.diff(heads)


def pieces_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut into pieces, and for each text the number of pieces before it.

    A cut stands before a space between two characters that are surely not white space (ASCII, or
    led by a byte that leads none); elsewhere the text stays in one piece.
    """
    data, places = buffer(column)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(places), np.int64)
    ascii_word = (data < 0x80) & ~((data >= 9) & (data <= 13)) & (data != 0x20)
    two_byte = (data >= 0xC3) & (data <= 0xDF)
    before = ascii_word.copy()
    before[1:] |= two_byte[:-1] & (data[1:] >= 0x80)
    after = ascii_word | two_byte | ((data >= 0xE4) & (data <= 0xF4))
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    filled = places[:-1][places[:-1] < places[1:]]
    cut[filled] = True
    begins = np.flatnonzero(cut)
    offsets = pa.py_buffer(np.concatenate([begins, [len(data)]]).astype(np.int64))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(begins, places)


def encoded(column: pa.Array, merges: Merges, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where those of each text begin."""
    pieces, first = pieces_of(column)
    coded = pieces.dictionary_encode()
    ids, counts = _looked_up(coded.dictionary.to_pylist(), lexicon, lambda p: merges.pieces(p, lexicon))
    places = np.concatenate([[0], np.cumsum(counts)])
    flat, heads = spans(places, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return ids[flat], heads[first]


@functools.lru_cache(2)
def merges_of(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(2)
def _mapped(name: str) -> Lexicon:
    return Lexicon.mapped(SparkFiles.get(name))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        coded = pieces_of(batch.column("text"))[0].dictionary_encode()
        counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(counts.astype(np.int64))], ["piece", "n"])


def frequent(docs: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent pieces of all texts, at most ``most``, which come to the driver.

    A histogram of the counts gives the count from which on that many pieces remain, so no task
    sends candidates that the result does not hold. Pieces of equal count are in or out together.
    """
    pieces = docs.select("text").mapInArrow(_counted, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = written(pieces.where((F.col("n") >= LEAST) & (F.octet_length("piece") <= 64)), "pieces")
    histogram = pieces.groupBy("n").agg(F.count("*").alias("m"))
    above = F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n")))
    least = histogram.withColumn("above", above).where(F.col("above") <= most).agg(F.min("n")).first()[0]
    return [] if least is None else [bytes(r.piece) for r in pieces.where(F.col("n") >= least).select("piece").collect()]


def compiled(docs: DataFrame, path: str = TOKENIZER, most: int = LEXICON_WORDS) -> str:
    """Build the lexicon for ``docs`` and hand its file to the executors; its name."""
    words, merges = frequent(docs, most), merges_of(path)
    ids, counts = merges.pieces(words)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    whole = build({w: ids[a:b].tolist() for w, a, b in zip(words, bounds, bounds[1:])})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    whole.tofile(file)
    docs.sparkSession.sparkContext.addFile(file)
    return name


def _encode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, lexicon = merges_of(path), _mapped(name)
        for batch in slices(batches, most=SLICE):
            ids, places = encoded(batch.column("text"), merges, lexicon)
            lists = pa.LargeListArray.from_arrays(pa.array(places), pa.array(ids)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id and ``ids`` of every row of ``docs``."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(path, compiled(docs, path)), f"doc_id {kind}, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        for batch in batches:
            lists = batch.column("ids")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            data, heads = merges.decoded(lists.flatten().to_numpy(zero_copy_only=False))
            places = heads[np.concatenate([[0], np.cumsum(lengths)])]
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(places, places[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id and ``text`` of rows with ``ids``."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {kind}, text string")


def _digests(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, lexicon = merges_of(path), _mapped(name)
        for batch in slices(batches, most=SLICE):
            ids, places = encoded(batch.column("text"), merges, lexicon)
            data, heads = merges.decoded(ids)
            plain, text = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
            borders = heads[places]
            sha = [
                [hashlib.sha256(plain[4 * a : 4 * b]).hexdigest() for a, b in zip(places, places[1:])],
                [hashlib.sha256(bytes(text[a:b]).decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(borders, borders[1:])],
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(places)), *(pa.array(s, pa.string()) for s in sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def report(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them, in one pass."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digests(path, compiled(docs, path)), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
