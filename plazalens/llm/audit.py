"""Filter interaction audit: what five filters remove, alone, together and in every order.

1. One pass of a byte transducer over each UTF-8 text. CLASSES gives a byte's class, STATES the state after that
   class, ACTIONS what happens when a class arrives in a state: a word begins or ends, a capital, a code point, a
   symbol. A class alone decides the next state, so a batch of texts is passed by table lookups. The spans of the words go
   into an open hash table, which compares the bytes of spans whose hashes meet, so different words stay different.
2. Copies: the smallest doc_id of every text, by a 128-bit hash, partial minima first. The answer goes back by
   doc_id, so a group of many copies is never joined or sorted by its text.
3. Documents are counted by part and set of filters that they fail: 32 cells a part hold all that any order asks.

Filters: A under LEAST_WORDS words; B different words under DISTINCT_SHARE percent; C capitals over CAPITAL_SHARE percent
of the code points; D a symbol of SYMBOLS; E the text of a smaller doc_id. Words end at 0x20 and 0x09 to 0x0D.

Defined results: null texts are empty and copies of each other; a null ``lang`` is the part ''; texts are read whole,
however long they or their words are; every row counts, repeated ones too, and rows of one doc_id are no copies of each other; a row
without doc_id is no copy and has no labels; of several labels of a doc_id, any that is 1 counts; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazalens.llm.common import IS_SPACE, buffer, mixed, slices, written

LEAST_WORDS = 100
DISTINCT_SHARE = 80
CAPITAL_SHARE = 10
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

SPACE, PLAIN, CAPITAL, SYMBOL, FOLLOWS = range(5)
CLASSES = np.full(256, PLAIN, np.uint8)
CLASSES[IS_SPACE] = SPACE
CLASSES[ord("A") : ord("Z") + 1] = CAPITAL
CLASSES[list(SYMBOLS)] = SYMBOL
CLASSES[0x80:0xC0] = FOLLOWS

#: State after a class: 0 between words, 1 inside one.
STATES = np.array([0, 1, 1, 1, 1], np.uint8)
BEGINS, ENDS, IS_CAPITAL, IS_SYMBOL, GOES_ON = 1, 2, 4, 8, 16
#: What happens when a class (column) arrives in a state (row).
ACTIONS = np.array(
    [
        [0, BEGINS, BEGINS | IS_CAPITAL, BEGINS | IS_SYMBOL, BEGINS | GOES_ON],
        [ENDS, 0, IS_CAPITAL, IS_SYMBOL, GOES_ON],
    ],
    np.uint8,
)

#: Bytes of a word that are compared eight at a time; longer words are compared whole, one by one.
LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def transduced(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The action at every byte; every text begins between words."""
    classes = CLASSES[data]
    before = np.zeros(len(data), np.uint8)
    before[1:] = STATES[classes[:-1]]
    before[places[:-1][places[:-1] < len(data)]] = 0
    return ACTIONS.reshape(-1)[before * np.uint8(5) + classes]


def counted(positions: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the rising positions lie in each text."""
    return np.diff(np.searchsorted(positions, places))


class Words:
    """Word spans of several texts, and how many different ones each text has."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, owner: np.ndarray):
        self.raw = np.concatenate([data, np.zeros(8, np.uint8)])
        #: The eight bytes from every place on.
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.raw, 0, (1,))
        self.starts, self.sizes, self.owner = starts, stops - starts, owner
        self.first = self.eight[starts] & _MASKS[np.minimum(self.sizes, 8)]
        self.hashes = mixed(self.first ^ ((owner.astype(np.uint64) << np.uint64(32)) + self.sizes.astype(np.uint64)) * _FACTOR)
        at = np.flatnonzero((self.sizes > 8) & (self.sizes <= LONG))
        for k in range(8, LONG, 8):
            at = at[self.sizes[at] > k]
            self.hashes[at] = mixed(self.hashes[at] * _FACTOR ^ self.part(at, k))
        for i in np.flatnonzero(self.sizes > LONG).tolist():
            self.hashes[i] ^= np.uint64(xxhash.xxh3_64_intdigest(self.bytes(i)))

    def bytes(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def part(self, at: np.ndarray, k: int) -> np.ndarray:
        """Up to eight bytes of each word from its k-th byte on."""
        return self.eight[self.starts[at] + k] & _MASKS[np.minimum(self.sizes[at] - k, 8)]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words are of one text and have the same bytes."""
        out = (self.hashes[a] == self.hashes[b]) & (self.owner[a] == self.owner[b]) & (self.sizes[a] == self.sizes[b]) & (self.first[a] == self.first[b])
        at = np.flatnonzero(out & (self.sizes[a] > 8))
        for i in at[self.sizes[a[at]] > LONG].tolist():
            out[i] = self.bytes(a[i]) == self.bytes(b[i])
        at = at[self.sizes[a[at]] <= LONG]
        for k in range(8, LONG, 8):
            at = at[self.sizes[a[at]] > k]
            out[at] &= self.part(a[at], k) == self.part(b[at], k)
        return out

    def different(self, texts: int) -> np.ndarray:
        """Insert all words into an open table; those that find no equal word are new."""
        n = len(self.starts)
        width = max(4, (2 * n).bit_length())
        table = np.full(1 << width, -1, np.int64)
        slots = (self.hashes >> np.uint64(64 - width)).astype(np.int64)
        new = np.zeros(n, bool)
        open_ = np.arange(n)
        while len(open_):
            at = slots[open_]
            free = table[at] < 0
            table[at[free]] = open_[free]
            held = table[at]
            own = held == open_
            new[open_[own]] = True
            rest = np.flatnonzero(~own)
            rest = rest[~self.equal(held[rest], open_[rest])]
            open_ = open_[rest]
            slots[open_] = (slots[open_] + 1) & ((1 << width) - 1)
        return np.bincount(self.owner[new], minlength=texts)


def text_counts(data: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """Words, different words, capitals, code points and symbols of each text."""
    acts = transduced(data, places)
    starts = np.flatnonzero(acts & BEGINS)
    open_end = places[1:][(places[1:] > places[:-1])]
    open_end = open_end[STATES[CLASSES[data[open_end - 1]]] == 1]
    stops = np.sort(np.concatenate([np.flatnonzero(acts & ENDS), open_end]), kind="stable")
    n_words = counted(starts, places)
    texts = len(places) - 1
    return {
        "n_words": n_words,
        "n_distinct": Words(data, starts, stops, np.repeat(np.arange(texts), n_words)).different(texts),
        "n_capitals": counted(np.flatnonzero(acts & IS_CAPITAL), places),
        "n_points": np.diff(places) - counted(np.flatnonzero(acts & GOES_ON), places),
        "n_symbols": counted(np.flatnonzero(acts & IS_SYMBOL), places),
    }


COUNTS = "doc_id bigint, part string, n_words bigint, n_distinct bigint, n_capitals bigint, n_points bigint, n_symbols bigint, hi bigint, lo bigint"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 19):
        data, places = buffer(batch.column("text"))
        found = text_counts(data, places)
        view = memoryview(np.ascontiguousarray(data))
        keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]), "<i8").reshape(-1, 2)
        columns = [batch.column("doc_id"), batch.column("part"), *[pa.array(v.astype(np.int64)) for v in found.values()]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], ["doc_id", "part", *found, "hi", "lo"])


def counts(docs: DataFrame) -> DataFrame:
    """The counts of every document's text, its part and the hash of its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(_counts, COUNTS)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails): bit k of ``fails`` is set where filter k of FILTERS fails."""
    rows = written(counts(docs), "counts")
    first = rows.where("doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(written(first, "first"), ["doc_id", "hi", "lo"], "left")
    tests = [
        F.col("n_words") < LEAST_WORDS,
        F.col("n_distinct") * 100 < F.col("n_words") * DISTINCT_SHARE,
        F.col("n_capitals") * 100 > F.col("n_points") * CAPITAL_SHARE,
        F.col("n_symbols") > 0,
        F.col("first").isNull() & F.col("doc_id").isNotNull(),
    ]
    bits = [F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)]
    return rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("fails"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones by part and set of failing filters."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    rows = failures(docs).join(known, "doc_id", "left")
    return rows.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step. Every cell tells its share of each of them."""
    names = F.array(*[F.lit(o) for o in ORDERS])
    steps = cells(docs, labels).withColumn("order", F.explode(names)).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))])))
    bit = [F.expr(f"shiftleft(1, instr('{FILTERS}', substring(order, {k + 1}, 1)) - 1)") for k in range(len(FILTERS))]
    earlier = sum([F.when(F.col("step") > k + 1, bit[k]).otherwise(F.lit(0)) for k in range(1, len(FILTERS))], F.when(F.col("step") > 1, bit[0]).otherwise(F.lit(0)))
    own = F.coalesce(*[F.when(F.col("step") == k + 1, bit[k]) for k in range(len(FILTERS))])
    steps = steps.withColumn("own", own).withColumn("earlier", earlier)
    fails = F.col("fails").bitwiseAND(F.col("own")) != 0
    out = F.col("fails").bitwiseAND(F.col("earlier")) != 0
    # A cell's documents go at the first of its failing filters: each is first in as many orders.
    share = F.expr(f"{len(ORDERS)} div bit_count(fails)")

    def total(condition, value):
        return F.sum(F.when(condition, value).otherwise(F.lit(0)))

    return steps.groupBy("part", F.col("order").alias("filter_order"), "step").agg(
        total(~fails & ~out, F.col("n")).alias("kept"),
        total(fails & ~out, F.col("n")).alias("removed"),
        total(fails & out, F.col("n")).alias("redundant"),
        total(F.col("fails") == F.col("own"), F.col("n")).alias("unique_fails"),
        total(fails & ~out, F.col("good")).alias("good_lost"),
        total(fails & ~out, F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * share).alias("shapley"),
    )
