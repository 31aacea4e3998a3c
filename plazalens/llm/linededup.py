"""Line dedup: documents probe sharded minimal perfect hashes instead of joining lines.

1. Every document gives one 128-bit hash for each different key of its lines that is long enough.
2. Equal hashes are counted (partial counts first): in how many documents, and the largest doc_id.
3. The distinct hashes are dealt into shards of about SHARD_KEYS. A shard becomes one row: the level bitmaps of
   a minimal perfect hash, and three arrays in its order: fingerprint, count and last holder.
4. Documents probe the arrays of the shards of their hashes. A shard that more than SHARD_PROBES documents ask,
   because a very common line is in it, is copied and its probes are dealt over the copies.
5. The keys that a document loses go back to it, and its lines are told apart once more.

A line's key is the line without white space (0x20, 0x09 to 0x0D) at both ends and with A-Z folded. Keys of at least
LEAST code points in at least HOLDERS documents lose all their lines but those in the largest doc_id that holds them.

Defined results: a null or empty text is one empty line; a text is split whole, however long it or a line is;
every row is a document, so repeated rows count each and, tied as the largest doc_id, all keep their lines; a missing
doc_id is smaller than any other; an empty table gives no rows; other columns pass, whatever their names. Hashes of
128 bits stand for keys. Every line probed is in the index, so the fingerprint only tells lines of other tables apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalens.llm.common import IS_SPACE, buffer, mixed, slices, written

LEAST = 40
HOLDERS = 5
#: Keys of a shard, and probes of a shard above which it is copied.
SHARD_KEYS = 1 << 12
SHARD_PROBES = 1 << 16
#: Bits of a level of the perfect hash for each key that is not placed yet.
ROOM = 2
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)

INDEX = "shard int, probes bigint, sizes array<bigint>, bits binary, prints binary, counts binary, last binary"


def line_keys(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all lines: begin and end; for lines with a long key: which they are, and the key's hash in two halves."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([places[:-1], breaks + 1]), kind="stable")
    stops = np.sort(np.concatenate([breaks, places[1:]]), kind="stable")
    solid = np.concatenate([np.flatnonzero(~IS_SPACE[data]), [len(data)]])
    at = np.searchsorted(solid, starts)
    end = np.searchsorted(solid, stops)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    filled = np.flatnonzero(end > at)
    first, after = solid[at[filled]], solid[end[filled] - 1] + 1
    long = letters[after] - letters[first] >= LEAST
    folded = data.tobytes().lower()  # bytes.lower changes A-Z only
    digest = xxhash.xxh3_128_digest
    halves = b"".join([digest(folded[a:b]) for a, b in zip(first[long].tolist(), after[long].tolist())])
    return starts, stops, filled[long], np.frombuffer(halves, "<i8").reshape(-1, 2)


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, doc_id, text_key) of every different long key of a document."""
    for batch in slices(batches, most=1 << 20):
        data, places = buffer(batch.column("text"))
        _, _, long, pairs = line_keys(data, places)
        owner = np.repeat(np.arange(batch.num_rows), line_counts(data, places))[long]
        order = np.lexsort((pairs[:, 1], pairs[:, 0], owner))
        new = np.ones(len(order), bool)
        same = (owner[order][1:] == owner[order][:-1]) & (pairs[order][1:] == pairs[order][:-1]).all(1)
        new[1:] = ~same
        chosen = order[new]
        rows = pa.array(owner[chosen])
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[chosen, 0].copy()), pa.array(pairs[chosen, 1].copy()), batch.column("doc_id").take(rows), batch.column("text_key").take(rows)],
            ["hi", "lo", "doc_id", "text_key"],
        )


def line_counts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Lines of each text: line breaks and one."""
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    return breaks[places[1:]] - breaks[places[:-1]] + 1


def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mixed(mixed(hi.view(np.uint64) + seed) ^ lo.view(np.uint64)) % np.uint64(size)


def _prints(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (mixed(hi.view(np.uint64) ^ mixed(lo.view(np.uint64))) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bitmaps. A key takes its place in the first level where no other open key has it;
    its number is the count of set bits before that place."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def over(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(hi):
            size = max(64, ROOM * len(hi))
            place = _places(hi, lo, len(sizes), size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = ~alone[place]
            hi, lo = hi[left], lo[left]
        return cls(sizes, np.concatenate([np.zeros(0, bool), *levels]))

    def numbers(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The number of each key; a key that is not in the set has any number, or -1."""
        out = np.full(len(hi), -1, np.int64)
        open_, base = np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            place = base + _places(hi[open_], lo[open_], level, size).astype(np.int64)
            hit = self.bits[place]
            out[open_[hit]] = self.before[place[hit]]
            open_, base = open_[~hit], base + size
        return out


def _build(key: tuple, group: pa.Table) -> pa.Table:
    """One row of INDEX from the distinct hashes of a shard."""
    hi, lo, n, last = (np.array(group.column(c).combine_chunks(), np.int64) for c in ("hi", "lo", "n", "last"))
    hashes = PerfectHash.over(hi, lo)
    order = np.empty(len(hi), np.int64)
    order[hashes.numbers(hi, lo)] = np.arange(len(hi))
    counts = np.minimum(n[order], (1 << 32) - 1).astype("<u4")
    row = [key[0].as_py(), int(n.sum()), hashes.sizes, np.packbits(hashes.bits).tobytes(), _prints(hi, lo)[order].astype("<u4").tobytes(), counts.tobytes(), last[order].astype("<i8").tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "probes", "sizes", "bits", "prints", "counts", "last"])


def _answers(asked: pa.Table, index: pa.Table) -> pa.Table:
    """The probes whose count reaches HOLDERS and whose last holder is another document."""
    if asked.num_rows == 0 or index.num_rows == 0:
        return asked.select(["doc_id", "text_key", "hi", "lo"]).slice(0, 0)
    row = index.slice(0, 1).to_pylist()[0]
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
    hashes = PerfectHash(row["sizes"], bits)
    prints, counts, last = (np.frombuffer(row[c], k) for c, k in (("prints", "<u4"), ("counts", "<u4"), ("last", "<i8")))
    hi, lo, ids = (np.array(asked.column(c).combine_chunks(), np.int64) for c in ("hi", "lo", "doc_id"))
    number = hashes.numbers(hi, lo)
    known = (number >= 0) & (prints[number] == _prints(hi, lo))
    gone = known & (counts[number] >= HOLDERS) & (last[number] != ids)
    return asked.select(["doc_id", "text_key", "hi", "lo"]).filter(pa.array(gone))


def probes(docs: DataFrame) -> DataFrame:
    """(hi, lo, doc_id, text_key): the hashes of every row of ``docs``, which has text, doc_id and text_key."""
    return docs.select("doc_id", "text_key", "text").mapInArrow(_probes, "hi bigint, lo bigint, doc_id bigint, text_key bigint")


def shard_of(shards: int):
    """The shard of a hash, by the upper bits of its first half."""
    return F.shiftright(F.shiftrightunsigned("hi", 33) * F.lit(shards), 31).cast("int")


def line_index(asked: DataFrame) -> tuple[DataFrame, int]:
    """The written index of the hashes and its number of shards."""
    lines = written(asked.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "lines")
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    return written(lines.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(_build, INDEX), "index"), shards


def lost(asked: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, text_key, keys): the hashes that each document loses."""
    copies = F.ceil(F.col("probes") / SHARD_PROBES).cast("int")
    hot = written(index.where(F.col("probes") > SHARD_PROBES).select("shard", copies.alias("copies")), "hot")
    dealt = asked.withColumn("shard", shard_of(shards)).join(hot, "shard", "left")
    copy = F.pmod(F.xxhash64("doc_id", "text_key"), F.coalesce("copies", F.lit(1))).cast("int")
    dealt = dealt.select("shard", copy.alias("copy"), "hi", "lo", "doc_id", "text_key")
    arrays = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
    found = dealt.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(_answers, "doc_id bigint, text_key bigint, hi bigint, lo bigint")
    keys = F.collect_set(F.struct("hi", "lo")).alias("keys")
    return written(found.groupBy("doc_id", "text_key").agg(keys), "lost")


def _cut(texts: pa.Array, keys: pa.Array) -> Iterator[tuple[int, int, str]]:
    """(lines, lines dropped, text that is kept) of each document."""
    data, places = buffer(texts)
    raw = data.tobytes()
    counts = line_counts(data, places)
    dropped = np.zeros(int(counts.sum()), bool)
    heads = np.concatenate([[0], np.cumsum(counts)])
    starts, stops, long, pairs = line_keys(data, places)
    owner = np.searchsorted(heads, long, "right") - 1
    for i in np.unique(owner).tolist():
        if keys[i].is_valid and len(keys[i]):
            gone = {(k["hi"], k["lo"]) for k in keys[i].as_py()}
            for j in range(*np.searchsorted(owner, [i, i + 1]).tolist()):
                dropped[long[j]] = tuple(pairs[j].tolist()) in gone
    for i in range(len(counts)):
        a, b = heads[i], heads[i + 1]
        n = int(dropped[a:b].sum())
        if n == 0:
            kept = raw[places[i] : places[i + 1]]
        else:
            stay = a + np.flatnonzero(~dropped[a:b])
            kept = b"\n".join([raw[x:y] for x, y in zip(starts[stay].tolist(), stops[stay].tolist())])
        yield b - a, n, kept.decode()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 20):
        cut = list(_cut(batch.column("text"), batch.column("keys")))
        numbers = [pa.array([c[k] for c in cut], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *numbers, pa.array([c[2] for c in cut], pa.string())], ["row", "n_lines", "n_dropped", "kept"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 20):
        cut = list(_cut(batch.column("text"), batch.column("keys")))
        numbers = [pa.array([c[k] for c in cut], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array([hashlib.sha256(c[2].encode()).hexdigest() for c in cut])], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _with_lost(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, text and the keys that go, null where none does."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    asked = written(probes(rows.select(F.col("id").alias("doc_id"), "text_key", "text")), "probes")
    index, shards = line_index(asked)
    keys = lost(asked, index, shards).withColumnRenamed("doc_id", "id")
    return rows.join(keys, ["id", "text_key"], "left")


def deduped(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; ``text`` is without the lines that go. A null text stays null."""
    kind = T.StructType([T.StructField("row", docs.select(F.struct(*docs.columns)).schema[0].dataType)])
    kind = kind.add("n_lines", T.LongType()).add("n_dropped", T.LongType()).add("kept", T.StringType())
    found = _with_lost(docs).select("row", "text", "keys").mapInArrow(_kept, kind)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text")
    return found.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept, for every document."""
    found = _with_lost(docs.select("doc_id", "text")).select("doc_id", "text", "keys")
    return found.mapInArrow(_digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
