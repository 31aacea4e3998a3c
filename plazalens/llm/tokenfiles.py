"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are counted over all texts and replaced by their rank, so frequent ids need one byte. A block
holds whole documents of about BLOCK_TOKENS ids in ascending doc_id order in two streams: control bytes with
two bits per id (its number of bytes less one) and data bytes, little-endian. Four ids share a
control byte, and a table of 256 rows gives the four lengths, so numpy decodes a block by table
lookups without a loop. Blocks are rows of a table in the shared folder (part, block, first id,
documents with their lengths, control, data); the ranks lie beside it.

Texts are encoded by the tokenizers library, a piece between white space at a time, as its pattern
never crosses white space: equal pieces of a slice are encoded once.

Order without one task that sees all: documents are dealt into parts, ranges of doc_id, and sorted
inside a part; the number of ids before each part comes from the sums per part.

Defined results: a null text is empty and has only the end id; rows without doc_id come first;
repeated rows stand next to each other; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import string
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plazalens.llm.common import slices, spans, written
from plazalens.session import work_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
BLOCK_TOKENS = 1 << 16
SLICE = 8 << 20
#: Words that a worker keeps from slice to slice.
CACHED = 1_000_000

#: The ASCII signs; one run of them is one word of the tokenizer's pattern unless letters follow an apostrophe.
SIGNS = string.punctuation
SIMPLE = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+[{re.escape(SIGNS)}]*$"

#: For each control byte, the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2^32."""
    numbers = numbers.astype("<u4")
    codes = np.zeros(-len(numbers) % 4 + len(numbers), np.uint8)
    used = np.ones((len(numbers), 4), bool)
    for k in range(1, 4):
        used[:, k] = numbers >= np.uint32(1 << 8 * k)
        codes[: len(numbers)] += used[:, k]
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = numbers.view(np.uint8)[used.reshape(-1)]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    out = np.zeros((count, 4), np.uint8)
    out[used] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Ids of pieces between white space, from the tokenizers library.

    A piece of Latin letters, perhaps with signs behind, is two words of the tokenizer's pattern, each in
    lower case; such words go to the library many at a time, joined by blanks, and their ids are told
    apart by the mark of a word's last id. Their lower case is composed already and blanks alone divide
    them, so ``plain``, the same model without normalizer and pattern, has the same ids for them.
    Other pieces go to the whole tokenizer one by one. At most about CACHED words of a worker, or eight times
    as many ids, stay known.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.tokenizer, self.plain):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], []
        for k in range(0, len(pieces), 8192):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k : k + 8192], add_special_tokens=False)]
            counts += map(len, found)
            ids.append(np.fromiter((i for f in found for i in f), np.uint32))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _together(self, words: list[str], at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        if "" in words:  # no signs behind a word
            k = words.index("")
            ids, counts = self._together(words[:k] + words[k + 1 :])
            return ids, np.insert(counts, k, 0)
        lines = [words[k : k + at_once] for k in range(0, len(words), at_once)]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for line, found in zip(lines, self.plain.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            flat = np.array(found.ids, np.uint32)
            stops = np.flatnonzero(self.last[flat]) + 1
            if len(stops) != len(line):  # the library sees other words here
                flat, sizes = self._one_by_one(line)
            else:
                sizes = np.diff(np.concatenate([[0], stops]))
            ids.append(flat)
            counts.append(sizes)
        return np.concatenate(ids), np.concatenate(counts)

    def _entries(self, words: list[str], encode) -> np.ndarray:
        """Places of the words in the table; those not known are encoded and added to it."""
        entry = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(entry < 0)
        new = [words[i] for i in unseen.tolist()]
        ids, counts = encode(new)
        entry[unseen] = len(self.counts) + np.arange(len(new))
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.known.update(zip(new, entry[unseen].tolist()))
        return entry

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and where those of each begin."""
        if len(self.known) > CACHED or len(self.ids) > 8 * CACHED:  # what came last goes
            keep = min(CACHED // 2, int(np.searchsorted(np.cumsum(self.counts), 4 * CACHED, "right")))
            self.known = dict(itertools.islice(self.known.items(), keep))
            self.ids, self.counts = self.ids[: self.counts[:keep].sum()], self.counts[:keep]
        simple = pc.match_substring_regex(pieces, SIMPLE)
        some = pieces.filter(simple)
        parts = np.full((len(pieces), 2), -1, np.int64)
        at = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        for k, column in enumerate((pc.utf8_lower(pc.utf8_rtrim(some, SIGNS)), pc.replace_substring_regex(some, f"^[^{re.escape(SIGNS)}]+", ""))):
            coded = column.dictionary_encode()
            entry = self._entries(_strings(coded.dictionary), self._together)
            parts[at, k] = entry[coded.indices.to_numpy(zero_copy_only=False)]
        others = pieces.filter(pc.invert(simple))
        parts[np.flatnonzero(parts[:, 0] < 0), 0] = self._entries(_strings(others), self._one_by_one)
        places = np.concatenate([[0], np.cumsum(self.counts), [self.counts.sum()]])  # the last entry, -1, has no ids
        flat, heads = spans(places, np.where(parts < 0, len(self.counts), parts).reshape(-1))
        return self.ids[flat], heads[::2]


@functools.lru_cache(1)
def _words(path: str) -> Words:
    return Words(path)


def encoded(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with the end id, one after another, and where those of each text begin."""
    split = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    words = split.flatten().dictionary_encode()
    table, places = _words(path).encode(words.dictionary)
    flat, heads = spans(places, words.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    borders = heads[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])]
    return np.insert(table[flat], borders[1:], END), borders + np.arange(len(borders))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            ids, places = encoded(batch.column("text"), path)
            small = ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
            raw, wide = small.tobytes(), small.itemsize
            rows = pa.array([raw[a * wide : b * wide] for a, b in zip(places, places[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, pa.array([wide] * len(rows), pa.int8())], ["doc_id", "ids", "wide"])

    return run


def _ids(raw: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{wide}").astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
        widths = batch.column("wide").to_numpy(zero_copy_only=False)
        for wide in np.unique(widths):
            raw = batch.column("ids").filter(pa.array(widths == wide)).to_pylist()
            counts = np.bincount(np.frombuffer(b"".join(raw), f"<u{wide}"))
            if len(counts) > len(total):
                total = np.pad(total, (0, len(counts) - len(total)))
            total[: len(counts)] += counts
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def ranks(tokens: DataFrame) -> DataFrame:
    """(id, rank): rank 0 is the most frequent id; ties by id. As many rows as the vocabulary has."""
    counts = tokens.mapInArrow(_counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"))


def _blocks(order):
    """Blocks of a sorted partition. A block ends with a document, at BLOCK_TOKENS ids or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, count = TaskContext.get().partitionId(), 0, 0, 0
        rows: list[tuple] = []
        held: list[np.ndarray] = []

        def flush():
            ids = np.concatenate(held)
            control, data = pack(order.value[ids])
            record = {
                "part": part, "block": block, "before": before, "count": len(ids),
                "docs": [r[0] for r in rows], "lengths": [r[1] for r in rows], "control": control, "data": data,
            }
            rows.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([record], pa.schema(BLOCK_FIELDS))

        for batch in batches:
            for doc, raw, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "wide"))):
                ids = _ids(raw, wide)
                rows.append((doc, len(ids)))
                held.append(ids)
                count += len(ids)
                if count >= BLOCK_TOKENS:
                    yield flush()
                    block, before, count = block + 1, before + count, 0
        if rows:
            yield flush()

    return run


BLOCK_FIELDS = [
    ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("count", pa.int64()),
    ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()),
]
BLOCK_TYPES = "part int, block int, before bigint, count bigint, docs array<bigint>, lengths array<bigint>, control binary, data binary"


def write(docs: DataFrame, folder: str, path: str = TOKENIZER) -> None:
    """Encode ``docs`` and write blocks and ranks under ``folder``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = written(rows.mapInArrow(_encode(path), "doc_id bigint, ids binary, wide tinyint"), "token-ids", "zstd")
    order = written(ranks(tokens), "ranks")
    order.coalesce(1).write.parquet(f"{folder}/ranks")
    table = order.toPandas()  # a row per id of the vocabulary
    lookup = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.int64)
    lookup[table["id"].to_numpy(int)] = table["rank"].to_numpy(int)
    # Parts are ranges of doc_id, as many as the cluster has shuffle partitions. Rows of equal id
    # are ordered by their content, so that blocks are the same in every run.
    parts = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))
    blocks = parts.mapInArrow(_blocks(spark.sparkContext.broadcast(lookup)), BLOCK_TYPES)
    blocks.write.option("compression", "zstd").parquet(f"{folder}/blocks")


def _read(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = order.value[unpack(row["control"], row["data"], row["count"])]
                stops = np.cumsum(row["lengths"])
                starts = stops - row["lengths"]
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(stops), pa.int32()),
                        pa.array(row["docs"], pa.int64()),
                        pa.array(row["before"] + starts, pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(starts, stops)], pa.binary()),
                    ],
                    ["part", "doc_id", "at", "n_tokens", "ids"],
                )

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ``start`` (ids before it), n_tokens and ``ids`` (32-bit little-endian) from the files."""
    table = spark.read.parquet(f"{folder}/ranks").toPandas()
    back = np.zeros(len(table) or 1, "<u4")
    back[table["rank"].to_numpy(int)] = table["id"].to_numpy(int)
    blocks = spark.read.parquet(f"{folder}/blocks")
    sums = blocks.groupBy("part").agg(F.sum("count").alias("n"))  # a row per part
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = blocks.mapInArrow(_read(spark.sparkContext.broadcast(back)), "part int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(first), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")


def report(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Write the files, read them back, and digest what they hold."""
    folder = f"{work_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder, path)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
