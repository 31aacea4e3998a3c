"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazalens.session import prepare, work_folder

#: UTF-8 bytes of text that a Python worker handles at once; one longer text is handled whole.
SLICE_BYTES = 4 << 20

#: The bytes 0x09 to 0x0D and 0x20 end a word; all others belong to words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Rows of an Arrow batch; whole documents are long, and a batch is held in memory.
BATCH_ROWS = 2500


def ready(spark: SparkSession) -> SparkSession:
    """The session, prepared for this subpackage's jobs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return prepare(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text only, with ``text_key``, which tells rows of one doc_id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


#: Folders that ``written`` has made in this process, in order.
MADE: list[str] = []


def discard(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Remove the folders made after the first ``since``, except those that ``but`` is read from. Only
    for tables that nothing else is made of."""
    kept = but.inputFiles()
    for path in MADE[since:]:
        name = path.rsplit("/", 1)[1]  # unique
        if not any(f"/{name}/" in f for f in kept):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            MADE.remove(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_name(remainder_of: str = "doc_id"):
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out."""
    return F.crc32(F.encode(F.col(remainder_of).cast("string"), "UTF-8")) % 4


def held_out(remainder_of: str = "doc_id"):
    """True for held-out rows; a row without id is not held out."""
    return F.coalesce(split_name(remainder_of) == 2, F.lit(False))


def few(hashed, wanted: int, total):
    """True for about four times ``wanted`` of ``total`` rows, told by a 64-bit hash: the rows that a
    bounded sample in hash order is taken from, so that no task sends more than its share."""
    share = F.least(F.lit(1.0), F.lit(4.0 * wanted) / F.greatest(F.lit(1), total))
    return F.shiftrightunsigned(F.xxhash64(hashed), 34) < share * (1 << 30)


def bounds(rows: DataFrame, rows_each: int, most: int = 16_384) -> list:
    """Rising doc_ids that deal the rows into ranges of about ``rows_each``, at most ``most`` ranges."""
    parts = max(1, min(most, rows.count() // rows_each))
    wanted = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", wanted, 10 * parts)).first()[0] if wanted else None
    return sorted(set(found or []))


def part_of(column, cuts: list):
    """How many bounds are at or below the id; -1 without id. The bounds are searched in two steps,
    a stretch and a place in it."""
    wide = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]

    def below(items):
        return F.aggregate(items, F.lit(0), lambda n, c: n + (c <= column).cast("int"))

    if not cuts:
        number = F.lit(0)
    else:
        stretch = F.greatest(below(F.array(*[F.lit(s[0]) for s in stretches])) - 1, F.lit(0))
        table = F.array(*[F.array(*map(F.lit, s)) for s in stretches])
        number = stretch * wide + below(F.get(table, stretch))
    return F.when(column.isNull(), F.lit(-1)).otherwise(number)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and the place where each text begins (one more
    than there are texts). Nulls are empty."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, places = buffer(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(places, places[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each text the number of words before it."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(places), np.int64)
    inside = ~IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = places[:-1][places[:-1] < places[1:]]
    last = places[1:][places[:-1] < places[1:]] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, places)


def spans(places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat indices of the ranges ``places[i]`` to ``places[i + 1]`` for every i of ``at``, one
    after another, and where each of them begins in the result."""
    lengths = places[at + 1] - places[at]
    heads = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.arange(heads[-1], dtype=np.int64) + np.repeat(places[at] - heads[:-1], lengths)
    return flat, heads


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2^64 of any range of a sequence, from prefix sums."""

    def __init__(self, seed: int):
        at = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.table = mixed(at + np.uint64(seed))
        self.base = np.uint64(int(mixed(np.array([seed + 77], np.uint64))[0]) & ~7 | 5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 1 << 16)
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums; bytes go through the table, 64-bit values are taken as they are."""
        values = self.table[values] if values.dtype == np.uint8 else values
        self._grow(len(values))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.powers[: len(values)], dtype=np.uint64)])

    def ranges(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each range; it depends on the content and the length only."""
        plain = (prefix[stop] - prefix[start]) * self.inverses[start]
        return mixed(plain + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def pieces(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """Hashes of rising ranges of bytes; so many at a time, which bounds the prefix sums."""
        out = np.zeros(len(start), np.uint64)
        for k in range(0, len(start), step):
            a, b = start[k : k + step], stop[k : k + step]
            out[k : k + step] = self.ranges(self.prefix(data[a[0] : b[-1]]), a - a[0], b - a[0])
        return out
