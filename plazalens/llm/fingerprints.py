"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph ends at a line end, or inside a line after a word whose hash is divisible by
PARAGRAPH, so that long lines have paragraphs of about that many words which an edit elsewhere leaves alone. Each
paragraph (with its number of earlier occurrences) is a 64-bit digest and goes into one cell of each
of three parts of the sketch; a cell keeps a count, a sum of digests and a sum of check values.

Two sketches are subtracted cell by cell. Cells with one digest left are peeled until nothing is
left; that recovers the digests on either side only. If peeling fails, sketches of four times as
many cells are made, and again, until it succeeds. The likeness is the share of common digests among
all (1 for two empty texts).

The next document in descending order of doc_id stands in the row below: documents are dealt into
ranges of doc_id, each range also gets the first row of the range below it as a guest, and texts
are shuffled once.

Defined results: a null text is empty; ties on doc_id are ordered by a hash of the text; rows
without doc_id come last; a single row is its own next; an empty table gives no rows; other columns
are left aside.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plazalens.llm.common import Rolling, bounds, buffer, keyed, mixed, part_of, slices, words

PARAGRAPH = 8
#: Cells of the fingerprint that is given out, in three parts.
CELLS = 24
GROWTH = 4
#: Rows that a range of doc_id should hold.
RANGE_ROWS = 1024

_WORD, _TEXT = Rolling(11), Rolling(12)


class Digests:
    """Paragraph digests of many texts: ``values``, and where each text's begin."""

    def __init__(self, column: pa.Array):
        data, places = buffer(column)
        begins, ends, first = words(data, places)
        n = len(begins)
        if not n:
            self.values, self.places = np.zeros(0, np.uint64), np.zeros(len(places), np.int64)
            return
        hashes = _WORD.pieces(data, begins, ends)
        line = np.cumsum(data == 10, dtype=np.int32)
        last = hashes % np.uint64(PARAGRAPH) == 0
        last[:-1] |= line[begins[1:] - 1] > line[ends[:-1] - 1]
        last[first[1:][first[1:] > 0] - 1] = True
        stops = np.flatnonzero(last)
        starts = np.concatenate([[0], stops[:-1] + 1])
        plain = _TEXT.pieces(data, begins[starts], ends[stops])
        self.places = np.searchsorted(stops, first)
        text = np.repeat(np.arange(len(places) - 1), np.diff(self.places))
        order = np.lexsort((plain, text))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (plain[order][1:] != plain[order][:-1]) | (text[order][1:] != text[order][:-1])
        number = np.arange(len(order))
        number = number - np.maximum.accumulate(np.where(fresh, number, 0))
        self.values = np.empty_like(plain)
        self.values[order] = mixed(plain[order] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of some texts, and for each the place of its text in ``rows``."""
        sizes = np.diff(self.places)[rows]
        before = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.places[rows] - before, sizes)
        return self.values[at], np.repeat(np.arange(len(rows)), sizes)

    def sizes(self) -> np.ndarray:
        return np.diff(self.places)


class Sketches:
    """Sketches of ``n`` texts with ``cells`` cells each."""

    def __init__(self, n: int, cells: int):
        self.n, self.width = n, cells // 3
        self.count = np.zeros(3 * n * self.width, np.int32)
        self.key = np.zeros(len(self.count), np.uint64)
        self.check = np.zeros(len(self.count), np.uint32)

    def _cell(self, part: int, text: np.ndarray, digest: np.ndarray) -> np.ndarray:
        spread = mixed(digest + np.uint64(part + 1) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.width)
        return (part * self.n + text) * self.width + spread.astype(np.int64)

    @staticmethod
    def _check(digest: np.ndarray) -> np.ndarray:
        return (mixed(digest ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)

    def add(self, text: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int32), len(digest))
        check = self._check(digest) * sign.view(np.uint32)
        value = digest * sign.astype(np.int64).view(np.uint64)
        for part in range(3):
            cell = self._cell(part, text, digest)
            np.add.at(self.count, cell, sign)
            np.add.at(self.key, cell, value)
            np.add.at(self.check, cell, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: digests left on the first side, on the second, and whether all came out."""
        sides = np.zeros((2, self.n), np.int64)
        size = self.n * self.width
        moved = True
        while moved:
            moved = False
            for part in range(3):
                some = slice(part * size, (part + 1) * size)
                cell = np.flatnonzero(np.abs(self.count[some]) == 1) + part * size
                sign = self.count[cell]
                digest = self.key[cell] * sign.astype(np.int64).view(np.uint64)
                pure = self._check(digest) * sign.view(np.uint32) == self.check[cell]
                text = (cell - part * size) // self.width
                pure &= self._cell(part, text, digest) == cell
                text, digest, sign = text[pure], digest[pure], sign[pure]
                if len(text):
                    moved = True
                    self.add(text, digest, -sign)
                    for side, wanted in enumerate((1, -1)):
                        sides[side] += np.bincount(text[sign == wanted], minlength=self.n)
        left = ((self.count != 0) | (self.key != 0)).reshape(3, self.n, self.width).any((0, 2))
        return sides[0], sides[1], ~left

    def strings(self) -> list[str]:
        """One text form per sketch."""
        parts = [x.reshape(3, self.n, self.width).transpose(1, 0, 2).reshape(self.n, -1) for x in (self.count, self.key, self.check)]
        rows = np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(self.n, -1) for x in parts], axis=1)
        return [base64.b64encode(r.tobytes()).decode() for r in rows]


def fingerprint(d: Digests, cells: int = CELLS) -> list[str]:
    n = len(d.places) - 1
    out = Sketches(n, cells)
    values, text = d.of(np.arange(n))
    out.add(text, values, 1)
    return out.strings() if n else []


def difference(a: Digests, b: Digests, rows_a: np.ndarray, rows_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only text ``rows_a[i]`` has, and only ``rows_b[i]``."""
    only_a, only_b = np.zeros(len(rows_a), np.int64), np.zeros(len(rows_a), np.int64)
    sizes_a, sizes_b = a.sizes()[rows_a], b.sizes()[rows_b]
    todo, cells = np.arange(len(rows_a)), CELLS
    while len(todo):
        # Sketches with fewer cells than the difference in size cannot be peeled.
        ready = todo[np.abs(sizes_a - sizes_b)[todo] <= cells]
        hopeless = ready[cells > 64 * (sizes_a + sizes_b)[ready] + 1024]
        for i in hopeless:  # digests that share all cells time and again
            x, y = (set(d.of(np.array([r[i]]))[0].tolist()) for d, r in ((a, rows_a), (b, rows_b)))
            only_a[i], only_b[i] = len(x - y), len(y - x)
        ready = np.setdiff1d(ready, hopeless)
        done = [hopeless]
        step = max(1, (1 << 20) // cells)
        for k in range(0, len(ready), step):
            some = ready[k : k + step]
            sketches = Sketches(len(some), cells)
            for d, rows, sign in ((a, rows_a, 1), (b, rows_b, -1)):
                values, text = d.of(rows[some])
                sketches.add(text, values, sign)
            plus, minus, good = sketches.peel()
            only_a[some[good]], only_b[some[good]] = plus[good], minus[good]
            done.append(some[good])
        todo = np.setdiff1d(todo, np.concatenate(done))
        cells *= GROWTH
    return only_a, only_b


def likeness(a: Digests, b: Digests, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    only_a, only_b = difference(a, b, rows_a, rows_b)
    common = a.sizes()[rows_a] - only_a
    union = common + only_a + only_b
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each followed by its next; a guest ends every range."""
    carried: list[tuple] = []
    for batch in slices(batches, most=2 << 20):
        rows = carried + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))))
        carried = rows[-1:]
        own = np.array([i for i, r in enumerate(rows[:-1]) if not r[2]], np.int64)
        if not len(own):
            continue
        texts = [r[1] or "" for r in rows]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        plain, new = Digests(pa.array(texts, pa.large_string())), Digests(pa.array(changed, pa.large_string()))
        names = fingerprint(plain)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in own], batch.schema.field("doc_id").type),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([names[i] for i in own]),
                pa.array(fingerprint(new)),
                pa.array(likeness(plain, new, own, np.arange(len(own)))),
                pa.array(likeness(plain, plain, own, own + 1)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def with_guests(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text and ``guest``, ordered inside partitions so that the next document (by falling
    doc_id, the first after the last) is in the row below."""
    rows = keyed(docs)
    rows = rows.withColumn("range", part_of(F.col("doc_id"), bounds(docs, range_rows)))
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", "text_key")).alias("head"))  # a row per range
    falling = Window.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    host = F.coalesce(F.lag("range").over(falling), F.min("range").over(Window.partitionBy(F.lit(0))))
    heads = heads.select(F.col("range").alias("_range"), host.alias("host"), F.col("head.doc_id").alias("_id"), F.col("head.text_key").alias("_key"))
    is_head = (F.col("range") == F.col("_range")) & (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    both = rows.join(F.broadcast(heads), is_head, "left").select("doc_id", "text", "text_key", "range", "host")
    places = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))
    both = both.select("doc_id", "text", "text_key", F.explode(places).alias("p")).where("p.range is not null")
    both = both.select("doc_id", "text", "text_key", "p.range", "p.guest").repartition("range")
    return both.sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.desc("text_key")).select("doc_id", "text", "guest")


def report(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_guests(docs).mapInArrow(
        _compare,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
