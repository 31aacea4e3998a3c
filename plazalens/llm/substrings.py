"""Substring dedup by seed and extend over winnowed anchors.

A window is WINDOW consecutive words of one text; a window is a repeat if the same words also
start anywhere else. All words that repeats cover are removed.

1. Seed. In every window the smallest hash of ANCHOR consecutive words is its anchor (leftmost on
   ties). Equal windows have equal anchors at equal places, so a repeat is never missed.
   Neighbouring windows with one anchor form a *cell*: the anchor extended both ways as far as it
   stays the smallest. A text has about one cell per 13 words.
2. Anchors that occur once end here: none of their windows is a repeat.
3. Extend. Cells of one anchor whose whole words are equal are repeats from end to end. A cell that
   nothing equals in full is extended word by word: its windows are compared with the windows of
   one cell of each kind that shares the anchor. Maximal repeats come out as merged ranges.

Occurrences are counted and joined, never paired, so a passage in n texts costs n rows. Two
independent hashes of 64 bits (anchor and window) must agree.

Defined results: a null or empty text has no words; texts shorter than WINDOW keep all words;
repeated rows are copies of each other; rows without doc_id are rows like any other; an empty table
gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalens.llm.common import Rolling, buffer, keyed, slices, words, written

WINDOW = 35
ANCHOR = 10

_WORD, _GRAM, _WINDOW = Rolling(1), Rolling(2), Rolling(3)


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For every place, where the smallest of the ``width`` values from there on stands."""
    at, covered = np.arange(len(values)), 1
    low = values
    while covered < width:
        step = min(covered, width - covered)
        if len(low) <= step:
            return at[:0]
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.where(later, low[step:], low[:-step])
        covered += step
    return at


class Text:
    """Word and window hashes of the texts of a slice."""

    def __init__(self, column: pa.Array):
        data, places = buffer(column)
        begins, ends, self.first = words(data, places)
        self.hashes = _WORD.pieces(data, begins, ends)
        self.prefix = _WINDOW.prefix(self.hashes)

    def windows(self, at: np.ndarray, count: np.ndarray | int = 1) -> np.ndarray:
        """Hash of the words that ``count`` windows from place ``at`` on cover."""
        return _WINDOW.ranges(self.prefix, at, at + count + WINDOW - 1)

    def cells(self) -> tuple[np.ndarray, ...]:
        """Text number, first window, number of windows, anchor and cell hash of every cell."""
        n = len(self.hashes)
        if n < WINDOW:
            none = np.zeros(0, np.int64)
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        at = np.arange(n - ANCHOR + 1)
        grams = _GRAM.ranges(_GRAM.prefix(self.hashes), at, at + ANCHOR)
        chosen = _leftmost_minimum(grams, WINDOW - ANCHOR + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[: len(chosen)]
        inside = np.flatnonzero(np.arange(len(chosen)) + WINDOW <= self.first[text + 1])
        chosen = chosen[inside]
        heads = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else inside
        start = inside[heads]
        count = np.diff(np.concatenate([heads, [len(chosen)]]))
        return text[start], start, count, grams[chosen[heads]], self.windows(start, count)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = Text(batch.column("text"))
        row, start, count, anchor, cell = texts.cells()
        index = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(index),
                batch.column("text_key").take(index),
                pa.array((start - texts.first[row]).astype(np.int32)),
                pa.array(count.astype(np.int32)),
                _signed(anchor),
                _signed(cell),
            ],
            ["doc_id", "text_key", "start", "windows", "anchor", "cell"],
        )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; null lists are empty."""
    flat = column.flatten()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return flat.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the cells in question; ``weight`` 2 where it is a repeat already."""
    for batch in slices(batches):
        texts = Text(batch.column("text"))
        start, row = _flat(batch.column("start"))
        count, anchor, whole = (_flat(batch.column(c))[0] for c in ("windows", "anchor", "whole"))
        cell = np.repeat(np.arange(len(start)), count)
        at = start[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
        index = pa.array(row[cell])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(index),
                batch.column("text_key").take(index),
                pa.array(at.astype(np.int32)),
                pa.array(anchor[cell]),
                _signed(texts.windows(texts.first[row[cell]] + at)),
                pa.array(np.where(whole[cell], 2, 1).astype(np.int32)),
            ],
            ["doc_id", "text_key", "start", "anchor", "window", "weight"],
        )


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def repeats(docs: DataFrame) -> DataFrame:
    """Per text with repeats: doc_id, text_key, and arrays ``start`` and ``windows``: from word
    ``start`` on, so many windows in a row are repeats."""
    texts = keyed(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {kind}, text_key bigint, start int"
    cells = texts.mapInArrow(_cells, f"{key}, windows int, anchor bigint, cell bigint")
    shared = cells.groupBy("anchor").agg(F.count("*").alias("n")).where("n >= 2").select("anchor")
    # Written, so that both sides of the join are dealt anew and an anchor of very many cells can be split.
    matched = written(cells.join(written(shared, "shared"), "anchor"), "matched")

    kinds = matched.groupBy("anchor", "cell").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start")).alias("one"))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("cells"))
    kinds = written(kinds.join(several, "anchor"), "kinds")
    judged = written(
        matched.join(kinds, ["anchor", "cell"]).select(
            "doc_id", "text_key", "start", "windows", "anchor",
            (F.col("n") >= 2).alias("whole"),
            ((F.col("cells") >= 2) & ((F.col("n") == 1) | F.col("one").eqNullSafe(F.struct("doc_id", "text_key", "start")))).alias("compare"),
        ),
        "judged",
    )
    asked = judged.where("compare").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows", "anchor", "whole")).alias("c"))
    asked = asked.select("doc_id", "text_key", "c.start", "c.windows", "c.anchor", "c.whole")
    both = texts.join(asked, _same(texts, asked)).select(texts["doc_id"], texts["text_key"], texts["text"], "start", "windows", "anchor", "whole")
    windows = both.mapInArrow(_windows, f"{key}, anchor bigint, window bigint, weight int")
    again = windows.groupBy("anchor", "window").agg(F.sum("weight").alias("n")).where("n >= 2").select("anchor", "window")
    partly = windows.where("weight = 1").join(again, ["anchor", "window"]).select("doc_id", "text_key", "start", F.lit(1).alias("windows"))
    wholly = judged.where("whole").select("doc_id", "text_key", "start", "windows")
    ranges = wholly.unionByName(partly).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows")).alias("r"))
    return ranges.select("doc_id", "text_key", "r.start", "r.windows")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, places = buffer(batch.column("text"))
        raw = data.tobytes()
        start, row = _flat(batch.column("start"))
        count = _flat(batch.column("windows"))[0]
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
        out: list[list] = [[], [], [], []]
        for i in range(batch.num_rows):
            tokens = raw[places[i] : places[i + 1]].split()  # at 0x09 to 0x0D and 0x20
            some = slice(bounds[i], bounds[i + 1])
            spans: list[tuple[int, int]] = []
            if some.start < some.stop:
                steps = np.zeros(len(tokens) + 1, np.int64)
                np.add.at(steps, start[some], 1)
                np.add.at(steps, start[some] + count[some] + WINDOW - 1, -1)
                gone = np.cumsum(steps)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
            kept, at = [], 0
            for a, b in spans:
                kept += tokens[at:a]
                at = b
            kept += tokens[at:]
            for column, value in zip(out, (len(tokens), len(tokens) - len(kept), b" ".join(kept).decode(), [{"start": a, "stop": b} for a, b in spans])):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))], ["doc_id", "n_words", "n_removed", "kept", "spans"])


def cut(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, ``kept`` (the words left, joined by one
    space) and ``spans`` (maximal ranges of words that went)."""
    texts, found = keyed(docs), repeats(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    both = texts.join(found, _same(texts, found), "left").select(texts["doc_id"], texts["text"], "start", "windows")
    return both.mapInArrow(_cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,stop:bigint>>")


def report(docs: DataFrame) -> DataFrame:
    return cut(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
