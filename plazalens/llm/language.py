"""Language ID by cross-parsing entropy.

A suffix automaton holds every substring of a language's sample. A text is parsed against it into
the longest substrings that the sample has, one after another; a text of the language needs few and
long phrases. The normalised number of phrases, count * log2(sample size) / text size, estimates
the cross entropy in bits a byte; the language with the fewest wins, ties by name.

Learning takes a bounded sample: ROWS labelled rows a language in hash order, CHARS characters at
a hashed place of each, at most BYTES bytes of whole characters a language. Every labelled language is learned; a
sample does not shrink as languages are added. Workers build the automata from it once. Parsing works on bytes, with letters
lower-cased and all else as blanks, in segments of SEGMENT bytes side by side; every byte of every
text is parsed.

Defined results: a null text, or one without any letter, is ``und`` with score 0, as is every text
if nothing is labelled; texts of any length are parsed whole; repeated rows get equal results; rows
without doc_id are not held out; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plazalens.llm.common import buffer, few, fresh, held_out, slices

ROWS = 256
CHARS = 192
BYTES = 64 << 10
SEGMENT = 128
#: The pipeline rejects texts that need more phrases a byte than this in every language: most of
#: their letters are in no sample.
STRANGE = 0.8

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for a-z and the Latin-1 letters, blanks for all other ASCII."""
    out = _FOLD[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


class Automaton:
    """All substrings of a sample as a table: state by byte class to the next state, or, negative,
    to the state after a new phrase has begun with that byte."""

    def __init__(self, sample: bytes, classes: np.ndarray, width: int):
        self.size = max(2, len(sample))
        codes = classes[np.frombuffer(sample, np.uint8)].tolist()
        # States are numbered from 1, the root; each knows its longest length and its link.
        steps: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in codes:
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(1)
            at = last
            while at and c not in steps[at]:
                steps[at][c] = new
                at = link[at]
            if at:
                other = steps[at][c]
                if length[other] == length[at] + 1:
                    link[new] = other
                else:
                    copy = len(steps)
                    steps.append(dict(steps[other]))
                    length.append(length[at] + 1)
                    link.append(link[other])
                    while at and steps[at].get(c) == other:
                        steps[at][c] = copy
                        at = link[at]
                    link[other] = link[new] = copy
            last = new
        # The last two columns: a byte that no sample has, and the end of a segment.
        root = np.full(width, -width, np.int32)
        for c, s in steps[1].items():
            root[c] = -s * width
        root[-1] = width
        table = np.tile(root, (len(steps), 1))
        rows = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
        columns = np.fromiter((c for s in steps for c in s), np.int64, len(rows))
        table[rows, columns] = np.fromiter((t for s in steps for t in s.values()), np.int64, len(rows)) * width
        self.table, self.width = table.reshape(-1), width

    def phrases(self, codes: np.ndarray) -> np.ndarray:
        """Phrases begun in each column of ``codes`` (a row per place, a column per segment)."""
        state = np.full(codes.shape[1], self.width, np.int32)
        count = np.zeros(codes.shape[1], np.int32)
        for row in codes:
            step = self.table[state + row]
            count += step < 0
            state = np.abs(step)
        return count


class Model:
    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.languages = [name for name, _ in samples]
        seen = np.unique(np.frombuffer(b"".join(s for _, s in samples), np.uint8))
        self.width = len(seen) + 2
        self.classes = np.full(256, len(seen), np.int32)
        self.classes[seen] = np.arange(len(seen))
        self.automata = [Automaton(s, self.classes, self.width) for _, s in samples]

    def rates(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Phrases a byte of every text (rows) in every language (columns)."""
        sizes = np.diff(places)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), pieces)
        first = np.cumsum(pieces) - pieces
        start = places[text] + (np.arange(len(text)) - first[text]) * SEGMENT
        at = start + np.arange(SEGMENT)[:, None]
        codes = np.where(at < places[text + 1], self.classes[folded(data)][np.minimum(at, len(data) - 1)], self.width - 1).astype(np.int32)
        out = np.zeros((len(sizes), len(self.languages)))
        for k, automaton in enumerate(self.automata):
            out[:, k] = np.bincount(text, automaton.phrases(codes), minlength=len(sizes)) if len(text) else 0
        return out / np.maximum(sizes, 1)[:, None]

    def bits(self) -> np.ndarray:
        return np.log2([a.size for a in self.automata])


@functools.lru_cache(2)
def _model(samples: tuple[tuple[str, bytes], ...]) -> Model:
    return Model(samples)


def samples(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> tuple[tuple[str, bytes], ...]:
    """(language, folded sample) of the rows that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = 1 + F.pmod(F.col("h"), F.greatest(F.lit(1), F.char_length("text") - chars))
    hashed = known.withColumn("h", F.xxhash64("text", "doc_id")).select("lang", "h", F.substring("text", place.cast("int"), F.lit(chars)).alias("piece"))
    totals = known.groupBy("lang").agg(F.count("*").alias("total"))
    # A row a language, so that the texts are thinned before any of them is shuffled.
    some = hashed.join(F.broadcast(totals), "lang").where(few(F.col("h"), rows, F.col("total")))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    found = some.withColumn("n", order).where(F.col("n") <= rows).select("lang", "n", "piece").collect()
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.n)):
        by.setdefault(r.lang, []).append(r.piece)
    return tuple((name, folded(np.frombuffer(_head(" ".join(p).encode()), np.uint8)).tobytes()) for name, p in by.items())


def _head(data: bytes, most: int | None = None) -> bytes:
    """At most BYTES bytes, cut before a character that would be parted."""
    end = min(len(data), most or BYTES)
    while 0 < end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return data[:end]


def _predict(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(learned.value)
        names = np.array([*model.languages, "und"], object)
        for batch in slices(batches, most=2 << 20):
            data, places = buffer(batch.column("text"))
            rates = model.rates(data, places)
            cost = rates * model.bits()
            fit = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool) & (cost.shape[1] > 0)
            best, score, low = np.full(len(fit), len(names) - 1), np.zeros(len(fit)), np.zeros(len(fit))
            if cost.shape[1]:
                best[fit] = cost[fit].argmin(1)
                low[fit] = rates[fit, best[fit]]
                two = np.sort(cost, 1)[:, :2] if cost.shape[1] > 1 else np.pad(cost, ((0, 0), (0, 1)), constant_values=np.inf)
                score[fit] = 1 - two[fit, 0] / np.maximum(two[fit, 1], 1e-9)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(low)],
                ["doc_id", "text_key", "lang_pred", "score", "phrases_per_byte"],
            )

    return run


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang_pred, score (how far the second language is behind) and
    phrases_per_byte of every row of ``docs``."""
    learned = docs.sparkSession.sparkContext.broadcast(samples(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(learned), f"doc_id {kind}, text_key bigint, lang_pred string, score double, phrases_per_byte double")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _accepted(learned, letters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(learned.value)
        for batch in slices(batches, most=2 << 20):
            rates = model.rates(*buffer(batch.column("text")))
            keep = np.asarray(batch.column(letters).to_numpy(zero_copy_only=False), bool)
            if rates.shape[1]:
                keep = keep & (rates.min(1) <= STRANGE)
            yield batch.filter(pa.array(keep)).drop_columns([letters])

    return run


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that some language explains: not those that are ``und`` or need more
    than STRANGE phrases a byte even in the language that suits them best."""
    learned = docs.sparkSession.sparkContext.broadcast(samples(docs))
    (letters,) = fresh(docs, "letters")
    rows = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(_accepted(learned, letters), docs.schema)
