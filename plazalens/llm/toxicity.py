"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon is learned from a bounded sample of labelled rows that are not held out: words and word
   beginnings that toxic texts have much more often than others, with smoothed log odds.
2. Every whole text becomes a row of dense features: lexicon densities (words, beginnings,
   obfuscated spellings), nearness of second-person words to lexicon words, capitals, punctuation
   and obfuscation rates.
3. Spark's gradient-boosted trees learn from the same sample; an isotonic regression over
   the margin of rows that the trees did not see gives the probability. Equal probabilities are ordered by
   the margin.

Labels, lang, source and doc_id are never features. The rows of a text depend on that text and the
model only.

Defined results: a null text is empty and is scored like any other; repeated rows get equal scores; a row
without doc_id is not held out; if the sample lacks either class, every score is the share of toxic
rows in it (0 without any); an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazalens.llm.common import few, held_out, slices, written

#: Most labelled rows that the lexicon and the trees learn from, in hash order.
SAMPLE = 12_000
#: Most lexicon entries, least toxic rows and least log odds of an entry.
LEXICON = 2_000
SUPPORT = 3
ODDS = 1.5
BEGINNINGS = range(4, 9)
THRESHOLD = 0.3

#: Second-person words, and signs that stand for letters.
SECOND = set("you your yours yourself youre u ur du dich dir dein deine deinen ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = (
    "words", "lexicon_share", "lexicon_count", "lexicon_weight", "lexicon_top", "beginning_share", "beginning_count", "beginning_weight",
    "obfuscated_hits", "second_share", "second_near", "capital_share", "shouted_share", "exclaimed", "punctuated", "obfuscated_share", "stretched_share",
)

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_MIXED = re.compile(r"[^\W\d_][\d@$!*#%&]+[^\W\d_]")
_STRETCH = re.compile(r"(.)\1\1")


def bare(word: str) -> str:
    """A word in lower case without signs and digits at its ends."""
    return _EDGE.sub("", word.lower())


def terms(word: str) -> list[str]:
    """A bare word and, marked by a final hyphen, its beginnings."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with and without the label that hold each term."""
    for batch in slices(batches):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            held = {t for w in set(map(bare, set((text or "").split()))) if w for t in terms(w)}
            for t in held:
                counts.setdefault(t, [0, 0])[toxic] += 1
        clean, toxic = zip(*counts.values()) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["term", "clean", "toxic"])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled rows that are not held out: text, toxic and ``fold``."""
    marks = labels.where("toxic in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["_id"])
    known = docs.where(~held_out()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    # The smallest hashes are found without the texts first.
    marked = known.select("doc_id", "h").join(marks, F.col("doc_id") == F.col("_id")).select("h", "toxic")
    chosen = marked.where(few(F.col("h"), most, F.lit(marked.count()))).orderBy("h").limit(most)
    return known.join(F.broadcast(chosen), "h").select("text", "toxic", F.pmod(F.xxhash64("h"), F.lit(4)).alias("fold"))


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Term to log odds, as the sample shows them; at most LEXICON entries come to the driver."""
    counts = rows.select("text", "toxic").mapInArrow(_term_counts, "term string, clean bigint, toxic bigint")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= SUPPORT)
    total = rows.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first()
    clean, toxic = (x or 0 for x in total)
    odds = F.log((F.col("toxic") + 0.1) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    top = counts.withColumn("odds", odds).where(F.col("odds") >= ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(LEXICON)
    return {r.term: r.odds for r in top.collect()}


def _measure(word: str, known: dict[str, float]) -> tuple[float, ...]:
    """Lexicon weight, weight of the heaviest beginning, obfuscated hit, second person, letters,
    capitals, shouted, exclamation marks, other punctuation, obfuscated, stretched."""
    plain = bare(word)
    weight = known.get(plain, 0.0)
    start = max((known.get(plain[:n] + "-", 0.0) for n in BEGINNINGS if len(plain) > n), default=0.0)
    hidden = 0
    if not weight and not plain.isalpha():
        weight = known.get(re.sub(r"[\W\d_]+", "", word.lower().translate(SIGNS)), 0.0)
        hidden = int(weight > 0)
    letters = sum(map(str.isalpha, word))
    capitals = sum(map(str.isupper, word))
    marks = word.count("!") + word.count("?")
    return (
        weight, start, hidden, plain in SECOND, letters, capitals, letters > 2 and capitals == letters, marks,
        len(word) - letters - marks, _MIXED.search(word) is not None, _STRETCH.search(plain) is not None,
    )


def features(column: pa.Array, known: dict[str, float]) -> np.ndarray:
    """A row of FEATURES per text; each distinct word of a slice is measured once."""
    split = pc.ascii_split_whitespace(column.fill_null("").cast(pa.large_string()))
    words = split.flatten().dictionary_encode()
    measured = np.array([_measure(w, known) for w in words.dictionary.to_pylist()], np.float64).reshape(-1, 11)
    per_word = measured[words.indices.to_numpy(zero_copy_only=False)]
    real = (per_word[:, 4] + per_word[:, 7] + per_word[:, 8]) > 0  # not the empty string beside white space
    text = np.repeat(np.arange(len(column)), split.value_lengths().to_numpy(zero_copy_only=False))[real]
    per_word = per_word[real]
    n = len(column)
    total = np.zeros((n, 11))
    for k in range(11):
        total[:, k] = np.bincount(text, per_word[:, k], minlength=n)
    hit, start = per_word[:, 0] > 0, per_word[:, 1] > 0
    count, hits, starts = (np.bincount(t, minlength=n) for t in (text, text[hit], text[start]))
    top = np.zeros(n)
    np.maximum.at(top, text, per_word[:, 0])
    # Words of the lexicon within five words of a second-person word of the same text.
    second, at = np.flatnonzero(per_word[:, 3]), np.flatnonzero(hit | start)
    near = np.zeros(n)
    if len(second) and len(at):
        place = np.searchsorted(second, at)
        close = np.zeros(len(at), bool)
        for other in (second[np.minimum(place, len(second) - 1)], second[np.maximum(place - 1, 0)]):
            close |= (np.abs(other - at) <= 5) & (text[other] == text[at])
        near = np.bincount(text[at[close]], minlength=n).astype(float)
    each, letters = np.maximum(count, 1), np.maximum(total[:, 4], 1)
    size = np.maximum(total[:, 4] + total[:, 7] + total[:, 8], 1)
    return np.stack(
        [
            np.log1p(count), hits / each, np.log1p(hits), total[:, 0] / each, top, starts / each, np.log1p(starts), total[:, 1] / each,
            total[:, 2], total[:, 3] / each, near / each, total[:, 5] / letters, total[:, 6] / each, total[:, 7] / size, total[:, 8] / size, total[:, 9] / each, total[:, 10] / each,
        ],
        axis=1,
    )


def _featured(known, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = features(batch.column("text"), known.value)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), lists], [*others, "features"])

    return run


def featured(rows: DataFrame, known, others: list[str]) -> DataFrame:
    """The columns ``others`` and an array ``features`` of every row."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select("text", *others).mapInArrow(_featured(known, others), f"{kinds}, features array<double>")


class Classifier:
    """Lexicon, trees and calibration, fitted on a sample."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.known = spark.sparkContext.broadcast(lexicon(rows))
        table = written(featured(rows, self.known, ["toxic", "fold"]), "features")
        table = table.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "fold").coalesce(4)
        n, toxic = table.agg(F.count("*"), F.sum("label")).first()
        self.share = (toxic or 0.0) / n if n else 0.0
        self.trees = None
        seen = table.where("fold > 0")
        if 0 < self.share < 1 and seen.select("label").distinct().count() == 2:
            self.trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.2, minInstancesPerNode=3, seed=7, cacheNodeIds=False).fit(seen)
            unseen = self.margins(table.where("fold = 0"))
            if unseen.select("label").distinct().count() < 2:
                unseen = self.margins(table)
            self.calibration = IsotonicRegression(featuresCol="margin", predictionCol="calibrated").fit(unseen.select("margin", "label"))

    def margins(self, table: DataFrame) -> DataFrame:
        return self.trees.transform(table).withColumn("margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every row of ``docs``."""
        if self.trees is None:
            return docs.select("doc_id", F.lit(float(self.share)).alias("score"))
        rows = featured(docs, self.known, ["doc_id"]).select("doc_id", array_to_vector("features").alias("features"))
        calibrated = self.calibration.transform(self.margins(rows))
        plain = 1 / (1 + F.exp(-2 * F.col("margin")))
        return calibrated.select("doc_id", (0.98 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")) + 0.02 * plain).alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = Classifier(sample(docs, labels)).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
