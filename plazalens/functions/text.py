"""Text columns shared by batch and streaming jobs. Every helper is Column -> Column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes, Unicode case folding and "\n" as the only line end.
FLAGS = "(?iUd)"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def with_lower(col: Column, made: Callable[[Column], Column]) -> Column:
    """What ``made`` makes of the lower-cased text, which is made once a row, not once a phrase."""
    return F.transform(F.array(F.lower(col)), made)[0]


def contains_any(col: Column, phrases: Iterable[str]) -> Column:
    """True when the lower-cased text holds one of the phrases as a substring."""
    low = F.lower(col)
    return F.coalesce(any_of(low.contains(p) for p in phrases), F.lit(False))


def count_contained(col: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur in the lower-cased text."""
    low = F.coalesce(F.lower(col), F.lit(""))
    return reduce(lambda a, b: a + b, (low.contains(p).cast("int") for p in phrases))


def found_in_order(col: Column, phrases: Iterable[str]) -> Column:
    """The contained phrases, in list order."""
    return with_lower(col, lambda low: F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases])))


def first_contained(col: Column, phrases: Iterable[str]) -> Column:
    """First phrase of the list that the lower-cased text holds, else null."""
    low = F.lower(col)
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in phrases])


def unicode_words(col: Column, min_length: int) -> Column:
    """Runs of word characters of at least ``min_length``, in text order, lower-cased."""
    return F.regexp_extract_all(F.lower(col), F.lit(rf"(?U)\w{{{min_length},}}"), F.lit(0))


def blank_links_and_marks(col: Column) -> Column:
    """Links and everything that is neither word character nor space become blanks."""
    return F.regexp_replace(F.regexp_replace(col, r"https?://\S+", " "), r"(?U)[^\w\s]", " ")


def strip(col: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


FOLDED = str.maketrans("ſı", "si")
DOTTED = "i\u0307"  # what the capital I with a dot is in lower case; to a rule it is an i


def folded(col: Column) -> Column:
    """Lower case, with the two letters that fold to ASCII replaced by it."""
    return F.translate(F.lower(col), "ſı", "si")


def folded_text(text: str) -> str:
    """``folded`` for one text inside a task; a capital I with a dot is an i."""
    return text.replace("İ", "i").lower().translate(FOLDED)


def squeeze(col: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def extract_or_null(col: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that yields null instead of '' when nothing matches."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def csv_list(col: Column) -> Column:
    """Comma list -> array of trimmed non-empty items; null -> empty array."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def round_exact(col: Column, digits: int) -> Column:
    """Round the binary value itself (half to even), not its shortest decimal form."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit("")).cast("double")
