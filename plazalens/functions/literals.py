"""Many literals in one pass: an automaton over all of them, run over the texts of an Arrow batch.

The automaton is built once per Python worker and list of literals. Rules are regular expressions and stay
with the JVM; the automaton tells which groups of them can match at all, and finds plain names by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalens.functions.text import DOTTED, FOLDED

_WORD = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}
_JOINERS = "‌‍"


@lru_cache(maxsize=1 << 16)
def is_word(char: str) -> bool:
    """A word character as the JVM's Unicode classes have it."""
    return char.isascii() and (char.isalnum() or char == "_") or unicodedata.category(char) in _WORD or char in _JOINERS or "Ⓐ" <= char <= "ⓩ"


def is_python_word(char: str) -> bool:
    """A word character as Python's regular expressions have it: a combining mark is none."""
    return char.isalnum() or char == "_"


def bounded(text: str, start: int, stop: int) -> bool:
    """Whether a word boundary lies on both sides of text[start:stop]."""
    left = start > 0 and is_word(text[start - 1])
    right = stop < len(text) and is_word(text[stop])
    return left != is_word(text[start]) and right != is_word(text[stop - 1])


Group = tuple[frozenset[str], frozenset[str]]  # beginnings of words, literals anywhere


@lru_cache(maxsize=16)
def automaton(groups: tuple[Group, ...], names: tuple[str, ...]) -> ahocorasick.Automaton:
    """Every literal with its length, the groups that it stands for at the begin of a word and anywhere, and its places
    in the list of names."""
    found: dict[str, tuple[int, list[int], list[int], list[int]]] = {}
    for k, pair in enumerate(groups):
        for place, literals in enumerate(pair, 1):
            for literal in literals:
                found.setdefault(literal, (len(literal), [], [], []))[place].append(k)
    for k, name in enumerate(names):
        found.setdefault(name, (len(name), [], [], []))[3].append(k)
    out = ahocorasick.Automaton()
    for literal, value in found.items():
        out.add_word(literal, value)
    out.make_automaton()
    return out


SEEN = T.StructType([T.StructField("groups", T.ArrayType(T.IntegerType())), T.StructField("names", T.ArrayType(T.IntegerType()))])


def fired(text: str, machine: ahocorasick.Automaton, word: Callable[[str], bool] = is_word) -> tuple[set[int], set[int]]:
    """Groups with a literal in the text, and names that stand in it on word boundaries. ``word`` tells word
    characters as the engine of the groups' rules has them."""
    groups: set[int] = set()
    names: set[int] = set()
    for last, (size, begins, anywhere, named) in machine.iter(text):
        if anywhere:
            groups.update(anywhere)
        if begins and not groups.issuperset(begins) and (last < size or not word(text[last - size])):
            groups.update(begins)
        if named and not names.issuperset(named) and bounded(text, last + 1 - size, last + 1):
            names.update(named)
    return groups, names


def seen(low: Column, groups: list[Group], names: list[str]) -> Column:
    """For lower-cased text: which groups have a literal in it, folded or not, and which names stand in it on word
    boundaries, both as rising numbers; null where neither is, or where the text is null."""
    key = tuple(groups), tuple(names)

    @F.pandas_udf(SEEN)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if not any(heads or parts for heads, parts in key[0]) and not key[1]:
            return pd.DataFrame({"groups": [None] * len(texts), "names": [None] * len(texts)})
        machine = automaton(*key)
        out = []
        for text in texts:
            if text is None:
                out.append((None, None))
                continue
            of, named = fired(text, machine)
            if "ſ" in text or "ı" in text or DOTTED in text:  # the letters that fold to ASCII
                of |= fired(text.replace(DOTTED, "i").translate(FOLDED), machine)[0]
            out.append((sorted(of) or None, sorted(named) or None))
        return pd.DataFrame(out, columns=["groups", "names"])

    return scan(low)
