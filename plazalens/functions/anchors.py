"""Necessary word beginnings of a rule, so that a cheap test can skip its regex.

Most posts hold none of the words a rule needs. For every rule this module derives a
set of four-letter word beginnings (and a few short literals) of which every match
must contain one. A post is split into its word beginnings once; a rule group whose
anchors do not meet them is not evaluated. The test never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from re import _parser as regex_parser

HEAD = 4
MAX_CLASS = 8

Prefix = tuple[str, bool]  # text so far, may the next item continue it?


@dataclass(frozen=True)
class Anchors:
    heads: frozenset[str]  # a word starts with one of these ...
    parts: frozenset[str]  # ... or the text holds one of these

    @property
    def always(self) -> bool:
        return not self.heads and not self.parts


def _is_space(item) -> bool:
    op, arg = item
    if str(op) not in ("MAX_REPEAT", "MIN_REPEAT") or arg[0] < 1:
        return False
    inner = list(arg[2])
    return len(inner) == 1 and str(inner[0][0]) == "IN" and [str(x[1]) for x in inner[0][1]] == ["CATEGORY_SPACE"]


def _last_word(text: str) -> str:
    return text.rsplit(" ", 1)[-1]


def _alternatives(item) -> set[Prefix]:
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {(chr(arg).lower(), True)}
    if op == "SUBPATTERN":
        return _prefixes(list(arg[3]))
    if op == "BRANCH":
        return set().union(*[_prefixes(list(b)) for b in arg[1]])
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        if _is_space(item):
            return {(" ", True)}
        low, high, inner = arg
        body = _prefixes(list(inner))
        if (low, int(high)) != (1, 1):
            body = {(t, c and int(high) == 1) for t, c in body}
        return body | {("", True)} if low == 0 else body
    if op == "IN" and all(str(x[0]) == "LITERAL" for x in arg) and len(arg) <= MAX_CLASS:
        return {(chr(x[1]).lower(), True) for x in arg}
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {("", True)}
    return {("", False)}


def _prefixes(items: list) -> set[Prefix]:
    """Beginnings of what the items match; short words are followed by the next word."""
    if not items:
        return {("", True)}
    out: set[Prefix] = set()
    for text, open_end in _alternatives(items[0]):
        if not open_end or len(_last_word(text)) >= HEAD:
            out.add((text, False))
            continue
        for more, end in _prefixes(items[1:]):
            joined = text + more
            cut = len(_last_word(joined)) >= HEAD
            out.add((joined, end and not cut))
    return out


def _anchor_word(text: str) -> str:
    """First word of full head length, else the longest one."""
    words = [w[:HEAD] for w in text.split(" ")]
    full = [w for w in words if len(w) == HEAD and w.replace("_", "a").isalnum()]
    return full[0] if full else max(words, key=len)


def _leads_to_word_start(item) -> bool:
    op, arg = str(item[0]), item[1]
    if op == "AT":
        return "BOUNDARY" in str(arg) or "BEGINNING" in str(arg)
    if _is_space(item):
        return True
    if op == "SUBPATTERN":
        inner = list(arg[3])
        return bool(inner) and _leads_to_word_start(inner[-1])
    if op == "BRANCH":
        return all(bool(list(b)) and _leads_to_word_start(list(b)[-1]) for b in arg[1])
    return False


@lru_cache(maxsize=4096)
def anchors_of(rule: str) -> Anchors:
    """Anchors of one rule; ``always`` when none can be derived."""
    items = list(regex_parser.parse(rule))
    best: Anchors | None = None
    for i in range(1, len(items)):
        if not _leads_to_word_start(items[i - 1]):
            continue
        texts = {_anchor_word(t) for t, _ in _prefixes(items[i:])}
        heads = frozenset(t for t in texts if len(t) == HEAD and t.replace("_", "a").isalnum())
        parts = frozenset(texts - heads)
        if "" in parts:
            continue
        found = Anchors(heads, parts)
        if best is None or (len(parts), len(heads)) < (len(best.parts), len(best.heads)):
            best = found
    return best or Anchors(frozenset(), frozenset())


def merged(rules: list[str]) -> Anchors:
    every = [anchors_of(r) for r in rules]
    if any(a.always for a in every):
        return Anchors(frozenset(), frozenset())
    return Anchors(frozenset().union(*[a.heads for a in every]), frozenset().union(*[a.parts for a in every]))
