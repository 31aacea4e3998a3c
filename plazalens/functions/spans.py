"""The one span matcher: every match of a rule list with its span and context.

Spark has no built-in that returns match positions, so this is an Arrow-batched
pass over (keys, text): Spark partitions the posts, one automaton over all rules' literals tells which
rules a text can match, rules that begin with a digit are tried at its runs of digits only, and nothing is kept
between batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as regex_parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalens.functions.anchors import anchors_of
from plazalens.functions.literals import automaton, fired, is_python_word
from plazalens.functions.text import folded_text


@dataclass(frozen=True)
class SpanRule:
    kind: str
    rule: int
    pattern: str
    before: int
    after: int
    after_start: bool = False  # context ends `after` characters behind the start, not the end


SPAN_FIELDS = [
    T.StructField("kind", T.StringType()),
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("matched", T.StringType()),
    T.StructField("start_pos", T.IntegerType()),
    T.StructField("end_pos", T.IntegerType()),
    T.StructField("context", T.StringType()),
]


#: Where a match of a rule that begins with a boundary and a digit can begin.
DIGIT_RUN = re.compile(r"\b\d")
ANY_DIGIT = re.compile(r"\d")


def _digit(item) -> bool:
    """Whether a parsed item begins with a digit, whatever it matches."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return chr(arg).isdigit()
    if op == "IN":
        return [str(x[1]) for x in arg] == ["CATEGORY_DIGIT"]
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        return arg[0] >= 1 and _digit(arg[2][0])
    if op == "SUBPATTERN":
        return len(arg[3]) > 0 and _digit(arg[3][0])
    return op == "BRANCH" and all(len(b) > 0 and _digit(b[0]) for b in arg[1])


def _starts_with_digit(pattern: str) -> bool:
    """Whether the rule is a boundary and then a digit, so that it can match at the begin of a run of digits only."""
    items = list(regex_parser.parse(pattern))
    return len(items) > 1 and str(items[0][0]) == "AT" and str(items[0][1]) == "AT_BOUNDARY" and _digit(items[1])


def _needs_digit(pattern: str) -> bool:
    return any(_digit(item) for item in regex_parser.parse(pattern))


def _from(begins: list[int], pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """``finditer`` of a rule that can match at ``begins`` only."""
    end = 0
    for at in begins:
        if at >= end and (hit := pattern.match(text, at)):
            yield hit
            end = max(hit.end(), at + 1)


def find_spans(df: DataFrame, keys: list[str], text: str, rules: list[SpanRule], on_lower: bool = False, strip: bool = True) -> DataFrame:
    """Rows (keys, kind, rule_no, matched, start_pos, end_pos, context), one per match.

    With ``on_lower`` the lower-cased text is matched and the context is cut from the
    original; ``matched`` is then lower-cased.
    """
    chosen = df.select(*keys, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    schema = T.StructType([*[chosen.schema[k] for k in keys], *SPAN_FIELDS])

    needs = tuple((a.heads, a.parts) for a in (anchors_of(r.pattern) for r in rules))
    numeric = [_starts_with_digit(r.pattern) for r in rules]
    digits = [_needs_digit(r.pattern) for r in rules]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(r.pattern, re.IGNORECASE) for r in rules]
        always = [k for k, need in enumerate(needs) if not any(need)]
        machine = automaton(needs, ()) if len(always) < len(needs) else None
        for batch in batches:
            rows = []
            for values in batch.itertuples(index=False, name=None):
                original = values[-1]
                tried = set(always)
                if machine is not None:
                    tried |= fired(folded_text(original), machine, is_python_word)[0]
                if not tried:
                    continue
                searched = original.lower() if on_lower else original
                begins = [m.start() for m in DIGIT_RUN.finditer(searched)]
                for k in sorted(tried):
                    if digits[k] and not begins and not ANY_DIGIT.search(searched):
                        continue
                    r = rules[k]
                    for hit in _from(begins, compiled[k], searched) if numeric[k] else compiled[k].finditer(searched):
                        start, end = hit.span()
                        stop = start + r.after if r.after_start else end + r.after
                        context = original[max(0, start - r.before):stop]
                        rows.append((*values[:-1], r.kind, r.rule, hit.group(), start, end, context.strip() if strip else context))
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return chosen.mapInPandas(match, schema)
