"""Ordered scans over groups of any size.

A plain window puts a whole group into one task. These helpers cut each group into
chunks of its ordering column, scan inside the chunks in parallel and add the carry
of the earlier chunks, which is one row per (group, chunk). A group that holds a
third of all rows is thereby spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carry: Column, inner: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0))
    return F.greatest(carry, inner) if kind == "max" else F.least(carry, inner)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    chunk: Column,
    columns: dict[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates ``name -> (sum | max | min, expression)``.

    ``chunk`` must not decrease along ``order``. With ``exclusive`` the current row
    is left out. Keys must not be null.
    """
    end = -1 if exclusive else W.currentRow
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    chunked = df.withColumn("_chunk", chunk)
    rows, totals = chunked, []
    for i, (name, (kind, expr)) in enumerate(columns.items()):
        rows = rows.withColumn(f"_in{i}", _AGG[kind](expr).over(inside))
        totals.append(_AGG[kind](expr).alias(f"_sum{i}"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    per_chunk = chunked.groupBy(*keys, "_chunk").agg(*totals)
    carry = per_chunk.select(
        *keys,
        "_chunk",
        *[_AGG[kind](F.col(f"_sum{i}")).over(before).alias(f"_carry{i}") for i, (kind, _) in enumerate(columns.values())],
    )
    joined = rows.join(carry, [*keys, "_chunk"], "left")
    for i, (name, (kind, _)) in enumerate(columns.items()):
        joined = joined.withColumn(name, _combine(kind, F.col(f"_carry{i}"), F.col(f"_in{i}")))
    return joined.select(*df.columns, *columns)


def positions(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, name: str = "pos") -> DataFrame:
    """1-based position of each row inside its group."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1))})


def by_width(col: Column, width: int | float) -> Column:
    """Chunk number of a numeric ordering column."""
    return F.floor(col / F.lit(width)).cast("long")


def by_time(col: Column, seconds: int = 86_400) -> Column:
    """Chunk number of a timestamp ordering column."""
    return F.floor(F.unix_micros(col) / F.lit(seconds * 1_000_000)).cast("long")
