"""Row-set helpers: last or first row per key, merges, ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(df: DataFrame, keys: list, order: list[Column], n: int | None, name: str | None = None) -> DataFrame:
    """First ``n`` rows per key, all of them for None. Spark trims each map task to ``n`` rows before the
    shuffle (window group limit), so a hot key does not grow its task."""
    column = name or "_rank"
    out = df.withColumn(column, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out if n is None else out.filter(F.col(column) <= n)
    return out if name else out.drop(column)


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, keys, order, 1)


def replace_by_key(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-row upsert: incoming rows win. Incoming must be unique per key."""
    kept = current.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True).select(*current.columns)
