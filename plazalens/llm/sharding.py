"""Sharding by fixed virtual slots (native: DataFrame functions only).

Records are hashed into thousands of virtual slots, bytes are summed per slot, and a small
versioned map says which shard owns a slot. Rebalancing edits the map, never the hash, so a
record moves only when its slot does.

The law is ``bytes``: shards get nearly equal numbers of bytes. Equal texts share a slot and so a
shard. A slot larger than a mean shard is divided into parts by the hash of the text, so groups of equal texts stay
whole; only a text that outweighs a mean shard alone is divided by the hash of doc_id, as no map could balance it
otherwise.

Defined results: a null text counts as empty (size 1, crc32 0); rows without doc_id, repeated rows
and ties are rows like any other, each gets a place of its own; an empty table gives no rows;
other columns are left aside.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plazalens.llm.common import written
from plazalens.session import work_folder

SHARDS = 16
SLOTS = 4096
#: A slot above one mean shard is divided into so many parts per mean shard.
PARTS = 8
#: Each part of a slot is numbered in so many pieces, which bounds what one task sorts.
PIECES = 64


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and a number that spreads rows inside a slot."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.xxhash64(text, F.lit(5)).alias("text_key"),
        F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)).cast("int").alias("spread"),
    )


def slot_parts(rows: DataFrame, shards: int) -> DataFrame:
    """Number of parts of every virtual slot in use: 1, or more for one above a mean shard."""
    sizes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards  # over at most SLOTS rows
    return sizes.withColumn("mean", mean).select(
        "virtual_slot",
        "mean",
        F.when(F.col("bytes") <= F.col("mean"), 1).otherwise(F.ceil(F.col("bytes") * PARTS / F.col("mean"))).cast("int").alias("parts"),
    )


def with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Every row's part of its slot. The slot table has at most SLOTS rows, and fewer texts than there are shards
    outweigh a mean shard, so both are broadcast."""
    placed = rows.join(F.broadcast(parts), "virtual_slot")
    divided = placed.where("parts > 1").groupBy("virtual_slot", "text_key", "mean").agg(F.sum("size").alias("bytes"))
    heavy = divided.where(F.col("bytes") > F.col("mean")).select("virtual_slot", "text_key", F.lit(True).alias("heavy"))
    placed = placed.join(F.broadcast(heavy), ["virtual_slot", "text_key"], "left")
    by = F.when(F.coalesce("heavy", F.lit(False)), F.col("spread")).otherwise(F.pmod(F.col("text_key"), F.lit(1 << 20)).cast("int"))
    return placed.withColumn("part", by % F.col("parts")).drop("mean", "heavy", "text_key")


def assign(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Slot-to-shard map: slots in order of falling bytes, each to the least loaded shard.

    ``loads`` has a row per slot and part, at most SLOTS + PARTS * shards of them, so they are
    folded in one row.
    """
    ordered = loads.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "part")), asc=False).alias("slots"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("chosen"),
    )

    def place(state, slot):
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i + 1 == least, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["chosen"], F.array(least - 1)).alias("chosen"),
        )

    chosen = F.aggregate("slots", start, place, lambda s: s["chosen"])
    pairs = ordered.select(F.explode(F.arrays_zip(F.col("slots"), chosen.alias("shard"))).alias("x"))
    return pairs.select("x.slots.virtual_slot", "x.slots.part", "x.slots.bytes", F.col("x.shard").alias("shard"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version for one more shard: every old shard gives slots to the new one until
    about a part of 1/(shards + 1) of its bytes has gone; no other slot moves."""
    w = Window.partitionBy("shard").orderBy("bytes", "virtual_slot", "part")
    total = Window.partitionBy("shard")
    gone = F.sum("bytes").over(w) * (shards + 1) <= F.sum("bytes").over(total)
    return slot_map.withColumn("shard", F.when(gone, F.lit(shards)).otherwise(F.col("shard")))


def store(slot_map: DataFrame, folder: str, version: int) -> None:
    """Write a version of the map beside the earlier ones, which stay."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None, version: int = 1) -> DataFrame:
    """Every record with its shard and its place in the shard, from 0 without gaps.

    Places come from counts per piece of a slot, so no task numbers a whole shard or slot. The
    map is stored under ``folder`` (the shared folder unless given) and read from there.
    """
    spark = docs.sparkSession
    rows = written(records(docs, slots), "records")
    parts = slot_parts(rows, shards)
    rows = with_part(rows, parts).drop("parts").withColumn("piece", F.pmod(F.hash("spread"), F.lit(PIECES)))
    cells = rows.groupBy("virtual_slot", "part", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    cells = written(cells, "cells")
    slot_map = assign(cells.groupBy("virtual_slot", "part").agg(F.sum("bytes").alias("bytes")), shards)
    folder = folder or f"{work_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    store(slot_map, folder, version)
    slot_map = load(spark, folder, version).drop("bytes")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.join(F.broadcast(slot_map), ["virtual_slot", "part"]).select(
        "virtual_slot", "part", "piece", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    place = Window.partitionBy("virtual_slot", "part", "piece").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(place)).join(first, ["virtual_slot", "part", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
