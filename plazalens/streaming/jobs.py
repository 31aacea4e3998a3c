"""Structured Streaming jobs: upsert, labelling, request limits and volumes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plazalens.functions.limiter import replay
from plazalens.operators.claims import contextual_claims, score_claims
from plazalens.operators.labels import label
from plazalens.operators.maintain import clean_batch, replaced_columns, upsert_posts
from plazalens.session import durable

BUCKETS = 256
#: The batch number of the rows a table starts with.
FIRST = -1


def bucketed(df: DataFrame, buckets: int = BUCKETS, key: str = "post_id") -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


#: Rows of a bucket that one task writes, about.
FILE_ROWS = 1 << 13
#: What a step has shuffled goes when it ends, not when the driver happens to collect its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A table's bitmaps of last rows, 4 kB for up to 32,768 rows each, are broadcast up to so many; more are dealt with the rows.
BITMAPS = 1 << 13
COLUMNS = ("batch", "bucket", "_row")


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for what is begun inside; the session has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _append(rows: DataFrame, path: str, number: int, buckets: int, n: int) -> None:
    """Write a batch's ``n`` rows, numbered, as its own folder; a batch that runs again replaces what it wrote. A large
    bucket is the work of many tasks."""
    share = F.pmod(F.xxhash64("post_id", F.lit(0)), F.lit(1 + n // (buckets * FILE_ROWS)))
    dealt = bucketed(rows, buckets).repartition("bucket", share).withColumn("_row", F.monotonically_increasing_id())
    with _set(rows.sparkSession, CLEANED):
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/batch={number}")


def create_table(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a keyed table as the first batch of ``path``, in hash buckets. Of a table of many batches
    (``read_table``) it makes one of a single batch, at another path."""
    _append(df, path, FIRST, buckets, df.count())


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    kinds = T.StructType([T.StructField("_row", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(T.StructType([*schema.fields, *kinds.fields])).parquet(path)


def _last_rows(rows: DataFrame) -> DataFrame:
    """The last row of every key, of all batches. Keys and row numbers are shuffled, no row: a bitmap for each task that
    wrote tells which of its rows are last, and the rows are filtered where they are read."""
    number = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    writer = [F.col("batch"), F.shiftright("_row", 33).alias("_task"), F.bitmap_bucket_number(number).alias("_bitmap")]
    last = rows.groupBy("bucket", "post_id").agg(F.max(F.struct("batch", "_row")).alias("_last")).select("_last.*")
    last = last.select("_row", *writer).repartition("batch", "_task")
    bits = durable(last.groupBy("batch", "_task", "_bitmap").agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits")))
    bits = F.broadcast(bits) if bits.count() <= BITMAPS else bits.hint("shuffle_hash")
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = rows.select("*", *writer[1:]).join(bits, ["batch", "_task", "_bitmap"])
    return found.filter(F.getbit(byte, (place % 8).cast("int")) == 1)


def read_table(spark: SparkSession, path: str, columns: list[str], schema: T.StructType | None = None) -> DataFrame:
    if schema is None:
        schema = T.StructType([f for f in spark.read.parquet(path).schema.fields if f.name not in COLUMNS])
    return _last_rows(_stored(spark, path, schema)).select(*columns)


def _touched(spark: SparkSession, path: str, schema: T.StructType, number: int, buckets: list[int], incoming: DataFrame) -> DataFrame:
    """The last rows, of the batches before one, of the keys that come in. What the upsert takes from the incoming row
    whatever the stored one has is not read, but null."""
    names = [n for n in schema.names if n != "post_id" and n not in replaced_columns(incoming.columns)]
    rows = _stored(spark, path, schema).filter((F.col("batch") < number) & F.col("bucket").isin(buckets))
    rows = rows.select("bucket", "post_id", "batch", "_row", F.struct(F.lit(0).alias("_none"), *names).alias("_kept")).join(incoming.select("post_id"), "post_id", "left_semi")
    last = rows.groupBy("bucket", "post_id").agg(F.max_by("_kept", F.struct("batch", "_row")).alias("_kept"))
    return last.select(*[
        F.col(f.name if f.name == "post_id" else f"_kept.{f.name}") if f.name == "post_id" or f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def upsert_batch(batch: DataFrame, path: str, order: list, schema: T.StructType, number: int, buckets: int = BUCKETS) -> None:
    """Append what one micro-batch makes of the rows it touches; applying it again changes nothing.

    Rows of earlier batches stay as they are and a key's last row counts, so a batch writes as many rows as it
    has keys. It reads the buckets that its keys fall in (at most ``buckets`` numbers reach the driver), and of
    those the batches before it, so that one that runs again starts from the same state.
    """
    spark = batch.sparkSession
    incoming = clean_batch(batch, order).persist()
    touched = dict(bucketed(incoming.select("post_id"), buckets).groupBy("bucket").count().collect())
    if touched:
        current = _touched(spark, path, schema, number, list(touched), incoming)
        _append(upsert_posts(current, incoming), path, number, buckets, sum(touched.values()))
    incoming.unpersist()


def stream_upsert(
    stream: DataFrame, path: str, checkpoint: str, schema: T.StructType, order_column: str, buckets: int = BUCKETS,
    event_time: str | None = None, delay: str = "1 hour", trigger: dict | None = None,
):
    """Start the micro-batch upsert of a post stream into the bucketed table at ``path``.

    With ``event_time``, exact repeats inside the watermark are dropped before the
    upsert; a repeat that comes later is upserted again, to the same result.
    """
    if event_time:
        marked = stream.withWatermark(event_time, delay)
        stream = marked.withColumn("_row", F.xxhash64(*[c for c in stream.columns if c != event_time])).dropDuplicatesWithinWatermark(
            ["post_id", "_row"]
        ).drop("_row")

    def apply(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, path, [F.col(order_column)], schema, number, buckets)

    with _set(stream.sparkSession, CLEANED):  # the stream keeps what it is started with
        return (
            stream.writeStream.foreachBatch(apply)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def label_stream(stream: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """The batch labelling on a post stream; stateless, append output."""
    return label(stream, rules)


def claim_stream(stream: DataFrame, as_of) -> DataFrame:
    """Contextual claims with scores on a post stream; stateless, append output."""
    return score_claims(contextual_claims(stream), as_of)


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, settings: dict[str, str] | None = None):
    """Append a stream to a Parquet folder; without ``trigger`` what is there now, then stop.

    A stream keeps the ``settings`` it is started with; the session has its own again afterwards.
    """
    with _set(stream.sparkSession, settings or {}):
        return (
            stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )


def volume_stream(log: DataFrame, window: str = "1 minute", slide: str = "10 seconds", delay: str = "10 minutes") -> DataFrame:
    """Requests per (client, endpoint) and sliding window; late rows beyond the watermark are dropped."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide), "key", "endpoint")
        .agg(F.count("*").alias("n"))
        .select("key", "endpoint", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")
    )


BREACH_SCHEMA = "event_id bigint, key string, endpoint string, ts timestamp"
#: What ``breach_stream`` needs when it is started.
ROCKS_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Breaches(StatefulProcessor):
    """Requests of one (client, endpoint) wait in a list until the watermark has passed their span of time.

    A timer for each ``span`` (seconds) that has rows decides what has come of it, so the calls to the state follow
    the spans and batches of a client, not its requests. What waits is written anew once a span; passed times
    are at most ``limit``.
    """

    def __init__(self, limits: dict[str, tuple[int, int]], span: int):
        self.limits, self.span = limits, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType())]))
        self.passed = handle.getValueState("passed", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple[int, int]] = []
        for batch in rows:
            # datetime64 of any unit -> microseconds
            times = batch["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            new.extend(zip(times, batch["event_id"].tolist(), strict=True))
        self.waiting.appendList(new)
        for span in {us // (self.span * 1_000_000) for us, _ in new}:
            self.handle.registerTimer((span + 1) * self.span * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit, window = self.limits[key[1]]
        # No request before the watermark can come any more, so one timer does the work of all that are due.
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        ready, later = [], []
        for us, event in self.waiting.get():
            (ready if us < end else later).append((us, event))
        if ready:
            ready.sort()
            passed = deque(self._passed())
            ok = replay([us for us, _ in ready], limit, window * 1_000_000, passed)
            self.passed.update((list(passed),))
            self.waiting.put(later) if later else self.waiting.clear()
            # Once the last passed time has left the window, the state says nothing.
            self.handle.registerTimer((ready[-1][0] // 1_000_000 + window + 2) * 1000)
            refused = [r for r, good in zip(ready, ok, strict=True) if not good]
            if refused:
                yield pd.DataFrame(
                    {
                        "event_id": [event for _, event in refused], "key": key[0], "endpoint": key[1],
                        "ts": pd.to_datetime([us for us, _ in refused], unit="us"),
                    }
                )
        elif not later and (before := self._passed()) and max(before) + window * 1_000_000 <= end:
            self.passed.clear()

    def _passed(self) -> list[int]:
        stored = self.passed.get()
        return stored[0] if stored else []

    def close(self) -> None:
        pass


def _seconds(spark: SparkSession, delay: str) -> int:
    """The length of an interval such as '10 minutes'."""
    return spark.range(1).select((F.lit("1970-01-01").cast("timestamp") + F.expr(f"INTERVAL {delay}")).cast("long")).first()[0]


def breach_stream(log: DataFrame, limits: dict[str, tuple[int, int]], delay: str = "10 minutes") -> DataFrame:
    """Refused requests of a stream, in whatever order requests arrive within ``delay``.

    A request is decided once the watermark has passed its span, half of ``delay``, as no earlier one can come then;
    until that it waits in the state of its (client, endpoint). Start it with ``ROCKS_STORE`` (see ``append_to``).
    """
    span = max(1, _seconds(log.sparkSession, delay) // 2)
    return (
        log.withWatermark("ts", delay)
        .filter(F.col("endpoint").isin(list(limits)))
        .select("event_id", "key", "endpoint", "ts")
        .groupBy("key", "endpoint")
        .transformWithStateInPandas(_Breaches(limits, span), BREACH_SCHEMA, "append", "EventTime")
    )


def end_mark(log: DataFrame, delay_days: int) -> DataFrame:
    """One request far behind the last: reading it closes a finite stream, as it moves the
    watermark over all others. It is never decided itself."""
    last = log.agg((F.max("ts") + F.make_dt_interval(F.lit(2 * delay_days + 1))).alias("ts"))
    kinds = {f.name: f.dataType for f in log.schema.fields}
    first = log.select("endpoint").limit(1)
    return first.crossJoin(last).select(  # one row each
        *[F.col(c) if c in ("endpoint", "ts") else F.lit(-1 if c == "event_id" else None).cast(kinds[c]).alias(c) for c in log.columns]
    )
