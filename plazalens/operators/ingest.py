"""Incremental ingest, date windows and request limits (batch side)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plazalens.functions.limiter import admit
from plazalens.functions.scan import by_width, positions, running
from plazalens.functions.tables import replace_by_key
from plazalens.operators.labels import Scorer, score_models
from plazalens.operators.maintain import failed_rows, upsert_analyses
from plazalens.session import durable

RANGE_KEYS = ["username", "start_date", "end_date"]

# Collection settings and request limits (requests per window of seconds).
SPLIT_THRESHOLD = 750
EMPTY_TO_STOP = 3
KNOWN_TO_STOP = 10
RATE_LIMITS = {
    "admin_login": (5, 300), "admin_actions": (5, 300), "main_dashboard": (30, 60), "user_pages": (20, 60),
    "api_endpoints": (10, 60), "api_versions": (20, 60), "api_usernames": (30, 60), "export_endpoints": (3, 600),
}


def only_new(incoming: DataFrame, bounds: DataFrame, mode: str = "older") -> DataFrame:
    """Posts outside what is stored: ``older`` than the oldest, or ``newer`` than the newest.

    ``bounds``: username, oldest_ts, newest_ts; users without bounds keep everything.
    """
    joined = incoming.join(bounds.select("username", "oldest_ts", "newest_ts"), "username", "left")
    test = F.col("post_ts") < F.col("oldest_ts") if mode == "older" else F.col("post_ts") > F.col("newest_ts")
    return joined.filter(F.coalesce(test, F.lit(True))).select(*incoming.columns)


def until_known_run(
    incoming: DataFrame, posts: DataFrame, n: int = KNOWN_TO_STOP, chunk_width: int = 100_000
) -> DataFrame:
    """New posts in arrival order (column ``arrival``) before the n-th known post in a row."""
    stored = posts.select("post_id", "username").distinct().withColumn("_known", F.lit(True))
    flagged = incoming.join(stored, ["post_id", "username"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    order, chunk = [F.col("arrival"), F.col("post_id")], by_width(F.col("arrival"), chunk_width)
    placed = positions(flagged, ["username"], order, chunk, "_pos")
    runs = running(placed, ["username"], order, chunk, {"_new": ("max", F.when(~F.col("_known"), F.col("_pos")))})
    length = F.col("_pos") - F.coalesce("_new", F.lit(0))
    stops = runs.filter(F.col("_known") & (length == n)).groupBy("username").agg(F.min("_pos").alias("_stop"))
    kept = runs.filter(~F.col("_known")).join(stops, "username", "left")
    return kept.filter(F.col("_stop").isNull() | (F.col("_pos") < F.col("_stop"))).select(*incoming.columns)


def windows_back(ends: DataFrame, k: int, months: int = 6) -> DataFrame:
    """``k`` windows of months x 30 days going back from each user's ``end_date``."""
    days = months * 30
    number = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return ends.select("username", "end_date", number.alias("window_no")).select(
        "username",
        "window_no",
        F.date_sub("end_date", (F.col("window_no") + 1) * days).alias("start_date"),
        F.date_sub("end_date", F.col("window_no") * days).alias("end_date"),
    )


def _halved(threshold: int, depth: int | None):
    """Split each window by the running counts of its user's days."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for user, start, end, days, before in batch.itertuples(index=False, name=None):
                days, before = list(days), [0, *before]
                open_ = [(start, end, 0)]
                while open_:
                    a, b, level = open_.pop()
                    n = int(before[bisect_left(days, b)] - before[bisect_left(days, a)])
                    if n >= threshold and b - a > 1 and (depth is None or level < depth):
                        middle = a + (b - a) // 2
                        open_ += [(middle, b, level + 1), (a, middle, level + 1)]
                    else:
                        out.append((user, a, b, n, level))
            yield pd.DataFrame(out, columns=["username", "start_day", "end_day", "n_posts", "depth"])

    return run


def adaptive_windows(
    posts: DataFrame, windows: DataFrame, threshold: int = SPLIT_THRESHOLD, depth: int | None = None
) -> DataFrame:
    """Halve windows [start, end) with at least ``threshold`` posts, down to a day, or to ``depth`` halvings.

    Posts are counted by user and day, map side first. A user's running counts, an entry for each day with posts,
    give the count of any window, so a window goes through all its halvings in one pass.
    """
    daily = posts.groupBy("username", F.unix_date(F.to_date("post_ts")).alias("day")).agg(F.count("*").alias("n"))
    daily = daily.filter(F.col("day").isNotNull())
    before = daily.withColumn("before", F.sum("n").over(W.partitionBy("username").orderBy("day")))
    counts = before.groupBy("username").agg(F.sort_array(F.collect_list(F.struct("day", "before"))).alias("_c"))
    none = F.array().cast("array<bigint>")
    rows = windows.select("username", "start_date", "end_date").join(counts, "username", "left").select(
        "username", F.unix_date("start_date").alias("start_day"), F.unix_date("end_date").alias("end_day"),
        F.coalesce(F.transform("_c", lambda x: x["day"].cast("bigint")), none).alias("days"),
        F.coalesce(F.transform("_c", lambda x: x["before"]), none).alias("before"),
    )
    split = rows.mapInPandas(_halved(threshold, depth), "username string, start_day int, end_day int, n_posts bigint, depth int")
    return split.select(
        "username", F.date_from_unix_date("start_day").alias("start_date"), F.date_from_unix_date("end_day").alias("end_date"), "n_posts", "depth"
    )


def history_extent(windows: DataFrame, n: int = EMPTY_TO_STOP) -> DataFrame:
    """Going back window by window, stop after ``n`` empty ones in a row.

    ``windows``: username, window_no (0 is newest), start_date, end_date, n_posts and
    optionally skipped. A user has one row per window, a few hundred at most.
    """
    skipped = F.col("skipped") if "skipped" in windows.columns else F.lit(False)
    empty = ((F.col("n_posts") == 0) & ~skipped).cast("int")
    last = W.partitionBy("username").orderBy("window_no").rowsBetween(-(n - 1), 0)
    marked = windows.withColumn("_stop", F.when(F.sum(empty).over(last) == n, F.col("window_no")))
    stops = marked.groupBy("username").agg(F.min("_stop").alias("_stop"))
    used = windows.join(stops, "username").filter(F.col("_stop").isNull() | (F.col("window_no") <= F.col("_stop")))
    return used.groupBy("username").agg(
        F.count("*").alias("windows_processed"),
        F.sum("n_posts").alias("total_posts"),
        F.min(F.when(F.col("n_posts") > 0, F.col("start_date"))).alias("oldest_reached"),
        F.max("end_date").alias("newest_reached"),
        F.max(F.col("_stop").isNotNull()).alias("reached_start"),
    )


def completed_ranges(progress: DataFrame) -> DataFrame:
    return progress.filter(F.col("status") == "completed").select(*RANGE_KEYS)


def pending_ranges(progress: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ranges that are not complete, with the status they have."""
    open_ = wanted.join(completed_ranges(progress), RANGE_KEYS, "left_anti")
    known = progress.groupBy(*RANGE_KEYS).agg(F.max("status").alias("status"))
    return open_.join(known, RANGE_KEYS, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def is_collected(ranges: DataFrame, progress: DataFrame) -> DataFrame:
    done = completed_ranges(progress).distinct().withColumn("_done", F.lit(True))
    return ranges.join(done, RANGE_KEYS, "left").withColumn("collected", F.coalesce("_done", F.lit(False))).drop("_done")


def mark_ranges(progress: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the status of ranges by (user, start, end)."""
    return replace_by_key(progress, updates, RANGE_KEYS)


def limits_frame(log: DataFrame, limits: dict[str, tuple[int, int]]) -> tuple[Column, Column]:
    """Limit and window columns by endpoint."""
    spec = F.create_map(*[x for k, (n, w) in limits.items() for x in (F.lit(k), F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")))])
    found = F.try_element_at(spec, log["endpoint"])
    return found["n"], found["w"]


def rate_breaches(log: DataFrame, limits: dict[str, tuple[int, int]], chunk_seconds: int = 86_400) -> DataFrame:
    """Requests refused by the sliding limit of their (client, endpoint)."""
    limit, window = limits_frame(log, limits)
    limited = log.filter(F.col("endpoint").isin(list(limits)))
    return admit(limited, ["key", "endpoint"], "ts", ["event_id"], limit, window, chunk_seconds).filter(~F.col("admitted")).drop("admitted")


def request_volume(log: DataFrame, limits: dict[str, tuple[int, int]], chunk_seconds: int = 86_400) -> DataFrame:
    """Requests of the same (client, endpoint) inside the window that ends at each request.

    A chunk of time also sees the rows of the chunk before that still lie in its
    windows, so every (client, endpoint, chunk) is counted on its own.
    """
    limit, window = limits_frame(log, limits)
    rows = (
        log.filter(F.col("endpoint").isin(list(limits)))
        .withColumn("max_requests", limit)
        .withColumn("_w", window.cast("long") * 1_000_000)
        .withColumn("_us", F.unix_micros("ts"))
        .withColumn("_size", F.greatest(F.lit(chunk_seconds * 1_000_000), F.col("_w")))
        .withColumn("_own", F.floor(F.col("_us") / F.col("_size")).cast("long"))
    )
    late = F.col("_us") + F.col("_w") > (F.col("_own") + 1) * F.col("_size")
    seen = rows.withColumn("_chunk", F.explode(F.when(late, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    counts = None
    for size in sorted({w for _, w in limits.values()}):
        span = W.partitionBy("key", "endpoint", "_chunk").orderBy("_us").rangeBetween(-(size * 1_000_000 - 1), 0)
        one = F.when(F.col("_w") == size * 1_000_000, F.count("*").over(span))
        counts = one if counts is None else F.coalesce(counts, one)
    counted = seen.withColumn("in_window", counts).filter(F.col("_chunk") == F.col("_own"))
    return counted.select(*log.columns, "max_requests", "in_window", (F.col("in_window") > F.col("max_requests")).alias("over_limit"))


def reanalyze(
    posts: DataFrame, analyses: DataFrame, model_name: str, scorer: Scorer, as_of: Column, retries: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Score posts with bounded retries and write the results back; failures become ERROR rows.

    Returns the next analyses table and the failure rows."""
    scored = durable(score_models(posts, {model_name: scorer}, retries))
    authors = posts.select("post_id", F.col("username").alias("author_username"))
    good = scored.filter(F.col("error_message").isNull()).join(authors, "post_id").select(
        "post_id", "author_username", "category", F.col("explanation").alias("local_explanation"),
        F.lit("category_detection").alias("analysis_stages"), as_of.alias("analysis_ts"),
    )
    bad = scored.filter(F.col("error_message").isNotNull()).join(authors, "post_id").select(
        "post_id", "author_username", "error_message", F.array().cast("array<string>").alias("media_urls")
    )
    failures = failed_rows(bad, as_of)
    shared = [c for c in failures.columns if c in analyses.columns]
    incoming = good.unionByName(failures.select(*shared), allowMissingColumns=True)
    return upsert_analyses(analyses, incoming), failures


def with_original(posts: DataFrame) -> DataFrame:
    """Add the quoted or reposted original's text; reposts of analysed originals are skipped."""
    texts = posts.select(F.col("post_id").alias("original_post_id"), F.col("content").alias("_original"))
    joined = posts.join(texts, "original_post_id", "left")
    quoted = F.when(F.coalesce("original_content", F.lit("")) != "", F.col("original_content")).otherwise(F.col("_original"))
    skip = F.col("post_type").isin("repost_other", "repost_own") & F.coalesce("rt_original_analyzed", F.lit(False))
    return (
        joined.filter(~skip)
        .withColumn("quoted_text", quoted)
        .withColumn("analysis_text", F.concat_ws("\n", "content", "quoted_text"))
        .drop("_original")
    )


def collectable(incoming: DataFrame, posts: DataFrame) -> DataFrame:
    """Decide per incoming post: adds ``collect`` and, when not, the ``reason``."""
    stored = posts.select("post_id", "username", F.col("post_type").alias("_type"), F.col("content").alias("_text"), F.lit(True).alias("_hit"))
    joined = incoming.join(stored, ["post_id", "username"], "left")
    differs = ~F.col("post_type").eqNullSafe(F.col("_type")) | (
        (F.coalesce("_text", F.lit("")) != "") & (F.col("content") != F.col("_text"))
    )
    reason = (
        F.when(F.coalesce("is_pinned", F.lit(False)) | F.col("post_type").isin("pinned", "repost_own"), "pinned or own repost")
        .when(F.coalesce("content", F.lit("")) == "", "no content")
        .when(F.coalesce("_hit", F.lit(False)) & ~differs, "unchanged")
    )
    return (
        joined.withColumn("reason", reason).withColumn("collect", F.col("reason").isNull()).drop("_type", "_text", "_hit")
    )


# Second vocabulary of post types -> the stored one.
POST_TYPES = {"retweet": "repost_other", "quote": "original", "pinned": "original"}


def stored_post_types(posts: DataFrame) -> DataFrame:
    """Map collected post types to the stored vocabulary; pinned sets the flag."""
    kind = F.col("post_type")
    mapped = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in POST_TYPES.items()], kind)
    pinned = F.coalesce(F.col("is_pinned"), F.lit(False)) if "is_pinned" in posts.columns else F.lit(False)
    return posts.withColumn("is_pinned", pinned | F.coalesce(kind == "pinned", F.lit(False))).withColumn("post_type", mapped)
