"""Threads and reply graphs.

Posts carry a numeric order column (``post_num``, a snowflake in production). All
ordered scans are cut into chunks of that column, so a thread or an author that
holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalens.functions.scan import by_width, positions, running
from plazalens.operators.maintain import upsert_if_changed
from plazalens.session import durable

# Largest id gap inside a proximity group; about a day of ids per chunk.
ID_GAP = 5_000_000_000_000
ID_CHUNK = 1 << 48


def reached_posts(posts: DataFrame) -> DataFrame:
    """Posts that hang on a valid root by same-author replies: (post_id, root_id, ...).

    Foreign edges are cut first; what is left are trees of same-author edges, and
    pointer doubling finds the top of each post in log2(depth) rounds. Only posts that
    have not met their top take part in a round. A top counts when its own parent is
    absent; a post below a foreign parent or in a cycle stays out.
    """
    base = posts.select(
        "post_id", F.lower("username").alias("author"), "post_num", "reply_to_post_id",
        F.coalesce("has_thread_line", F.lit(False)).alias("line"),
    )
    parent = base.select(F.col("post_id").alias("reply_to_post_id"), F.col("author").alias("_p_author"))
    has_child = posts.filter(F.col("reply_to_post_id").isNotNull()).select(
        F.col("reply_to_post_id").alias("post_id")
    ).distinct().withColumn("_child", F.lit(True))
    own_edge = F.col("_p_author") == F.col("author")
    no_parent = F.col("_p_author").isNull()  # no reply, or the parent is not in the set
    root = (F.coalesce("_child", F.lit(False)) & no_parent) | (F.col("line") & F.col("reply_to_post_id").isNull())
    # Most posts are no replies; their null keys would meet in one task.
    replies = base.filter(F.col("reply_to_post_id").isNotNull()).join(parent, "reply_to_post_id", "left")
    linked = replies.unionByName(base.filter(F.col("reply_to_post_id").isNull()).withColumn("_p_author", F.lit(None).cast("string")))
    nodes = durable(
        linked.join(has_child, "post_id", "left")
        .select(
            "post_id", "author", "post_num",
            F.when(own_edge, F.col("reply_to_post_id")).alias("up"),
            F.when(~F.coalesce(own_edge, F.lit(False)), root).alias("is_root"),
        )
    )
    tops = nodes.filter(F.col("up").isNull())
    settled = tops.select("post_id", F.col("post_id").alias("top"))
    jumps = nodes.filter(F.col("up").isNotNull()).select("post_id", F.col("up").alias("at"))
    # Only settled posts that an open one points to take part in a round.
    pool = durable(settled.join(jumps.select(F.col("at").alias("post_id")), "post_id", "left_semi"))
    while True:
        # Where each post points: to its top (final), or to a post further up.
        target = pool.select(F.col("post_id").alias("at"), F.col("top").alias("_to"), F.lit(True).alias("final")).unionByName(
            jumps.select(F.col("post_id").alias("at"), F.col("at").alias("_to"), F.lit(False).alias("final"))
        )
        moved = durable(jumps.join(target, "at").select("post_id", F.col("_to").alias("at"), "final"))
        fresh = moved.filter("final").select("post_id", F.col("at").alias("top"))
        if fresh.isEmpty():  # nothing met its top: the rest are cycles
            break
        settled = settled.unionByName(fresh)
        jumps = moved.filter(~F.col("final")).select("post_id", "at")
        # Made of stored rows, once for each round so far, of which there are few; one checkpoint a round is enough.
        pool = pool.unionByName(fresh).join(jumps.select(F.col("at").alias("post_id")), "post_id", "left_semi")
    valid = tops.filter(F.coalesce("is_root", F.lit(False))).select(F.col("post_id").alias("top"))
    return (
        settled.join(valid, "top", "left_semi")
        .join(nodes.select("post_id", "author", "post_num"), "post_id")
        .select("post_id", F.col("top").alias("root_id"), F.col("author").alias("username"), "post_num")
    )


def _numbered(groups: DataFrame, key: str, chunk_width: int) -> DataFrame:
    """Sizes, smallest id and dense positions of groups with at least two posts."""
    sizes = groups.groupBy(key).agg(
        F.count("*").alias("thread_size"), F.min(F.struct("post_num", "post_id")).alias("_first")
    ).filter(F.col("thread_size") >= 2)
    kept = groups.join(sizes, key)
    placed = positions(kept, [key], [F.col("post_num"), F.col("post_id")], by_width(F.col("post_num"), chunk_width), "_pos")
    return placed.select(
        "post_id", "username", "post_num", F.col("_first.post_id").alias("thread_id"),
        (F.col("_pos") - 1).cast("int").alias("thread_position"), "thread_size",
    )


def reply_threads(posts: DataFrame, chunk_width: int = ID_CHUNK) -> DataFrame:
    """Reply-chain threads of at least two posts, ordered by numeric id."""
    return _numbered(reached_posts(posts), "root_id", chunk_width)


def proximity_threads(posts: DataFrame, used: DataFrame | None = None, gap: int = ID_GAP, chunk_width: int = ID_CHUNK) -> DataFrame:
    """Groups of an author's unused posts with a thread line whose ids are close."""
    rows = posts.filter(F.coalesce("has_thread_line", F.lit(False)))
    if used is not None:
        rows = rows.join(used.select("post_id"), "post_id", "left_anti")
    rows = rows.select("post_id", F.lower("username").alias("username"), "post_num")
    order, chunk = [F.col("post_num"), F.col("post_id")], by_width(F.col("post_num"), chunk_width)
    linked = running(rows, ["username"], order, chunk, {"_prev": ("max", F.col("post_num"))}, exclusive=True)
    starts = F.when(F.col("_prev").isNull() | (F.col("post_num") - F.col("_prev") >= gap), F.col("post_num"))
    islands = running(linked, ["username"], order, chunk, {"_island": ("max", starts)})
    keyed = islands.withColumn("_group", F.concat_ws("/", "username", F.col("_island").cast("string")))
    return _numbered(keyed.select("post_id", "username", "post_num", "_group"), "_group", chunk_width)


def apply_threads(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """Write thread id, conversation id, position and start mark back to the posts."""
    found = threads.select("post_id", F.col("thread_id").alias("_tid"), F.col("thread_position").alias("_pos"))
    joined = posts.join(found, "post_id", "left")
    replaced = {
        "thread_id": F.coalesce("_tid", "thread_id"),
        "conversation_id": F.coalesce("_tid", "conversation_id"),
        "thread_position": F.coalesce("_pos", "thread_position"),
        "is_thread_start": F.when(F.col("_tid").isNotNull(), F.col("_pos") == 0).otherwise(F.col("is_thread_start")),
    }
    return joined.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in posts.columns])


def save_threads(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """Save validated threads: type ``thread``, reply to the post before; rows already
    right are left alone. Adds ``change_kind`` (see ``upsert_if_changed``).

    The post before is found by an equi join on (thread, position - 1)."""
    before = threads.select(
        "thread_id", (F.col("thread_position") + 1).alias("thread_position"), F.col("post_id").alias("reply_to_post_id")
    )
    linked = threads.select("post_id", "thread_id", "thread_position").join(before, ["thread_id", "thread_position"], "left")
    stored = posts.select("post_id", F.col("thread_id").alias("_t"), F.col("thread_position").alias("_p"), "content", "username")
    rows = linked.join(stored, "post_id", "left")
    right = F.col("_t").eqNullSafe(F.col("thread_id")) & F.col("_p").eqNullSafe(F.col("thread_position"))
    incoming = rows.filter(~right).select(
        "post_id", "username", "content", F.lit("thread").alias("post_type"), "thread_id",
        F.col("thread_id").alias("conversation_id"), "thread_position",
        (F.col("thread_position") == 0).alias("is_thread_start"), "reply_to_post_id",
    )
    return upsert_if_changed(posts, incoming)


def conversation_prefix(messages: DataFrame, authors: DataFrame) -> DataFrame:
    """First unbroken run of the author in each conversation (conv_id, post_num, username).

    The run is bounded by two aggregates (first own post, first foreign post after
    it), so no conversation is ever ordered in one task."""
    rows = messages.join(authors.select("conv_id", F.lower("author").alias("_a")), "conv_id")
    own = F.lower("username") == F.col("_a")
    first = rows.filter(own).groupBy("conv_id").agg(F.min("post_num").alias("_from"))
    placed = rows.join(first, "conv_id").filter(F.col("post_num") >= F.col("_from"))
    stop = placed.filter(~own).groupBy("conv_id").agg(F.min("post_num").alias("_to"))
    kept = placed.filter(own).join(stop, "conv_id", "left")
    return kept.filter(F.col("_to").isNull() | (F.col("post_num") < F.col("_to"))).select(*messages.columns)


def contiguous_parents(messages: DataFrame, focal: DataFrame) -> DataFrame:
    """The author's unbroken run right before the focal post (conv_id, focal_num, author)."""
    rows = messages.join(focal.select("conv_id", "focal_num", F.lower("author").alias("_a")), "conv_id").filter(
        F.col("post_num") < F.col("focal_num")
    )
    own = F.lower("username") == F.col("_a")
    barrier = rows.filter(~own).groupBy("conv_id").agg(F.max("post_num").alias("_after"))
    kept = rows.filter(own).join(barrier, "conv_id", "left")
    return kept.filter(F.col("_after").isNull() | (F.col("post_num") > F.col("_after"))).select(*messages.columns)


def is_thread_member(is_reply: Column, replies_to: Column, username: Column) -> Column:
    return F.coalesce(is_reply, F.lit(False)) | F.coalesce((replies_to == username) & (replies_to != ""), F.lit(False))


def thread_candidates(posts: DataFrame, threads: DataFrame, target: Column | None = None) -> DataFrame:
    """Posts that may start a thread: no connector and not yet in a processed thread."""
    own = posts if target is None else posts.filter(F.lower("username") == F.lower(target))
    open_ = own.filter(~F.coalesce("has_thread_line", F.lit(False)))
    return open_.join(threads.select("post_id"), "post_id", "left_anti").dropDuplicates(["post_id"])
