"""Queries for threads and reply graphs."""

from pyspark.sql import functions as F

from plazalens.catalog.registry import query
from plazalens.operators import threads as O

# Same-author chains by recursion from the roots.
CHAINS = """child AS (SELECT DISTINCT reply_to_post_id AS post_id FROM thread_posts WHERE reply_to_post_id IS NOT NULL),
  roots AS (SELECT t.post_id, t.username, t.post_num FROM thread_posts t LEFT JOIN thread_posts p ON p.post_id = t.reply_to_post_id
    WHERE (p.post_id IS NULL AND t.post_id IN (SELECT post_id FROM child)) OR (t.has_thread_line AND t.reply_to_post_id IS NULL)),
  walk AS (SELECT post_id, post_id AS root_id, lower(username) AS username, post_num FROM roots
    UNION ALL SELECT c.post_id, w.root_id, w.username, c.post_num FROM thread_posts c JOIN walk w ON c.reply_to_post_id = w.post_id AND lower(c.username) = w.username)"""
THREADS = f"""{CHAINS}, sized AS (SELECT *, count(*) OVER (PARTITION BY root_id) AS thread_size, row_number() OVER (PARTITION BY root_id ORDER BY post_num) - 1 AS pos,
    first_value(post_id) OVER (PARTITION BY root_id ORDER BY post_num) AS thread_id FROM walk),
  threads AS (SELECT post_id, username, thread_id, CAST(pos AS INTEGER) AS thread_position, thread_size FROM sized WHERE thread_size >= 2)"""


@query("D1_reply_threads", f"WITH RECURSIVE {THREADS} SELECT post_id, username, thread_id, thread_position, thread_size FROM threads")
def reply_threads(v):
    return O.reply_threads(v.thread_posts, chunk_width=100_000).drop("post_num")


@query(
    "D2_proximity_threads",
    """WITH r AS (SELECT event_id, lower(event_type) AS username, epoch_us(ts) AS num FROM events WHERE event_id % 2 = 0 OR event_type <> 'view'),
       l AS (SELECT *, CASE WHEN lag(num) OVER w IS NULL OR num - lag(num) OVER w >= 600000000 THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (PARTITION BY username ORDER BY num, event_id)),
       g AS (SELECT *, sum(brk) OVER (PARTITION BY username ORDER BY num, event_id) AS grp FROM l),
       s AS (SELECT *, count(*) OVER (PARTITION BY username, grp) AS n, row_number() OVER (PARTITION BY username, grp ORDER BY num, event_id) - 1 AS pos,
         first_value(event_id) OVER (PARTITION BY username, grp ORDER BY num, event_id) AS tid FROM g)
       SELECT CAST(event_id AS VARCHAR) AS post_id, username, CAST(tid AS VARCHAR) AS thread_id, CAST(pos AS INTEGER) AS thread_position, n AS thread_size FROM s WHERE n >= 2""",
)
def proximity(v):
    posts = v.raw("events").select(
        F.col("event_id").cast("string").alias("post_id"),
        F.col("event_type").alias("username"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("post_num"),
        F.expr("event_id % 2 = 0 OR event_type <> 'view'").alias("has_thread_line"),
    )
    return O.proximity_threads(posts, gap=600_000_000, chunk_width=86_400_000_000).drop("post_num")


@query(
    "D3_apply_threads",
    f"""WITH RECURSIVE {THREADS} SELECT p.post_id, coalesce(t.thread_id, 'old') AS thread_id, coalesce(t.thread_id, 'old') AS conversation_id,
       coalesce(t.thread_position, 7) AS thread_position, CASE WHEN t.post_id IS NULL THEN FALSE ELSE t.thread_position = 0 END AS is_thread_start
       FROM thread_posts p LEFT JOIN threads t ON t.post_id = p.post_id""",
)
def apply(v):
    stored = v.thread_posts.select("post_id").selectExpr(
        "post_id", "'old' AS thread_id", "'old' AS conversation_id", "7 AS thread_position", "false AS is_thread_start"
    )
    return O.apply_threads(stored, O.reply_threads(v.thread_posts, 100_000))


@query(
    "D4_save_threads",
    f"""WITH RECURSIVE {THREADS}, st AS (SELECT p.post_id, CASE WHEN p.post_num % 1000 = 1 THEN t.thread_id END AS old_id, CASE WHEN p.post_num % 1000 = 1 THEN t.thread_position END AS old_pos FROM thread_posts p LEFT JOIN threads t ON t.post_id = p.post_id),
       n AS (SELECT t.*, (SELECT b.post_id FROM threads b WHERE b.thread_id = t.thread_id AND b.thread_position = t.thread_position - 1) AS prev FROM threads t JOIN st ON st.post_id = t.post_id
         WHERE st.old_id IS DISTINCT FROM t.thread_id OR st.old_pos IS DISTINCT FROM t.thread_position)
       SELECT p.post_id, CASE WHEN n.post_id IS NOT NULL THEN 'updated' END AS change_kind, CASE WHEN n.post_id IS NOT NULL THEN 'thread' ELSE 'original' END AS post_type,
         coalesce(n.thread_id, st.old_id) AS thread_id, coalesce(n.thread_position, st.old_pos) AS thread_position, n.prev AS reply_to_post_id
       FROM thread_posts p JOIN st ON st.post_id = p.post_id LEFT JOIN n ON n.post_id = p.post_id""",
)
def save(v):
    threads = O.reply_threads(v.thread_posts, 100_000)
    marked = F.expr("post_num % 1000 = 1")
    stored = v.thread_posts.select("post_id", "username", "content", "post_num").join(
        threads.select("post_id", "thread_id", "thread_position"), "post_id", "left"
    ).select(
        "post_id", "username", "content", F.lit("original").alias("post_type"), F.lit(None).cast("string").alias("original_author"),
        F.lit(None).cast("string").alias("original_post_id"), F.when(marked, F.col("thread_id")).alias("thread_id"),
        F.lit(None).cast("string").alias("conversation_id"), F.when(marked, F.col("thread_position")).alias("thread_position"),
        F.lit(None).cast("boolean").alias("is_thread_start"), F.lit(None).cast("string").alias("reply_to_post_id"),
    )
    incoming_ready = threads.select("post_id", "thread_id", "thread_position")
    return O.save_threads(stored, incoming_ready).select(
        "post_id", "change_kind", "post_type", "thread_id", "thread_position", "reply_to_post_id"
    )


@query(
    "D5_conversation_prefix",
    """WITH a AS (SELECT conv_id, max(username) FILTER (WHERE turn2 = 1) AS author FROM (SELECT *, post_num % 1000 AS turn2 FROM thread_posts) x GROUP BY conv_id HAVING max(username) FILTER (WHERE turn2 = 1) IS NOT NULL),
       r AS (SELECT t.conv_id, t.post_id, t.post_num, t.username = a.author AS own FROM thread_posts t JOIN a ON a.conv_id = t.conv_id),
       s AS (SELECT *, max(CASE WHEN own THEN 1 ELSE 0 END) OVER w AS started, sum(CASE WHEN NOT own THEN 1 ELSE 0 END) OVER w AS foreigners FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY post_num)),
       f AS (SELECT *, min(CASE WHEN own THEN foreigners END) OVER (PARTITION BY conv_id) AS f0 FROM s)
       SELECT conv_id, post_id FROM f WHERE own AND foreigners = f0""",
)
def prefix(v):
    authors = v.thread_posts.filter("post_num % 1000 = 1").groupBy("conv_id").agg(F.max("username").alias("author"))
    return O.conversation_prefix(v.thread_posts, authors).select("conv_id", "post_id")


@query(
    "D6_contiguous_parents",
    """WITH f AS (SELECT conv_id, max(post_num) AS focal_num, arg_max(username, post_num) AS author FROM thread_posts GROUP BY conv_id),
       r AS (SELECT t.conv_id, t.post_id, t.post_num, t.username = f.author AS own FROM thread_posts t JOIN f ON f.conv_id = t.conv_id WHERE t.post_num < f.focal_num),
       b AS (SELECT *, sum(CASE WHEN NOT own THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY post_num DESC) AS breaks FROM r)
       SELECT conv_id, post_id FROM b WHERE own AND breaks = 0""",
)
def parents(v):
    focal = v.thread_posts.groupBy("conv_id").agg(F.max("post_num").alias("focal_num"), F.max_by("username", "post_num").alias("author"))
    return O.contiguous_parents(v.thread_posts, focal).select("conv_id", "post_id")


@query(
    "D7_is_thread_member",
    "SELECT post_id, (reply_to_post_id IS NOT NULL OR coalesce(reply_to_username = username, FALSE)) AS member FROM posts",
)
def member(v):
    return v.posts.select(
        "post_id",
        O.is_thread_member(F.col("reply_to_post_id").isNotNull(), F.col("reply_to_username"), F.col("username")).alias("member"),
    )


@query(
    "D8_thread_candidates",
    f"""WITH RECURSIVE {THREADS} SELECT post_id, username FROM thread_posts WHERE NOT has_thread_line AND post_id NOT IN (SELECT post_id FROM threads)""",
)
def candidates(v):
    return O.thread_candidates(v.thread_posts, O.reply_threads(v.thread_posts, 100_000)).select("post_id", "username")
