"""Queries for incremental ingest, date windows, limits and streams."""

import uuid

from pyspark.sql import functions as F

from plazalens.catalog.claims import EVENTS_TEXT, event_posts, has
from plazalens.catalog.labels import LABELS
from plazalens.catalog.maintain import TS, stamp
from plazalens.catalog.registry import query
from plazalens.operators import ingest as O
from plazalens.operators import reports
from plazalens.plans import driver_views as D
from plazalens.plans.lifecycles import analyse_pending
from plazalens.plans.sample_scorers import refusing, silent
from plazalens.rules import claims as K
from plazalens.session import work_folder
from plazalens.streaming import jobs as J


def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def scratch(v) -> str:
    """A folder of this run in the shared work folder."""
    return f"{work_folder(v.spark)}/run-{uuid.uuid4().hex}"


def table_stream(v, name: str):
    """A driver table as a stream, be it one file or a folder of files. The name is a pattern, as a stream's plain
    path has to be a folder."""
    return v.spark.readStream.schema(v.raw(name).schema).parquet(f"{v.folder}/[{name[0]}]{name[1:]}.parquet")


UPSERTED = ["post_id", "content", "username", "post_type", "likes", "thread_id", "is_thread_start"]


@query(
    "H1_stream_upsert",
    """SELECT coalesce(p.post_id, n.post_id) AS post_id, CASE WHEN n.post_id IS NULL THEN p.content ELSE n.content END AS content,
       CASE WHEN p.post_id IS NULL THEN n.username ELSE p.username END AS username, CASE WHEN n.post_id IS NULL THEN p.post_type ELSE n.post_type END AS post_type,
       CASE WHEN n.post_id IS NULL THEN p.likes ELSE n.likes END AS likes, coalesce(n.thread_id, p.thread_id) AS thread_id,
       CASE WHEN p.post_id IS NULL THEN coalesce(n.is_thread_start, FALSE) ELSE coalesce(n.is_thread_start, p.is_thread_start) END AS is_thread_start
       FROM posts p FULL OUTER JOIN incoming_posts n ON n.post_id = p.post_id""",
)
def stream_upsert(v):
    """About three micro-batches; rows of one come again in the next. Each is as many files as the table has splits."""
    folder = scratch(v)
    stored = v.posts.select(*UPSERTED)
    J.create_table(stored, f"{folder}/posts", buckets=8)
    news = v.incoming_posts.withColumn("arrival", F.col("post_ts"))
    share = F.pmod(F.xxhash64("post_id"), F.lit(6))
    for part in range(3):
        news.filter(share.isin(2 * part, 2 * part + 1, (2 * part + 2) % 6)).write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
    files = max(1, news.rdd.getNumPartitions())
    stream = v.spark.readStream.schema(news.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    J.stream_upsert(
        stream, f"{folder}/posts", f"{folder}/state", stored.schema, "arrival", buckets=8, event_time="arrival", delay="100 days"
    ).awaitTermination()
    return J.read_table(v.spark, f"{folder}/posts", UPSERTED, stored.schema)


@query(
    "H2_only_new",
    """WITH b AS (SELECT username, min(post_ts) AS lo FROM posts GROUP BY username)
       SELECT n.post_id, n.username FROM incoming_posts n LEFT JOIN b ON b.username = n.username WHERE b.lo IS NULL OR n.post_ts < b.lo""",
)
def only_new(v):
    bounds = v.posts.groupBy("username").agg(F.min("post_ts").alias("oldest_ts"), F.max("post_ts").alias("newest_ts"))
    return O.only_new(v.incoming_posts, bounds, "older").select("post_id", "username")


@query(
    "H2_only_newer",
    """WITH b AS (SELECT username, max(post_ts) AS hi FROM posts GROUP BY username)
       SELECT n.post_id, n.username FROM incoming_posts n LEFT JOIN b ON b.username = n.username WHERE b.hi IS NULL OR n.post_ts > b.hi""",
)
def only_newer(v):
    bounds = v.posts.groupBy("username").agg(F.min("post_ts").alias("oldest_ts"), F.max("post_ts").alias("newest_ts"))
    return O.only_new(v.incoming_posts, bounds, "newer").select("post_id", "username")


ARRIVALS = "ar AS (SELECT CAST(event_id AS VARCHAR) AS post_id, event_type AS username, event_id AS arrival, value > 14 AND event_id > 400 AS stored FROM events)"


@query(
    "H3_until_known_run",
    f"""WITH {ARRIVALS}, p AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY arrival) AS pos FROM ar),
       w AS (SELECT *, CASE WHEN sum(CASE WHEN stored THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY arrival ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN pos END AS st FROM p),
       s AS (SELECT username, min(st) AS stop FROM w GROUP BY username)
       SELECT p.post_id, p.username FROM p JOIN s ON s.username = p.username WHERE NOT p.stored AND (s.stop IS NULL OR p.pos < s.stop)""",
)
def known_run(v):
    rows = v.raw("events").select(
        F.col("event_id").cast("string").alias("post_id"), F.col("event_type").alias("username"), F.col("event_id").alias("arrival"),
        F.expr("value > 14 AND event_id > 400").alias("stored"),
    )
    return O.until_known_run(rows.drop("stored"), rows.filter("stored"), 3, chunk_width=200).select("post_id", "username")


@query(
    "H4_windows_back",
    """WITH b AS (SELECT username, max(CAST(post_ts AS DATE)) AS hi FROM posts GROUP BY username)
       SELECT username, CAST(i AS INTEGER) AS window_no, CAST(CAST(hi - CAST((i + 1) * 60 AS INTEGER) AS DATE) AS VARCHAR) AS start_date, CAST(CAST(hi - CAST(i * 60 AS INTEGER) AS DATE) AS VARCHAR) AS end_date
       FROM b CROSS JOIN (SELECT unnest(range(0, 4)) AS i) r""",
)
def windows_back(v):
    ends = reports.date_bounds(v.posts).select("username", F.col("newest").alias("end_date"))
    return O.windows_back(ends, 4, 2).select(
        "username", "window_no", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date")
    )


@query(
    "H5_adaptive_windows",
    """WITH RECURSIVE dn AS (SELECT event_type AS username, CAST(ts AS DATE) AS d FROM events),
       wn AS (SELECT DISTINCT event_type AS username, DATE '2024-01-01' AS s, DATE '2024-02-10' AS e, 0 AS depth FROM events
         UNION ALL SELECT w.username, CAST(CASE WHEN h.k = 0 THEN w.s ELSE w.s + CAST((w.e - w.s) // 2 AS INTEGER) END AS DATE), CAST(CASE WHEN h.k = 0 THEN w.s + CAST((w.e - w.s) // 2 AS INTEGER) ELSE w.e END AS DATE), w.depth + 1
           FROM wn w CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) h WHERE w.depth < 4 AND w.e - w.s > 1 AND (SELECT count(*) FROM dn WHERE dn.username = w.username AND d >= w.s AND d < w.e) >= 100)
       SELECT username, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date, n AS n_posts, depth FROM
         (SELECT *, (SELECT count(*) FROM dn WHERE dn.username = wn.username AND d >= wn.s AND d < wn.e) AS n FROM wn) x WHERE NOT (n >= 100 AND e - s > 1 AND depth < 4)""",
)
def adaptive(v):
    posts = v.raw("events").select(F.col("event_type").alias("username"), F.col("ts").cast("timestamp").alias("post_ts"))
    windows = posts.select("username").distinct().selectExpr("username", "DATE '2024-01-01' AS start_date", "DATE '2024-02-10' AS end_date")
    out = O.adaptive_windows(posts, windows, threshold=100, depth=4)
    return out.select(
        "username", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "n_posts", "depth"
    )


DAY_WINDOWS = """dw AS (SELECT user_id AS u, CAST(DATE '2024-01-30' - CAST(i AS INTEGER) AS DATE) AS day, i FROM (SELECT DISTINCT user_id FROM events) q CROSS JOIN (SELECT unnest(range(0, 30)) AS i) r),
  wc AS (SELECT dw.u, dw.day, dw.i, (SELECT count(*) FROM events e WHERE e.user_id = dw.u AND CAST(e.ts AS DATE) = dw.day) AS n FROM dw)"""


@query(
    "H6_history_extent",
    f"""WITH {DAY_WINDOWS}, s AS (SELECT *, CASE WHEN sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 THEN i END AS st FROM wc),
       m AS (SELECT u, min(st) AS stop FROM s GROUP BY u)
       SELECT CAST(w.u AS VARCHAR) AS username, count(*) AS windows_processed, CAST(sum(n) AS BIGINT) AS total_posts, CAST(min(CASE WHEN n > 0 THEN day END) AS VARCHAR) AS oldest_reached, max(m.stop) IS NOT NULL AS reached_start
       FROM wc w JOIN m ON m.u = w.u WHERE m.stop IS NULL OR w.i <= m.stop GROUP BY w.u""",
)
def extent(v):
    daily = v.raw("events").groupBy("user_id", F.to_date("ts").alias("start_date")).agg(F.count("*").alias("n_posts"))
    grid = v.raw("events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("window_no"))
    windows = grid.withColumn("start_date", F.date_sub(F.lit("2024-01-30").cast("date"), F.col("window_no"))).join(
        daily, ["user_id", "start_date"], "left"
    )
    rows = windows.select(
        F.col("user_id").cast("string").alias("username"), "window_no", "start_date", F.date_add("start_date", 1).alias("end_date"),
        F.coalesce("n_posts", F.lit(0)).alias("n_posts"),
    )
    return O.history_extent(rows, 2).select(
        "username", "windows_processed", "total_posts", F.col("oldest_reached").cast("string").alias("oldest_reached"), "reached_start"
    )


WANTED = """wt AS (SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR)) AS username, CAST(ts AS DATE) AS s, CAST(CAST(ts AS DATE) + INTERVAL '1' DAY AS DATE) AS e FROM events
  UNION SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR)), DATE '2024-03-01', DATE '2024-03-02' FROM events)"""


def wanted(v):
    e = v.raw("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.to_date("ts").alias("start_date"))
    days = e.withColumn("end_date", F.date_add("start_date", 1))
    extra = e.select("username").selectExpr("username", "DATE '2024-03-01' AS start_date", "DATE '2024-03-02' AS end_date")
    return days.unionByName(extra).distinct()


@query(
    "H7_pending_ranges",
    f"""WITH {WANTED} SELECT w.username, CAST(w.s AS VARCHAR) AS start_date, coalesce(p.status, 'pending') AS status FROM wt w
       LEFT JOIN progress p ON p.username = w.username AND p.start_date = w.s AND p.end_date = w.e WHERE coalesce(p.status, 'pending') <> 'completed'""",
)
def pending(v):
    return O.pending_ranges(v.progress, wanted(v)).select("username", F.col("start_date").cast("string").alias("start_date"), "status")


@query(
    "H7_is_collected",
    f"""WITH {WANTED} SELECT w.username, CAST(w.s AS VARCHAR) AS start_date, coalesce(p.status = 'completed', FALSE) AS collected FROM wt w
       LEFT JOIN progress p ON p.username = w.username AND p.start_date = w.s AND p.end_date = w.e""",
)
def collected(v):
    return O.is_collected(wanted(v), v.progress).select("username", F.col("start_date").cast("string").alias("start_date"), "collected")


@query(
    "H8_mark_ranges",
    f"""WITH {WANTED}, u AS (SELECT username, s, e FROM wt WHERE CAST(substring(username, 2, 10) AS INTEGER) % 2 = 0)
       SELECT username, CAST(start_date AS VARCHAR) AS start_date, status, posts_collected FROM progress p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.username = p.username AND u.s = p.start_date AND u.e = p.end_date)
       UNION ALL SELECT username, CAST(s AS VARCHAR), 'completed', 9 FROM u""",
)
def mark(v):
    updates = wanted(v).filter("cast(substring(username, 2, 10) as int) % 2 = 0").selectExpr(
        "*", "'completed' AS status", "9 AS posts_collected", "cast(null as timestamp) AS completed_at"
    )
    return O.mark_ranges(v.progress, updates).select("username", F.col("start_date").cast("string").alias("start_date"), "status", "posts_collected")


LIMITS = {"click": (2, 86_400), "view": (1, 40_000), "error": (3, 172_800)}


def walk_sql(rows, n, w):
    """Greedy sliding limit by recursion: one step per request of a key, `k` and `us` columns."""
    fresh = "list_filter(walk.passed, lambda x: x > o.us - o.w)"
    return f"""o AS (SELECT *, {n} AS mx, CAST({w} AS BIGINT) * 1000000 AS w, row_number() OVER (PARTITION BY k ORDER BY us, event_id) AS rn FROM {rows}),
      walk AS (SELECT k, rn, event_id, [us] AS passed, TRUE AS ok FROM o WHERE rn = 1
        UNION ALL SELECT o.k, o.rn, o.event_id, CASE WHEN len({fresh}) < o.mx THEN list_append({fresh}, o.us) ELSE {fresh} END, len({fresh}) < o.mx
          FROM walk JOIN o ON o.k = walk.k AND o.rn = walk.rn + 1)"""


BREACH_ROWS = "(SELECT event_id, key, endpoint, concat(key, '/', endpoint) AS k, epoch_us(ts) AS us FROM requests WHERE endpoint IN ('click', 'view', 'error')) q"


BREACHES = (
    "WITH RECURSIVE "
    + walk_sql(BREACH_ROWS, "CASE endpoint WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 3 END", "CASE endpoint WHEN 'click' THEN 86400 WHEN 'view' THEN 40000 ELSE 172800 END")
    + " SELECT o.event_id, o.key, o.endpoint FROM walk JOIN o ON o.event_id = walk.event_id WHERE NOT walk.ok"
)


@query("H9_rate_breaches", BREACHES)
def breaches(v):
    return O.rate_breaches(v.requests, LIMITS).select("event_id", "key", "endpoint")


@query("H9_breach_stream", BREACHES)
def breach_stream(v):
    """The log arrives in three files, out of order, one file a micro-batch, and ends with a mark."""
    folder = scratch(v)
    log = v.requests.select("event_id", "key", "endpoint", "ts").filter(F.col("endpoint").isin(list(LIMITS)))
    for part in range(3):
        log.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).coalesce(1).write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
    J.end_mark(log, 40).coalesce(1).write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
    stream = v.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    J.append_to(J.breach_stream(stream, LIMITS, "40 days"), f"{folder}/out", f"{folder}/state", settings=J.ROCKS_STORE).awaitTermination()
    return v.spark.read.schema(J.BREACH_SCHEMA).parquet(f"{folder}/out").select("event_id", "key", "endpoint")


@query(
    "H10_request_volume",
    """WITH r AS (SELECT event_id, key, endpoint, epoch_us(ts) AS us, CASE endpoint WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 3 END AS mx, CASE endpoint WHEN 'click' THEN CAST(86400 AS BIGINT) WHEN 'view' THEN 40000 ELSE 172800 END AS w
         FROM requests WHERE endpoint IN ('click', 'view', 'error'))
       SELECT a.event_id, a.key, a.endpoint, CAST(a.mx AS INTEGER) AS max_requests, count(*) AS in_window, count(*) > a.mx AS over_limit FROM r a
       JOIN r b ON b.key = a.key AND b.endpoint = a.endpoint AND b.us <= a.us AND b.us > a.us - a.w * 1000000 GROUP BY a.event_id, a.key, a.endpoint, a.mx""",
)
def volume(v):
    return O.request_volume(v.requests, LIMITS).select("event_id", "key", "endpoint", "max_requests", "in_window", "over_limit")


@query(
    "H10_volume_stream",
    f"""WITH r AS (SELECT key, endpoint, epoch_us(ts) AS us FROM requests), w AS (SELECT key, endpoint, (us // 43200000000 - i) * 43200000000 AS st FROM r CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) k)
       SELECT key, endpoint, strftime(make_timestamp(st), '{TS}') AS window_start, count(*) AS n FROM w GROUP BY key, endpoint, st""",
)
def volume_stream(v):
    folder = scratch(v)
    log = v._view(D._REQUESTS, table_stream(v, "events"))
    # Complete result of one finite run: update mode into a keyed sink.
    counts = J.volume_stream(log, "1 day", "12 hours", "40 days")

    def keep(batch, _):
        batch.write.mode("append").parquet(f"{folder}/out")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = v.spark.read.parquet(f"{folder}/out")
    return out.groupBy("key", "endpoint", "window_start").agg(F.max("n").alias("n")).select("key", "endpoint", stamp("window_start"), "n")


@query("H11_label_stream", f"WITH {LABELS} SELECT post_id, coalesce(cats[1], 'non_political') AS primary_category, array_to_string(cats, ',') AS categories FROM lab")
def label_stream(v):
    folder = scratch(v)
    stream = v._view(D._POSTS, table_stream(v, "documents")).select("post_id", "content")
    labelled = J.label_stream(stream).select("post_id", "primary_category", F.array_join("categories", ",").alias("categories"))
    J.append_to(labelled, f"{folder}/out", f"{folder}/state").awaitTermination()
    return v.spark.read.schema(labelled.schema).parquet(f"{folder}/out")


@query(
    "H12_reanalyze",
    """WITH s AS (SELECT post_id, username, contains(content, 'estado profundo') AS bad FROM posts)
       SELECT post_id, username AS author_username, CASE WHEN bad THEN 'ERROR' ELSE 'general' END AS category, CASE WHEN bad THEN 'Analysis failed: no answer' ELSE 'seen' END AS local_explanation,
        CASE WHEN bad THEN 'error' ELSE 'category_detection' END AS analysis_stages FROM s
       UNION ALL SELECT post_id, author_username, category, local_explanation, analysis_stages FROM content_analyses WHERE post_id NOT IN (SELECT post_id FROM posts)""",
)
def reanalyze(v):
    table, _ = O.reanalyze(v.posts, v.content_analyses, "picky", silent, as_of(), retries=1)
    return table.select("post_id", "author_username", "category", "local_explanation", "analysis_stages")


@query(
    "H13_with_original",
    """SELECT p.post_id, CASE WHEN coalesce(p.original_content, '') <> '' THEN p.original_content ELSE o.content END AS quoted_text, length(concat_ws(chr(10), p.content, CASE WHEN coalesce(p.original_content, '') <> '' THEN p.original_content ELSE o.content END)) AS n
       FROM posts p LEFT JOIN posts o ON o.post_id = p.original_post_id WHERE NOT (p.post_type IN ('repost_other', 'repost_own') AND p.rt_original_analyzed)""",
)
def with_original(v):
    return O.with_original(v.posts).select("post_id", "quoted_text", F.length("analysis_text").cast("bigint").alias("n"))


@query(
    "H14_collectable",
    """SELECT n.post_id, CASE WHEN n.is_pinned OR n.post_type IN ('pinned', 'repost_own') THEN 'pinned or own repost' WHEN coalesce(n.content, '') = '' THEN 'no content'
       WHEN p.post_id IS NOT NULL AND NOT (p.post_type <> n.post_type OR (coalesce(p.content, '') <> '' AND n.content <> p.content)) THEN 'unchanged' END AS reason
       FROM incoming_posts n LEFT JOIN posts p ON p.post_id = n.post_id AND p.username = n.username""",
)
def collectable(v):
    return O.collectable(v.incoming_posts, v.posts).select("post_id", "reason")


ARREST = f"({has('e.content', K.ARREST_WORDS)} AND {has('e.content', K.FIGURES)})"


@query(
    "H12_analyse_pending",
    f"""WITH {EVENTS_TEXT}, w AS (SELECT post_id, username, likes FROM posts p WHERE NOT (post_type IN ('repost_other', 'repost_own') AND rt_original_analyzed) AND NOT EXISTS (SELECT 1 FROM content_analyses a WHERE a.post_id = p.post_id)),
       x AS (SELECT w.post_id, w.username, contains(e.content, 'Todos a las calles') AS failed, {ARREST} AS arrest, w.likes % 3 AS r FROM w JOIN et e ON e.post_id = w.post_id)
       SELECT post_id, username AS author_username, CASE WHEN failed THEN 'ERROR' WHEN arrest AND r = 0 THEN 'disinformation' ELSE 'general' END AS category,
         CASE WHEN failed THEN 'Analysis failed: refused' WHEN arrest AND r = 0 THEN 'fine' || chr(10) || chr(10) || 'Verificación realizada: 2 afirmaciones analizadas. Contradicciones detectadas: 1.'
           WHEN arrest AND r = 1 THEN 'fine' || chr(10) || chr(10) || 'Verificación realizada: 2 afirmaciones analizadas.' ELSE 'fine' END AS local_explanation,
         CASE WHEN NOT failed AND arrest AND r < 2 THEN CASE r WHEN 0 THEN 'debunked' ELSE 'verified' END END AS verdict,
         CASE WHEN NOT failed AND arrest AND r < 2 THEN CAST(0.75 AS DOUBLE) END AS verification_confidence FROM x
       UNION ALL SELECT post_id, author_username, category, local_explanation, CASE WHEN json_valid(verification_data) THEN json_extract_string(verification_data, '$.overall_verdict') END, verification_confidence FROM content_analyses""",
)
def analyse(v):
    """The whole analysis lifecycle over the worklist, with reports and a model that refuses some texts."""
    reports_ = v.posts.filter("likes % 3 < 2").select(
        "post_id", F.expr("if(likes % 3 = 0, 'debunked', 'verified')").alias("verdict"), F.lit(0.75).alias("confidence"), F.lit(2).alias("n_claims"),
        F.lit(1).alias("n_sources"), F.expr("if(likes % 3 = 0, array('x'), cast(array() as array<string>))").alias("contradictions"),
    )
    table = analyse_pending(event_posts(v), v.content_analyses, refusing, reports_, as_of())
    return table.select(
        "post_id", "author_username", "category", "local_explanation", F.get_json_object("verification_data", "$.overall_verdict").alias("verdict"), "verification_confidence"
    )
