"""Queries for the table-maintenance operators."""

from pyspark.sql import functions as F

from plazalens.catalog.registry import query
from plazalens.operators import maintain as M
from plazalens.sources import tables as S



def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")

TS = "%Y-%m-%d %H:%M:%S"


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "A1_typed_load",
    f"""SELECT post_id, username, post_type, strftime(post_ts, '{TS}') AS post_ts, media_count, likes,
       CAST(len(list_filter(list_transform(string_split(coalesce(media_links, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_media,
       array_to_string(list_filter(list_transform(string_split(coalesce(media_links, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS media
       FROM posts""",
)
def typed_load(v):
    posts = S.with_media_list(S.with_thread_columns(v.posts))
    return posts.select(
        "post_id", "username", "post_type", stamp("post_ts"), "media_count", "likes",
        F.size("media_urls").alias("n_media"), F.array_join("media_urls", "|").alias("media"),
    )


@query(
    "A2_thread_columns",
    """SELECT post_id, CAST(NULL AS VARCHAR) AS reply_to_post_id, CAST(NULL AS VARCHAR) AS conversation_id,
       thread_id, CAST(0 AS INTEGER) AS thread_position, FALSE AS is_thread_start FROM posts""",
)
def thread_columns(v):
    old = v.posts.select("post_id", "thread_id")
    return S.with_thread_columns(old).select("post_id", *S.THREAD_COLUMNS)


BATCH = "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 'Analytics' ELSE CAST(event_id % 700 AS VARCHAR) END AS post_id, event_type, ts FROM events"


@query(
    "A3_clean_batch",
    f"""SELECT post_id, event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY event_id) AS rn FROM ({BATCH}) b
        WHERE post_id IS NOT NULL AND lower(post_id) <> 'analytics') x WHERE rn = 1""",
)
def clean(v):
    batch = v.raw("events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 'Analytics' ELSE CAST(event_id % 700 AS STRING) END AS post_id",
        "event_type",
    )
    return M.clean_batch(batch, [F.col("event_id")]).select("post_id", "event_id", "event_type")


@query(
    "A4_upsert_posts",
    f"""SELECT coalesce(p.post_id, n.post_id) AS post_id,
       CASE WHEN n.post_id IS NULL THEN p.content ELSE n.content END AS content,
       CASE WHEN p.post_id IS NULL THEN n.username ELSE p.username END AS username,
       CASE WHEN p.post_id IS NULL THEN n.reply_to_username ELSE p.reply_to_username END AS reply_to_username,
       strftime(CASE WHEN p.post_id IS NULL THEN n.post_ts ELSE p.post_ts END, '{TS}') AS post_ts,
       CASE WHEN n.post_id IS NULL THEN p.post_type ELSE n.post_type END AS post_type,
       CASE WHEN n.post_id IS NULL THEN p.original_author ELSE n.original_author END AS original_author,
       CASE WHEN n.post_id IS NULL THEN p.likes ELSE n.likes END AS likes,
       CASE WHEN n.post_id IS NULL THEN p.is_pinned ELSE n.is_pinned END AS is_pinned,
       coalesce(n.thread_id, p.thread_id) AS thread_id,
       coalesce(n.thread_position, p.thread_position) AS thread_position,
       CASE WHEN p.post_id IS NULL THEN coalesce(n.is_thread_start, FALSE) ELSE coalesce(n.is_thread_start, p.is_thread_start) END AS is_thread_start,
       coalesce(n.reply_to_post_id, p.reply_to_post_id) AS reply_to_post_id,
       p.original_content
       FROM posts p FULL OUTER JOIN incoming_posts n ON n.post_id = p.post_id""",
)
def upsert(v):
    return M.upsert_posts(v.posts, v.incoming_posts).select(
        "post_id", "content", "username", "reply_to_username", stamp("post_ts"), "post_type", "original_author", "likes",
        "is_pinned", "thread_id", "thread_position", "is_thread_start", "reply_to_post_id", "original_content",
    )


@query(
    "A5_upsert_if_changed",
    """WITH j AS (SELECT p.post_id AS pid, n.post_id AS nid, p.content AS pc, n.content AS nc, p.post_type AS pt, n.post_type AS nt,
         p.thread_id AS pth, n.thread_id AS nth, p.likes AS pl, n.likes AS nl,
         (n.post_type <> p.post_type OR (coalesce(n.original_author, '') <> '' AND n.original_author IS DISTINCT FROM p.original_author)
          OR (coalesce(n.original_post_id, '') <> '' AND n.original_post_id IS DISTINCT FROM p.original_post_id)
          OR (coalesce(n.content, '') <> '' AND n.content IS DISTINCT FROM p.content)
          OR coalesce(n.thread_id, '') <> '' OR coalesce(n.conversation_id, '') <> '') AS ch
       FROM posts p FULL OUTER JOIN incoming_posts n ON n.post_id = p.post_id)
       SELECT coalesce(pid, nid) AS post_id,
        CASE WHEN nid IS NULL THEN NULL WHEN pid IS NULL THEN 'inserted' WHEN ch THEN 'updated' ELSE 'unchanged' END AS change_kind,
        CASE WHEN nid IS NULL THEN pc WHEN pid IS NULL OR ch THEN nc ELSE pc END AS content,
        CASE WHEN nid IS NULL THEN pt WHEN pid IS NULL OR ch THEN nt ELSE pt END AS post_type,
        CASE WHEN nid IS NULL THEN pl WHEN pid IS NULL OR ch THEN nl ELSE pl END AS likes,
        CASE WHEN pid IS NULL THEN nth WHEN ch THEN coalesce(nth, pth) ELSE pth END AS thread_id FROM j""",
)
def upsert_changed(v):
    return M.upsert_if_changed(v.posts, v.incoming_posts).select(
        "post_id", "change_kind", "content", "post_type", "likes", "thread_id"
    )


@query(
    "A6_refresh_posts",
    """SELECT p.post_id, CASE WHEN n.post_id IS NULL THEN p.content ELSE n.content END AS content,
       CASE WHEN n.post_id IS NULL THEN p.reply_to_username ELSE n.reply_to_username END AS reply_to_username,
       CASE WHEN n.post_id IS NULL THEN p.likes ELSE n.likes END AS likes, p.post_type, p.thread_id
       FROM posts p LEFT JOIN incoming_posts n ON n.post_id = p.post_id""",
)
def refresh(v):
    return M.refresh_posts(v.posts, v.incoming_posts).select(
        "post_id", "content", "reply_to_username", "likes", "post_type", "thread_id"
    )


@query(
    "A7_upsert_accounts",
    """WITH n AS (SELECT username, max(CASE WHEN is_pinned THEN concat('https://img.example/new/', username) END) AS pic
         FROM posts GROUP BY username UNION ALL SELECT 'newcomer', 'https://img.example/new/newcomer')
       SELECT coalesce(a.username, n.username) AS username, a.platform,
        coalesce(n.pic, a.profile_pic_url) AS profile_pic_url,
        CASE WHEN n.pic IS NOT NULL THEN '2024-06-01 00:00:00' END AS last_scraped
       FROM accounts a FULL OUTER JOIN (SELECT * FROM n WHERE coalesce(pic, '') <> '') n ON n.username = a.username""",
)
def accounts_upsert(v):
    current = v.accounts.withColumn("profile_pic_updated", F.lit(None).cast("timestamp")).withColumn(
        "last_scraped", F.lit(None).cast("timestamp")
    )
    fresh = v.posts.groupBy("username").agg(
        F.max(F.when(F.col("is_pinned"), F.concat(F.lit("https://img.example/new/"), F.col("username")))).alias("profile_pic_url")
    )
    extra = v.spark.createDataFrame([("newcomer", "https://img.example/new/newcomer")], fresh.schema)
    return M.upsert_accounts(current, fresh.unionByName(extra), as_of()).select(
        "username", "platform", "profile_pic_url", stamp("last_scraped")
    )


NEW_ANALYSES = (
    "SELECT l.doc_id, CAST(l.doc_id - l.doc_id % 3 AS VARCHAR) AS post_id, 'new' AS author_username, "
    "concat('c', CAST(l.doc_id % 4 AS VARCHAR)) AS category, "
    "TIMESTAMP '2024-05-01 00:00:00' + (l.doc_id % 100000) * INTERVAL '1' MINUTE AS analysis_ts FROM labels l"
)


def new_analyses(v):
    return v.raw("labels").selectExpr(
        "CAST(doc_id - doc_id % 3 AS STRING) AS post_id",
        "'new' AS author_username",
        "concat('c', CAST(doc_id % 4 AS STRING)) AS category",
        "TIMESTAMP '2024-05-01 00:00:00' + (doc_id % 100000) * INTERVAL '1' MINUTE AS analysis_ts",
    )


@query(
    "A8_upsert_analyses",
    f"""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY analysis_ts DESC) AS rn FROM ({NEW_ANALYSES}) b) r WHERE rn = 1)
       SELECT post_id, author_username, category, strftime(analysis_ts, '{TS}') AS analysis_ts, local_explanation FROM content_analyses
       WHERE post_id NOT IN (SELECT post_id FROM n)
       UNION ALL SELECT post_id, author_username, category, strftime(analysis_ts, '{TS}'), NULL FROM n""",
)
def analyses_upsert(v):
    return M.upsert_analyses(v.content_analyses, new_analyses(v)).select(
        "post_id", "author_username", "category", stamp("analysis_ts"), "local_explanation"
    )


@query(
    "A9_patch_analyses",
    f"""WITH n AS (SELECT post_id, max(category) AS category FROM ({NEW_ANALYSES}) b GROUP BY post_id)
       SELECT coalesce(a.post_id, n.post_id) AS post_id, coalesce(n.category, a.category) AS category, a.local_explanation,
        a.author_username, strftime(CASE WHEN n.post_id IS NULL THEN a.analysis_ts ELSE TIMESTAMP '2024-06-01 00:00:00' END, '{TS}') AS analysis_ts
       FROM content_analyses a FULL OUTER JOIN n ON n.post_id = a.post_id""",
)
def patch(v):
    changes = new_analyses(v).groupBy("post_id").agg(F.max("category").alias("category"))
    return M.patch_analyses(v.content_analyses, changes, as_of()).select(
        "post_id", "category", "local_explanation", "author_username", stamp("analysis_ts")
    )


@query(
    "A10_upsert_model_results",
    f"""WITH n AS (SELECT post_id, model_name, category, analysis_ts, rn FROM (
         SELECT CAST(doc_id - doc_id % 2 AS VARCHAR) AS post_id, 'm_mid' AS model_name, concat('c', CAST(doc_id % 4 AS VARCHAR)) AS category,
           TIMESTAMP '2024-07-01 00:00:00' + (doc_id % 100000) * INTERVAL '1' MINUTE AS analysis_ts,
           row_number() OVER (PARTITION BY doc_id - doc_id % 2 ORDER BY doc_id DESC) AS rn FROM labels) b WHERE rn = 1)
       SELECT post_id, model_name, category, strftime(analysis_ts, '{TS}') AS analysis_ts, error_message FROM model_analyses m
       WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.post_id = m.post_id AND n.model_name = m.model_name)
       UNION ALL SELECT post_id, model_name, category, strftime(analysis_ts, '{TS}'), NULL FROM n""",
)
def model_upsert(v):
    fresh = v.raw("labels").selectExpr(
        "CAST(doc_id - doc_id % 2 AS STRING) AS post_id",
        "'m_mid' AS model_name",
        "concat('c', CAST(doc_id % 4 AS STRING)) AS category",
        "TIMESTAMP '2024-07-01 00:00:00' + (doc_id % 100000) * INTERVAL '1' MINUTE AS analysis_ts",
    )
    return M.upsert_model_results(v.model_analyses, fresh).select(
        "post_id", "model_name", "category", stamp("analysis_ts"), "error_message"
    )


@query(
    "A11_failed_rows",
    f"""SELECT post_id, model_name, 'ERROR' AS category, 'error' AS analysis_stages,
       concat('Analysis failed: ', error_message, ' ', explanation) AS local_explanation, FALSE AS external_analysis_used,
       '2024-06-01 00:00:00' AS analysis_ts,
       concat('{{"error":"', concat(error_message, ' ', explanation), '","media_urls":0}}') AS analysis_json
       FROM model_analyses WHERE error_message IS NOT NULL""",
)
def failed(v):
    failures = v.model_analyses.filter("error_message IS NOT NULL").select(
        "post_id",
        F.col("model_name").alias("author_username"),
        F.concat_ws(" ", "error_message", "explanation").alias("error_message"),
        F.array().cast("array<string>").alias("media_urls"),
    )
    return M.failed_rows(failures, as_of()).select(
        "post_id", F.col("author_username").alias("model_name"), "category", "analysis_stages", "local_explanation",
        "external_analysis_used", stamp("analysis_ts"), "analysis_json",
    )


@query(
    "A12_set_status",
    """SELECT p.post_id, coalesce(CASE d.toxic WHEN 1 THEN TRUE END, p.is_deleted) AS is_deleted,
       coalesce(CASE d.quality WHEN 1 THEN FALSE END, p.is_edited) AS is_edited
       FROM posts p LEFT JOIN labels d ON CAST(d.doc_id AS VARCHAR) = p.post_id""",
)
def status(v):
    changes = v.raw("labels").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.when(F.col("toxic") == 1, True).alias("is_deleted"),
        F.when(F.col("quality") == 1, False).alias("is_edited"),
    )
    return M.set_status(v.posts, changes).select("post_id", "is_deleted", "is_edited")


EDITS = (
    "SELECT CAST(event_id % 400 AS VARCHAR) AS post_id, CAST(row_number() OVER (PARTITION BY event_id % 400 ORDER BY event_id) AS INTEGER) AS version_number, "
    "props AS previous_content, CAST(ts AS TIMESTAMP) AS detected_at FROM events"
)
NEW_EDITS = (
    "SELECT CAST(event_id % 600 AS VARCHAR) AS post_id, props AS previous_content, CAST(ts AS TIMESTAMP) + INTERVAL '60' DAY AS detected_at "
    "FROM events"
)


def edits(v):
    from pyspark.sql import Window as W

    rows = v.raw("events")
    number = F.row_number().over(W.partitionBy(F.col("event_id") % 400).orderBy("event_id"))
    return rows.select(
        (F.col("event_id") % 400).cast("string").alias("post_id"),
        number.alias("version_number"),
        F.col("props").alias("previous_content"),
        F.col("ts").cast("timestamp").alias("detected_at"),
    )


@query(
    "A13_append_edits",
    f"""WITH e AS ({EDITS}), n AS ({NEW_EDITS}), m AS (SELECT post_id, max(version_number) AS last FROM e GROUP BY post_id)
       SELECT post_id, version_number, previous_content, strftime(detected_at, '{TS}') AS detected_at FROM e
       UNION ALL
       SELECT n.post_id, CAST(coalesce(m.last, 0) + row_number() OVER (PARTITION BY n.post_id ORDER BY n.detected_at, n.previous_content) AS INTEGER),
         n.previous_content, strftime(n.detected_at, '{TS}') FROM n LEFT JOIN m ON m.post_id = n.post_id""",
)
def append(v):
    fresh = v.raw("events").selectExpr(
        "CAST(event_id % 600 AS STRING) AS post_id",
        "props AS previous_content",
        "CAST(ts AS TIMESTAMP) + INTERVAL '60' DAY AS detected_at",
    )
    return M.append_edits(edits(v), fresh).withColumn("detected_at", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss"))


CORRECTIONS = (
    "SELECT post_id, category FROM (SELECT post_id, max(corrected_category) AS category FROM feedback "
    "WHERE corrected_category IS NOT NULL GROUP BY post_id) f"
)


def corrections(v):
    return (
        v.feedback.filter("corrected_category IS NOT NULL")
        .groupBy("post_id")
        .agg(F.max("corrected_category").alias("category"))
    )


@query(
    "A14_manual_override",
    f"""WITH c AS ({CORRECTIONS})
       SELECT coalesce(a.post_id, c.post_id) AS post_id, coalesce(c.category, a.category) AS category,
        CASE WHEN c.post_id IS NULL THEN a.analysis_stages ELSE 'manual' END AS analysis_stages,
        CASE WHEN c.post_id IS NULL THEN a.local_explanation ELSE 'Categoría asignada manualmente por administrador' END AS local_explanation,
        coalesce(a.author_username, p.username) AS author_username
       FROM content_analyses a FULL OUTER JOIN c ON c.post_id = a.post_id LEFT JOIN posts p ON p.post_id = c.post_id
       WHERE a.post_id IS NOT NULL OR p.post_id IS NOT NULL""",
)
def manual(v):
    return M.manual_override(v.content_analyses, v.posts, corrections(v), as_of()).select(
        "post_id", "category", "analysis_stages", "local_explanation", "author_username"
    )


@query(
    "A15_attach_external",
    """WITH x AS (SELECT post_id, max(explanation) AS ext FROM model_analyses WHERE error_message IS NULL GROUP BY post_id)
       SELECT a.post_id, coalesce(x.ext, a.external_explanation) AS external_explanation,
        (x.ext IS NOT NULL OR a.external_analysis_used) AS external_analysis_used,
        CASE WHEN x.ext IS NULL THEN a.analysis_stages WHEN coalesce(a.analysis_stages, '') = '' THEN 'external'
          WHEN list_contains(string_split(a.analysis_stages, ','), 'external') THEN a.analysis_stages
          ELSE concat(a.analysis_stages, ',external') END AS analysis_stages
       FROM content_analyses a LEFT JOIN x ON x.post_id = a.post_id""",
)
def external(v):
    ext = (
        v.model_analyses.filter("error_message IS NULL")
        .groupBy("post_id")
        .agg(F.max("explanation").alias("external_explanation"))
    )
    return M.attach_external(v.content_analyses, ext, as_of()).select(
        "post_id", "external_explanation", "external_analysis_used", "analysis_stages"
    )


FEEDBACK_WALK = """f AS (SELECT id, post_id, user_ip, epoch_us(submitted_at) AS us, CASE WHEN coalesce(post_id, '') = '' THEN 'post_id missing'
     WHEN coalesce(feedback_type, 'correction') = 'correction' AND coalesce(corrected_category, '') = '' THEN 'corrected_category missing'
     WHEN post_id NOT IN (SELECT post_id FROM posts) THEN 'post not found'
     WHEN EXISTS (SELECT 1 FROM stored_feedback s WHERE s.post_id = feedback.post_id AND s.user_ip = feedback.user_ip AND s.submitted_at <= feedback.submitted_at
       AND s.submitted_at > feedback.submitted_at - INTERVAL '1' HOUR) THEN 'already submitted recently' END AS why FROM feedback),
  o AS (SELECT *, concat(post_id, '/', user_ip) AS k, row_number() OVER (PARTITION BY post_id, user_ip ORDER BY us, id) AS rn FROM f WHERE why IS NULL),
  walk AS (SELECT k, rn, id, us AS last, TRUE AS ok FROM o WHERE rn = 1
    UNION ALL SELECT o.k, o.rn, o.id, CASE WHEN o.us - walk.last >= 3600000000 THEN o.us ELSE walk.last END, o.us - walk.last >= 3600000000 FROM walk JOIN o ON o.k = walk.k AND o.rn = walk.rn + 1)"""


@query(
    "A16_accept_feedback",
    f"""WITH RECURSIVE {FEEDBACK_WALK} SELECT f.id, f.post_id, f.user_ip, (f.why IS NULL AND walk.ok) AS accepted,
       CASE WHEN f.why IS NOT NULL THEN f.why WHEN NOT walk.ok THEN 'already submitted recently' END AS reason FROM f LEFT JOIN walk ON walk.id = f.id""",
)
def feedback(v):
    return M.accept_feedback(v.feedback, v.posts, v.stored_feedback).select("id", "post_id", "user_ip", "accepted", "reason")


GONE = "SELECT username FROM accounts WHERE platform = 'telegram'"


@query(
    "A17_delete_account",
    f"""WITH g AS ({GONE}), gp AS (SELECT post_id FROM posts WHERE username IN (SELECT username FROM g))
       SELECT 'accounts' AS table_name, count(*) AS deleted FROM accounts WHERE username IN (SELECT username FROM g)
       UNION ALL SELECT 'posts', count(*) FROM gp
       UNION ALL SELECT 'content_analyses', count(*) FROM content_analyses WHERE post_id IN (SELECT post_id FROM gp) OR author_username IN (SELECT username FROM g)
       UNION ALL SELECT 'model_analyses', count(*) FROM model_analyses WHERE post_id IN (SELECT post_id FROM gp)
       UNION ALL SELECT 'user_feedback', count(*) FROM feedback WHERE post_id IN (SELECT post_id FROM gp)""",
)
def delete(v):
    tables = {
        "accounts": v.accounts, "posts": v.posts, "content_analyses": v.content_analyses,
        "model_analyses": v.model_analyses, "user_feedback": v.feedback,
    }
    _, counts = M.delete_account(tables, v.accounts.filter("platform = 'telegram'").select("username"))
    return counts


@query(
    "A17_delete_account_kept",
    f"""SELECT post_id, model_name FROM model_analyses WHERE post_id NOT IN
        (SELECT post_id FROM posts WHERE username IN ({GONE}))""",
)
def delete_kept(v):
    tables = {"posts": v.posts, "model_analyses": v.model_analyses}
    kept, _ = M.delete_account(tables, v.accounts.filter("platform = 'telegram'").select("username"))
    return kept["model_analyses"].select("post_id", "model_name")


@query(
    "A18_delete_analyses",
    """SELECT post_id, model_name, category FROM model_analyses m WHERE NOT EXISTS
       (SELECT 1 FROM content_analyses a WHERE a.post_id = m.post_id AND a.category = 'general' AND m.model_name = 'm_fast')""",
)
def delete_some(v):
    keys = v.content_analyses.filter("category = 'general'").select("post_id", F.lit("m_fast").alias("model_name"))
    return M.delete_analyses(v.model_analyses, keys).select("post_id", "model_name", "category")


@query(
    "A19_export_csv",
    f"""SELECT a.post_id AS "Post ID", a.author_username AS "Author Username", a.category AS "Category",
       a.local_explanation AS "Local Explanation", a.external_explanation AS "External Explanation",
       a.analysis_stages AS "Analysis Stages", a.external_analysis_used AS "External Analysis Used",
       strftime(a.analysis_ts, '{TS}') AS "Analysis Timestamp", p.content AS "Post Content", p.url AS "Post URL",
       strftime(p.post_ts, '{TS}') AS "Post Timestamp"
       FROM content_analyses a JOIN posts p ON p.post_id = a.post_id""",
)
def csv_rows(v):
    return (
        M.export_rows(v.content_analyses, v.posts)
        .withColumn("Analysis Timestamp", F.date_format("Analysis Timestamp", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("Post Timestamp", F.date_format("Post Timestamp", "yyyy-MM-dd HH:mm:ss"))
    )


@query(
    "A20_export_json",
    """SELECT a.post_id, a.author_username, a.external_analysis_used, p.content AS post_content, p.url AS post_url,
       CASE WHEN json_valid(a.categories_detected) THEN array_to_string(CAST(from_json(CASE WHEN json_valid(a.categories_detected) THEN a.categories_detected ELSE '[]' END, '["VARCHAR"]') AS VARCHAR[]), '|') END AS categories,
       json_extract_string(a.verification_data, '$.overall_verdict') AS overall_verdict,
       CAST(json_extract_string(a.verification_data, '$.total') AS INTEGER) AS total, a.verification_confidence
       FROM content_analyses a LEFT JOIN posts p ON p.post_id = a.post_id""",
)
def json_rows(v):
    rows = M.export_documents(v.content_analyses, v.posts)
    return rows.select(
        "post_id", "author_username", "external_analysis_used", "post_content", "post_url",
        F.array_join("categories_detected", "|").alias("categories"),
        F.try_variant_get("verification_data", "$.overall_verdict", "string").alias("overall_verdict"),
        F.try_variant_get("verification_data", "$.total", "int").alias("total"),
        "verification_confidence",
    )


@query(
    "A20_export_envelope",
    "SELECT '2024-06-01 00:00:00' AS export_timestamp, count(*) AS total_records FROM content_analyses",
)
def envelope(v):
    return M.export_envelope(v.content_analyses, as_of()).select(stamp("export_timestamp"), "total_records")


@query(
    "A21_merge_media",
    """WITH c AS (SELECT post_id, CASE WHEN likes % 3 = 0 THEN ['https://v.example/x.m3u8', 'https://v.example/2'] WHEN likes % 3 = 1 THEN ['https://v.example/new.mp4'] ELSE [] END AS vids FROM posts WHERE likes % 3 < 3),
       j AS (SELECT p.post_id, p.media_links, list_concat(list_filter(list_transform(string_split(coalesce(p.media_links, ''), ','), lambda x: trim(x)), lambda x: x <> ''), list_concat(c.vids[1:1], ['https://q.example/', p.post_id])) AS u
         FROM posts p JOIN c ON c.post_id = p.post_id)
       SELECT post_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ',') AS media_links,
        CAST(len(list_filter(u, lambda x, i: list_position(u, x) = i)) AS INTEGER) AS media_count FROM j""",
)
def media(v):
    captured = v.posts.select(
        "post_id",
        F.expr(
            "CASE likes % 3 WHEN 0 THEN array('https://v.example/x.m3u8', 'https://v.example/2') "
            "WHEN 1 THEN array('https://v.example/new.mp4') ELSE array() END"
        ).alias("video_urls"),
        F.array(F.lit("https://q.example/"), F.col("post_id")).alias("quoted_urls"),
    )
    return M.merge_media(v.posts, captured).select("post_id", "media_links", "media_count")


@query(
    "A22_platforms",
    """SELECT a.username, a.platform, CASE a.platform WHEN 'twitter' THEN 'social_media' WHEN 'telegram' THEN 'messenger' ELSE 'news' END AS platform_category,
       CASE a.platform WHEN 'twitter' THEN 'Twitter/X' WHEN 'telegram' THEN 'Telegram' ELSE 'News Sources' END AS display_name FROM accounts a""",
)
def platform(v):
    return S.with_platform(v.accounts).select("username", "platform", "platform_category", "display_name")
