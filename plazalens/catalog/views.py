"""Queries for worklists and joined views."""

from pyspark.sql import functions as F

from plazalens.catalog.maintain import EDITS, edits
from plazalens.catalog.registry import query
from plazalens.operators import views as O

TS = "%Y-%m-%d %H:%M:%S"
MEDIA = "list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "B1_pending_posts",
    """SELECT post_id, username, post_type FROM posts p WHERE NOT (post_type IN ('repost_other', 'repost_own') AND rt_original_analyzed)
       AND NOT EXISTS (SELECT 1 FROM content_analyses a WHERE a.post_id = p.post_id)""",
)
def pending(v):
    return O.pending_posts(v.posts, v.content_analyses).select("post_id", "username", "post_type")


@query(
    "B1_pending_top",
    """SELECT post_id, username FROM posts p WHERE NOT (post_type IN ('repost_other', 'repost_own') AND rt_original_analyzed)
       AND username IN ('src1', 'src2', 'src7') AND NOT EXISTS (SELECT 1 FROM content_analyses a WHERE a.post_id = p.post_id)
       ORDER BY post_id DESC LIMIT 20""",
)
def pending_top(v):
    return O.pending_posts(v.posts, v.content_analyses, ["src1", "src2", "src7"], 20).select("post_id", "username")


@query(
    "B2_all_posts_for_reanalysis",
    """SELECT post_id, username FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY post_ts DESC, post_id DESC) AS rn,
         CASE username WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS turn FROM posts WHERE username IN ('src3', 'src1', 'src9')) x
       WHERE rn <= 7 ORDER BY turn, post_ts DESC, post_id DESC LIMIT 7""",
)
def force(v):
    return O.all_posts_for_reanalysis(v.posts, ["src3", "src1", "src9"], 7).select("post_id", "username")


@query("B2_all_posts", "SELECT post_id, username FROM posts ORDER BY post_ts DESC, post_id DESC LIMIT 50")
def force_all(v):
    return O.all_posts_for_reanalysis(v.posts, None, 50).select("post_id", "username")


@query(
    "B3_multi_model_posts",
    f"""SELECT p.post_id, array_to_string({MEDIA.format('p.media_links')}, '|') AS media,
       coalesce(a.multi_model_analysis, 0) <> 0 AS already_analyzed
       FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id""",
)
def multi_posts(v):
    return O.multi_model_posts(v.posts, v.content_analyses).select(
        "post_id", F.array_join("media_urls", "|").alias("media"), "already_analyzed"
    )


@query(
    "B4_multi_model_pending",
    """SELECT p.post_id, p.username, p.original_content FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id
       WHERE a.multi_model_analysis IS NULL OR a.multi_model_analysis = 0""",
)
def multi_pending(v):
    return O.multi_model_pending(v.posts, v.content_analyses).select("post_id", "username", "original_content")


@query(
    "B4_multi_model_pending_user",
    """SELECT p.post_id, p.username FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id
       WHERE p.username = 'src4' AND (a.multi_model_analysis IS NULL OR a.multi_model_analysis = 0)""",
)
def multi_pending_user(v):
    return O.multi_model_pending(v.posts, v.content_analyses, user="src4").select("post_id", "username")


@query(
    "B5_latest_per_user",
    f"""SELECT post_id, username, strftime(post_ts, '{TS}') AS post_ts, CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER
       (PARTITION BY username ORDER BY post_ts DESC, post_id DESC) AS rn FROM posts) x WHERE rn <= 5""",
)
def latest(v):
    return O.latest_per_user(v.posts, 5).select("post_id", "username", stamp("post_ts"), "position")


@query(
    "B6_recent_posts",
    f"SELECT post_id, strftime(scraped_at, '{TS}') AS scraped_at FROM posts ORDER BY scraped_at DESC, post_id DESC LIMIT 25",
)
def recent(v):
    return O.recent(v.posts, "scraped_at", 25).select("post_id", stamp("scraped_at"))


@query(
    "B6_recent_analyses",
    "SELECT post_id, category FROM content_analyses ORDER BY analysis_ts DESC, post_id DESC LIMIT 25",
)
def recent_analyses(v):
    return O.recent(v.content_analyses, "analysis_ts", 25).select("post_id", "category")


@query(
    "B7_analyses_by_category",
    """SELECT a.post_id, a.category, p.username, p.url FROM content_analyses a JOIN posts p ON p.post_id = a.post_id
       WHERE a.category = 'disinformation' ORDER BY a.analysis_ts DESC, a.post_id DESC LIMIT 10 OFFSET 10""",
)
def by_category(v):
    """The second page, asked by the last row of the first."""
    first = O.analyses_by_category(v.content_analyses, v.posts, "disinformation", 1, 10).select("analysis_ts", "post_id").collect()
    last = first[-1].asDict() if len(first) == 10 else {"analysis_ts": None, "post_id": None}
    return O.analyses_by_category(v.content_analyses, v.posts, "disinformation", per_page=10, last=last).select(
        "post_id", "category", "username", "url"
    )


@query(
    "B8_analyses_by_author",
    """SELECT a.post_id, a.author_username, a.category, p.post_type FROM content_analyses a JOIN posts p ON p.post_id = a.post_id""",
)
def by_author(v):
    return O.analyses_by_author(v.content_analyses, v.posts).select("post_id", "author_username", "category", "post_type")


@query(
    "B9_failed_posts",
    f"""SELECT DISTINCT m.post_id, substring(p.content, 1, 100) AS preview, CAST(len({MEDIA.format('p.media_links')}) AS INTEGER) AS n_media
       FROM model_analyses m LEFT JOIN posts p ON p.post_id = m.post_id WHERE m.error_message IS NOT NULL""",
)
def failed(v):
    rows = (
        v.model_analyses.filter("error_message IS NOT NULL")
        .groupBy("post_id")
        .agg(F.max("analysis_ts").alias("analysis_ts"), F.max("error_message").alias("local_explanation"))
        .withColumn("category", F.lit("ERROR"))
    )
    return O.failed_posts(rows, v.posts).select("post_id", "preview", "n_media")


@query(
    "B10_timeline",
    """WITH s AS (SELECT username, thread_id, count(*) AS n FROM posts WHERE thread_id IS NOT NULL GROUP BY username, thread_id),
        j AS (SELECT p.post_id, p.username, p.thread_id, a.category AS analysis_category,
          row_number() OVER (PARTITION BY p.username ORDER BY (coalesce(a.category, 'general') <> 'general') DESC, p.post_ts DESC, p.post_id DESC) AS position,
          count(*) OVER (PARTITION BY p.username) AS total_filtered
          FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id
          WHERE (p.thread_id IS NULL OR p.thread_position <= 0) AND p.post_type = 'original'
            AND CAST(p.post_ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-25')
       SELECT j.post_id, j.username, j.analysis_category, CAST(j.position AS INTEGER) AS position, j.total_filtered,
        CAST(ceil(j.total_filtered / 3.0) AS INTEGER) AS total_pages, coalesce(s.n, 0) AS thread_post_count, s.n IS NOT NULL AS is_thread_start
       FROM j LEFT JOIN s ON s.username = j.username AND s.thread_id = j.thread_id WHERE position > 3 AND position <= 6""",
)
def timeline(v):
    """Every account's second page, asked by the last rows of its first."""

    def page(**asked):
        posts = v.posts.drop("is_thread_start")
        return O.timeline(posts, v.content_analyses, post_type="original", date_from="2024-01-02", date_to="2024-01-25", per_page=3, **asked)

    first = page().filter("position = 3 OR position = total_filtered")
    rows = page(last=first)
    return rows.select(
        "post_id", "username", "analysis_category", "position", "total_filtered", "total_pages", "thread_post_count", "is_thread_start"
    )


@query(
    "B11_thread_view",
    """SELECT p.post_id, p.thread_id, p.thread_position, a.category FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id
       WHERE p.thread_id IS NOT NULL""",
)
def threads(v):
    return O.thread_view(v.posts, v.content_analyses).select("post_id", "thread_id", "thread_position", "category")


@query(
    "B12_accounts_in_category",
    """SELECT username, platform FROM accounts WHERE username IN (SELECT author_username FROM content_analyses WHERE category = 'hate_speech')""",
)
def accounts(v):
    return O.accounts_in_category(v.accounts, v.content_analyses, "hate_speech").select("username", "platform")


@query(
    "B13_post_versions",
    f"""WITH e AS ({EDITS}), c AS (SELECT post_id, count(*) + 1 AS n FROM e GROUP BY post_id)
       SELECT x.post_id, x.version_number, x.content, x.category, x.is_current, coalesce(c.n, 1) AS total_versions FROM (
        SELECT p.post_id, CAST(NULL AS INTEGER) AS version_number, p.content, a.category, TRUE AS is_current
          FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id
        UNION ALL SELECT e.post_id, e.version_number, e.previous_content, NULL, FALSE FROM e WHERE e.post_id IN (SELECT post_id FROM posts)) x
       LEFT JOIN c ON c.post_id = x.post_id""",
)
def versions(v):
    return O.post_versions(v.posts, v.content_analyses, edits(v))


@query(
    "B14_post_status",
    """WITH i AS (SELECT CAST(page_id * 3 AS VARCHAR) AS post_id FROM pages)
       SELECT i.post_id, p.username, p.post_id IS NOT NULL AS exists, (p.post_id IS NOT NULL AND a.post_id IS NOT NULL) AS analyzed,
        a.category, a.analysis_stages, CASE WHEN p.post_id IS NOT NULL THEN coalesce(a.external_analysis_used, FALSE) END AS external_analysis_used
       FROM i LEFT JOIN posts p ON p.post_id = i.post_id LEFT JOIN content_analyses a ON a.post_id = i.post_id""",
)
def status(v):
    ids = v.raw("pages").selectExpr("CAST(page_id * 3 AS STRING) AS post_id")
    return O.post_status(ids, v.posts, v.content_analyses)


CONSENSUS = """c AS (SELECT post_id, category AS consensus_category, n / CAST(sum(n) OVER (PARTITION BY post_id) AS DOUBLE) AS score,
  row_number() OVER (PARTITION BY post_id ORDER BY n DESC, category) AS rn
  FROM (SELECT post_id, category, count(*) AS n FROM model_analyses WHERE error_message IS NULL GROUP BY post_id, category) g)"""


@query(
    "B15_recent_multi_model",
    f"""WITH {CONSENSUS}
       SELECT a.post_id, a.author_username, p.media_count,
        CASE WHEN length(p.content) > 100 THEN concat(substring(p.content, 1, 100), '...') ELSE p.content END AS content_preview,
        (SELECT string_agg(concat(m.model_name, '=', m.category), ',' ORDER BY m.analysis_ts DESC, m.model_name DESC) FROM model_analyses m WHERE m.post_id = a.post_id) AS results,
        c.consensus_category, round(c.score, 6) AS agreement_score
       FROM content_analyses a JOIN posts p ON p.post_id = a.post_id LEFT JOIN c ON c.post_id = a.post_id AND c.rn = 1
       WHERE a.multi_model_analysis = 1""",
)
def recent_multi(v):
    return O.recent_multi_model(v.posts, v.content_analyses, v.model_analyses).select(
        "post_id", "author_username", "media_count", "content_preview",
        F.array_join(F.transform("model_results", lambda r: F.concat(r["model_name"], F.lit("="), r["category"])), ",").alias("results"),
        "consensus_category", F.round("agreement_score", 6).alias("agreement_score"),
    )


@query(
    "B17_category_page",
    """SELECT a.post_id, CASE WHEN coalesce(a.external_explanation, '') <> '' THEN a.external_explanation ELSE a.local_explanation END AS best_explanation,
       concat(coalesce(a.analysis_stages, 'pattern'), CASE WHEN a.external_analysis_used THEN ' (external)' ELSE '' END) AS display_method
       FROM content_analyses a JOIN posts p ON p.post_id = a.post_id WHERE a.category = 'general'""",
)
def category_page(v):
    return O.category_page(v.content_analyses, v.posts, "general").select("post_id", "best_explanation", "display_method")


@query(
    "B18_feedback_list",
    f"""SELECT f.id, f.post_id, f.feedback_type, p.username, strftime(f.submitted_at, '{TS}') AS submitted_at
       FROM feedback f LEFT JOIN posts p ON p.post_id = f.post_id ORDER BY f.submitted_at DESC, f.id DESC LIMIT 20 OFFSET 20""",
)
def feedback(v):
    """The second page, asked by the last row of the first."""
    first = O.feedback_list(v.feedback, v.posts, 1, 20).select("submitted_at", "id").collect()
    last = first[-1].asDict() if len(first) == 20 else {"submitted_at": None, "id": None}
    return O.feedback_list(v.feedback, v.posts, per_page=20, last=last).select("id", "post_id", "feedback_type", "username", stamp("submitted_at"))


@query(
    "B21_mark_known",
    """SELECT i.post_id, i.username, EXISTS (SELECT 1 FROM posts p WHERE p.post_id = i.post_id AND p.username = i.username) AS known,
       EXISTS (SELECT 1 FROM posts p WHERE (p.post_id = i.post_id AND p.thread_id IS NOT NULL) OR p.thread_id = i.post_id) AS in_thread
       FROM (SELECT post_id, username FROM incoming_posts) i""",
)
def known(v):
    return O.mark_known(v.incoming_posts.select("post_id", "username"), v.posts)
