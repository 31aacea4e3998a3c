"""Queries for aggregations and reports."""

from pyspark.sql import functions as F

from plazalens.catalog.registry import query
from plazalens.catalog.views import CONSENSUS, stamp
from plazalens.operators import reports as R
from plazalens.rules.categories import CATEGORIES

TS = "%Y-%m-%d %H:%M:%S"


def as_of():
    return F.lit("2024-02-18 00:00:00").cast("timestamp")

AS_OF_SQL = "TIMESTAMP '2024-02-18 00:00:00'"


def r6(name, alias=None):
    return F.round(name, 6).alias(alias or name)


@query(
    "C1_overall_stats",
    """SELECT count(DISTINCT p.username) AS accounts, count(a.post_id) AS analyzed_posts
       FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id""",
)
def overall(v):
    return R.overall_stats(v.posts, v.content_analyses)


@query(
    "C2_category_distribution",
    """SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM content_analyses), 6) AS percentage
       FROM content_analyses GROUP BY category""",
)
def distribution(v):
    return R.category_distribution(v.content_analyses).select("category", "n", r6("percentage"))


@query(
    "C3_coverage",
    """SELECT count(*) AS total, count(a.post_id) AS analyzed, count(*) FILTER (WHERE a.external_analysis_used) AS external,
       count(*) FILTER (WHERE a.analysis_stages LIKE '%local_llm%') AS local_model
       FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id""",
)
def coverage(v):
    return R.coverage(v.posts, v.content_analyses)


@query(
    "C4_analysis_stats",
    """WITH j AS (SELECT p.post_id, a.post_id AS hit, a.analysis_stages AS st, a.external_analysis_used AS ext
         FROM posts p LEFT JOIN content_analyses a ON a.post_id = p.post_id)
       SELECT 'total' AS kind, 'posts' AS name, count(DISTINCT post_id) AS n FROM j
       UNION ALL SELECT 'total', 'analyzed', count(hit) FROM j
       UNION ALL SELECT 'total', 'pattern', count(*) FILTER (WHERE st LIKE '%pattern%') FROM j
       UNION ALL SELECT 'total', 'local_model', count(*) FILTER (WHERE st LIKE '%local_llm%') FROM j
       UNION ALL SELECT 'total', 'external', count(*) FILTER (WHERE ext) FROM j
       UNION ALL SELECT 'category', category, count(*) FROM content_analyses WHERE category IS NOT NULL GROUP BY category""",
)
def stats(v):
    return R.analysis_stats(v.posts, v.content_analyses)


@query(
    "C5_accounts_with_stats",
    f"""SELECT a.username, a.platform, count(p.post_id) AS post_count, strftime(max(p.post_ts), '{TS}') AS last_activity,
       count(*) FILTER (WHERE c.category <> 'general') AS problematic_posts, count(c.post_id) AS analyzed_posts
       FROM accounts a LEFT JOIN posts p ON p.username = a.username LEFT JOIN content_analyses c ON c.post_id = p.post_id
       GROUP BY a.username, a.platform""",
)
def accounts(v):
    return R.accounts_with_stats(v.accounts, v.posts, v.content_analyses).select(
        "username", "platform", "post_count", stamp("last_activity"), "problematic_posts", "analyzed_posts"
    )


@query(
    "C6_account_activity",
    f"""SELECT b.username, t.total_posts, b.active_days, b.posts_with_media, b.avg_media FROM
       (SELECT username, count(DISTINCT CAST(post_ts AS DATE)) AS active_days, count(*) FILTER (WHERE media_count > 0) AS posts_with_media,
          round(avg(media_count), 6) AS avg_media FROM posts GROUP BY username) b
       JOIN (SELECT username, count(*) AS total_posts FROM posts GROUP BY username) t ON t.username = b.username""",
)
def activity(v):
    basic, _ = R.account_activity(v.posts, as_of())
    return basic.select("username", "total_posts", "active_days", "posts_with_media", r6("avg_media"))


@query(
    "C6_recent_activity",
    """SELECT username, CAST(CAST(post_ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM posts
       WHERE floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(post_ts)) / 86400000000) <= 7
       GROUP BY username, CAST(post_ts AS DATE)""",
)
def recent_activity(v):
    _, daily = R.account_activity(v.posts, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return daily.withColumn("day", F.col("day").cast("string"))


@query(
    "C7_user_category_share",
    """SELECT author_username, category, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY author_username) AS BIGINT) AS total_analyzed,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY author_username), 6) AS percentage
       FROM content_analyses GROUP BY author_username, category""",
)
def user_share(v):
    return R.user_category_share(v.content_analyses).select(
        "author_username", "category", "n", "total_analyzed", F.round(F.col("percentage").cast("double"), 6).alias("percentage")
    )


@query(
    "C8_category_stats",
    """SELECT category, count(*) AS total, count(*) FILTER (WHERE external_analysis_used) AS external,
       count(*) FILTER (WHERE analysis_stages LIKE '%local_llm%') AS local_model, count(DISTINCT author_username) AS unique_users,
       count(*) - count(*) FILTER (WHERE external_analysis_used) - count(*) FILTER (WHERE analysis_stages LIKE '%local_llm%') AS pattern
       FROM content_analyses GROUP BY category""",
)
def category_stats(v):
    return R.category_stats(v.content_analyses)


@query(
    "C9_top_users",
    """SELECT category, username, post_count, CAST(rank AS INTEGER) AS rank FROM (SELECT category, author_username AS username, count(*) AS post_count,
       row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, author_username) AS rank
       FROM content_analyses GROUP BY category, author_username) x WHERE rank <= 10""",
)
def top_users(v):
    return R.top_users(v.content_analyses)


@query(
    "C10_feedback_stats",
    """SELECT count(*) AS total, count(*) FILTER (WHERE feedback_type = 'correction') AS corrections,
       count(*) FILTER (WHERE feedback_type = 'flag') AS flags, count(DISTINCT post_id) AS unique_posts FROM feedback""",
)
def feedback(v):
    return R.feedback_stats(v.feedback)


FETCHED = f"""SELECT username, count(*) AS post_count, max(scraped_at) AS latest FROM posts
  WHERE scraped_at >= {AS_OF_SQL} - INTERVAL '7' DAY GROUP BY username ORDER BY latest DESC, username LIMIT 5"""


@query(
    "C11_recent_fetch",
    f"SELECT username, post_count, strftime(latest, '{TS}') AS latest_scraped FROM ({FETCHED}) f",
)
def recent_fetch(v):
    return R.recent_fetch(v.posts, as_of()).select("username", "post_count", stamp("latest_scraped"))


@query(
    "C12_activity_feed",
    f"""WITH al AS (SELECT 'analysis' AS activity_type, a.analysis_ts AS ts, a.category,
          concat(coalesce(a.analysis_stages, 'pattern'), CASE WHEN a.external_analysis_used THEN ' (external)' ELSE '' END) AS method,
          p.username, substring(p.content, 1, 100) AS preview, a.post_id FROM content_analyses a JOIN posts p ON p.post_id = a.post_id
          ORDER BY a.analysis_ts DESC, a.post_id DESC LIMIT 10),
        fl AS (SELECT 'feedback' AS activity_type, f.submitted_at AS ts, concat(coalesce(f.original_category, 'None'), ' → ', coalesce(f.corrected_category, 'None')) AS category,
          concat('feedback (', f.feedback_type, ')') AS method, coalesce(p.username, 'unknown') AS username,
          substring(CASE WHEN coalesce(f.user_comment, '') <> '' THEN f.user_comment ELSE coalesce(p.content, '') END, 1, 100) AS preview, f.post_id
          FROM feedback f LEFT JOIN posts p ON p.post_id = f.post_id ORDER BY f.submitted_at DESC, f.id DESC LIMIT 5),
        ff AS (SELECT 'fetch' AS activity_type, latest AS ts, concat('Fetched ', CAST(post_count AS VARCHAR), ' tweets') AS category, 'fetch' AS method,
          username, concat('Content collection from @', username) AS preview, CAST(NULL AS VARCHAR) AS post_id FROM ({FETCHED}) z)
       SELECT activity_type, strftime(ts, '{TS}') AS ts, category, method, username, preview, post_id FROM
        (SELECT * FROM al UNION ALL SELECT * FROM fl UNION ALL SELECT * FROM ff) u
       ORDER BY u.ts DESC, activity_type, post_id DESC NULLS LAST, username LIMIT 15""",
)
def feed(v):
    return R.activity_feed(v.posts, v.content_analyses, v.feedback, as_of()).select(
        "activity_type", stamp("ts"), "category", "method", "username", "preview", "post_id"
    )


@query(
    "C13_model_performance",
    """SELECT m.model_name, count(*) AS total_analyses, count(*) FILTER (WHERE error_message IS NULL) AS successful,
       count(*) FILTER (WHERE error_message IS NOT NULL) AS failed,
       round(coalesce(avg(processing_time_seconds) FILTER (WHERE error_message IS NULL), 0), 6) AS avg_processing_time,
       round(count(*) FILTER (WHERE error_message IS NOT NULL) / count(*), 6) AS error_rate,
       (SELECT string_agg(concat(category, '=', CAST(n AS VARCHAR)), ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM model_analyses x
          WHERE x.model_name = m.model_name AND x.error_message IS NULL GROUP BY category) g) AS categories
       FROM model_analyses m GROUP BY m.model_name""",
)
def performance(v):
    return R.model_performance(v.model_analyses).select(
        "model_name", "total_analyses", "successful", "failed", r6("avg_processing_time"), r6("error_rate"),
        F.expr("array_join(transform(map_entries(category_distribution), e -> concat(e.key, '=', cast(e.value AS STRING))), ',')").alias("categories"),
    )


@query(
    "C15_consensus",
    f"""WITH {CONSENSUS}, t AS (SELECT post_id, count(*) AS total_models FROM model_analyses WHERE error_message IS NULL GROUP BY post_id),
        m AS (SELECT post_id, string_agg(concat(category, '=', CAST(n AS VARCHAR)), ',' ORDER BY category) AS votes FROM
          (SELECT post_id, category, count(*) AS n FROM model_analyses WHERE error_message IS NULL GROUP BY post_id, category) g GROUP BY post_id)
       SELECT c.post_id, c.consensus_category, round(c.score, 6) AS agreement_score, t.total_models, m.votes
       FROM c JOIN t ON t.post_id = c.post_id JOIN m ON m.post_id = c.post_id WHERE rn = 1""",
)
def consensus(v):
    return R.consensus(v.model_analyses).select(
        "post_id", "consensus_category", r6("agreement_score"), "total_models",
        F.expr("array_join(transform(map_entries(votes), e -> concat(e.key, '=', cast(e.value AS STRING))), ',')").alias("votes"),
    )


SEVERAL = """s AS (SELECT post_id FROM model_analyses WHERE error_message IS NULL GROUP BY post_id HAVING count(DISTINCT model_name) > 1),
  k AS (SELECT c.* FROM c JOIN s ON s.post_id = c.post_id WHERE rn = 1)"""


@query(
    "C16_agreement",
    f"""WITH {CONSENSUS}, {SEVERAL} SELECT count(*) AS total_posts, count(*) FILTER (WHERE score = 1) AS full_agreement,
       count(*) FILTER (WHERE score >= 0.5 AND score < 1) AS partial_agreement, count(*) FILTER (WHERE score < 0.5) AS no_agreement,
       round(avg(score), 6) AS avg_agreement FROM k""",
)
def agreement(v):
    return R.agreement(v.model_analyses).withColumn("avg_agreement", F.round("avg_agreement", 6))


@query(
    "C16_agreement_by_category",
    f"WITH {CONSENSUS}, {SEVERAL} SELECT consensus_category, round(avg(score), 6) AS avg_agreement FROM k GROUP BY consensus_category",
)
def agreement_by_category(v):
    return R.agreement_by_category(v.model_analyses).withColumn("avg_agreement", F.round("avg_agreement", 6))


@query(
    "C17_category_agreement",
    f"""WITH {CONSENSUS} SELECT a.model_consensus_category AS category, count(*) AS total_posts,
       round(coalesce(avg(c.score) FILTER (WHERE c.consensus_category = a.model_consensus_category), 0), 6) AS avg_agreement,
       count(*) FILTER (WHERE c.consensus_category = a.model_consensus_category AND c.score = 1) AS full_agreement,
       round(count(*) FILTER (WHERE c.consensus_category = a.model_consensus_category AND c.score = 1) * 100.0 / count(*), 6) AS full_percentage
       FROM content_analyses a LEFT JOIN c ON c.post_id = a.post_id AND c.rn = 1
       WHERE a.multi_model_analysis = 1 AND a.model_consensus_category IS NOT NULL GROUP BY a.model_consensus_category""",
)
def category_agreement(v):
    return R.category_agreement(v.content_analyses, v.model_analyses).select(
        "category", "total_posts", r6("avg_agreement"), "full_agreement",
        F.round(F.col("full_percentage").cast("double"), 6).alias("full_percentage"),
    )


@query(
    "C18_apply_consensus",
    f"""WITH {CONSENSUS}, w AS (SELECT c.* , p.username FROM c JOIN posts p ON p.post_id = c.post_id WHERE rn = 1)
       SELECT post_id, author_username, category, local_explanation, multi_model_analysis, model_consensus_category, analysis_stages
       FROM content_analyses WHERE post_id NOT IN (SELECT post_id FROM w)
       UNION ALL SELECT post_id, username, consensus_category,
        concat('Multi-model consensus analysis: ', consensus_category, ' (agreement: ', printf('%.2f', score), ')'), 1, consensus_category, NULL FROM w""",
)
def apply_consensus(v):
    return R.apply_consensus(v.content_analyses, v.posts, v.model_analyses, as_of()).select(
        "post_id", "author_username", "category", "local_explanation", "multi_model_analysis", "model_consensus_category", "analysis_stages"
    )


@query(
    "C19_model_summary",
    f"""WITH {CONSENSUS}, {SEVERAL} SELECT count(*) AS total_posts, round(avg(score), 6) AS avg_agreement,
       (SELECT count(DISTINCT model_name) FROM model_analyses) AS total_models FROM k""",
)
def summary(v):
    return R.model_summary(v.model_analyses).withColumn("avg_agreement", F.round("avg_agreement", 6))


@query(
    "C20_collection_stats",
    """SELECT username, count(*) AS ranges, count(*) FILTER (WHERE status = 'completed') AS completed,
       CAST(sum(posts_collected) AS BIGINT) AS posts_collected FROM progress GROUP BY username""",
)
def collection_stats(v):
    return R.collection_stats(v.progress)


@query(
    "C21_date_bounds",
    "SELECT username, CAST(min(CAST(post_ts AS DATE)) AS VARCHAR) AS oldest, CAST(max(CAST(post_ts AS DATE)) AS VARCHAR) AS newest FROM posts GROUP BY username",
)
def bounds(v):
    return R.date_bounds(v.posts).select("username", F.col("oldest").cast("string"), F.col("newest").cast("string"))


@query(
    "C22_collection_rollup",
    """WITH r AS (SELECT posts_collected, status, concat('limit ', CAST(posts_collected % 5 AS VARCHAR)) AS error FROM progress)
       SELECT CAST(sum(posts_collected) AS BIGINT) AS total_posts, count(*) FILTER (WHERE status <> 'failed') AS windows_completed,
       count(*) FILTER (WHERE status = 'failed') AS windows_failed,
       (SELECT string_agg(concat(error, ':', CAST(n AS VARCHAR)), ',' ORDER BY error) FROM (SELECT error, count(*) AS n FROM r WHERE status = 'failed' GROUP BY error) e) AS errors
       FROM r""",
)
def rollup(v):
    results = v.progress.withColumn("error", F.expr("concat('limit ', cast(posts_collected % 5 as string))"))
    return R.collection_rollup(results).select(
        "total_posts", "windows_completed", "windows_failed",
        F.expr("nullif(array_join(transform(errors, e -> concat(e.error, ':', cast(e.n as string))), ','), '')").alias("errors"),
    )


RUNS = """runs AS (SELECT CASE CAST(processing_time_seconds AS INTEGER) % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'llm' ELSE 'external' END AS method,
  category, model_name AS model, processing_time_seconds AS duration, confidence_score > 0.5 AS is_multimodal FROM model_analyses)"""


def metrics_sql(kind, name, group):
    return f"""SELECT '{kind}' AS kind, {name} AS name, count(*) AS n, count(*) FILTER (WHERE is_multimodal) AS multimodal,
      sum(duration) AS total_time, round(avg(duration), 6) AS avg_time, round(count(*) * 100.0 / (SELECT count(*) FROM runs), 6) AS percentage FROM runs {group}"""


@query(
    "C23_run_metrics",
    f"WITH {RUNS} " + " UNION ALL ".join(
        [metrics_sql(k, k, f"GROUP BY {k}") for k in ("method", "category", "model")] + [metrics_sql("total", "CAST(NULL AS VARCHAR)", "")]
    ),
)
def metrics(v):
    runs = v.model_analyses.select(
        F.expr("CASE CAST(processing_time_seconds AS INT) % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'llm' ELSE 'external' END").alias("method"),
        "category",
        F.col("model_name").alias("model"),
        F.col("processing_time_seconds").alias("duration"),
        (F.col("confidence_score") > 0.5).alias("is_multimodal"),
    )
    return R.run_metrics(runs).select(
        "kind", "name", "n", "multimodal", "total_time", r6("avg_time"), F.round(F.col("percentage").cast("double"), 6).alias("percentage")
    )


TIMED = """t AS (SELECT doc_id, 'pattern_detection' AS stage, CAST(doc_id % 5 AS DOUBLE) / 10 AS s FROM labels
  UNION ALL SELECT doc_id, 'explanation', CAST(doc_id % 40 AS DOUBLE) FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'other', CAST(doc_id % 7 AS DOUBLE) FROM labels WHERE toxic = 1)"""


def timings(v):
    return v.raw("labels").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.expr(
            "map_concat(map('pattern_detection', CAST(doc_id % 5 AS DOUBLE) / 10), "
            "CASE WHEN quality = 1 THEN map('explanation', CAST(doc_id % 40 AS DOUBLE)) ELSE CAST(map() AS MAP<STRING, DOUBLE>) END, "
            "CASE WHEN toxic = 1 THEN map('other', CAST(doc_id % 7 AS DOUBLE)) ELSE CAST(map() AS MAP<STRING, DOUBLE>) END)"
        ).alias("timings"),
    )


@query(
    "C24_stage_timing",
    f"""WITH {TIMED}, p AS (SELECT doc_id, sum(s) AS total FROM t GROUP BY doc_id)
       SELECT stage, round(avg(s), 6) AS avg_seconds, count(*) AS posts, (SELECT count(*) FROM p) AS all_posts,
       round((SELECT avg(total) FROM p), 6) AS avg_total, round(avg(s) * 100.0 / (SELECT avg(total) FROM p), 6) AS share
       FROM t WHERE stage <> 'other' GROUP BY stage""",
)
def stage_timing(v):
    _, stages = R.stage_timing(timings(v))
    return stages.select("stage", r6("avg_seconds"), "posts", "all_posts", r6("avg_total"), r6("share"))


@query(
    "C24_total_timing",
    f"""WITH {TIMED}, p AS (SELECT doc_id, sum(s) AS total FROM t GROUP BY doc_id)
       SELECT count(*) AS posts, round(avg(total), 6) AS avg_total, round(max(total), 6) AS max_total, round(min(total), 6) AS min_total FROM p""",
)
def total_timing(v):
    overall, _ = R.stage_timing(timings(v))
    return overall.select("posts", r6("avg_total"), r6("max_total"), r6("min_total"))


@query(
    "C25_run_summary",
    """WITH r AS (SELECT CASE WHEN error_message IS NOT NULL THEN 'ERROR' ELSE category END AS category FROM model_analyses)
       SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM r), 6) AS percentage FROM r GROUP BY category""",
)
def run_summary(v):
    results = v.model_analyses.select(F.expr("CASE WHEN error_message IS NOT NULL THEN 'ERROR' ELSE category END").alias("category"))
    return R.run_summary(results).select("category", "n", r6("percentage"))


PAIRS = """pairs AS (SELECT m.post_id, m.model_name, m.category AS predicted, a.category AS actual, p.content, CAST(m.post_id AS BIGINT) AS num
  FROM model_analyses m JOIN content_analyses a ON a.post_id = m.post_id JOIN posts p ON p.post_id = m.post_id)"""
TRUTH = "truth AS (SELECT a.post_id, CAST(a.post_id AS BIGINT) AS num FROM content_analyses a JOIN posts p ON p.post_id = a.post_id)"
MODELS = "models AS (SELECT DISTINCT model_name FROM model_analyses)"
BY_MODEL = ("model_name",)
NAMES = "cats AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category" for c in CATEGORIES) + ")"


def pred(v):
    return v.model_analyses.select("post_id", "model_name", "category")


def truth(v):
    return v.content_analyses.select("post_id", "category", F.col("post_id").cast("bigint").alias("num")).join(
        v.posts.select("post_id", "content"), "post_id"
    )


@query(
    "C26_evaluate",
    f"""WITH {PAIRS}, {NAMES}, {MODELS}, e AS (SELECT m.model_name, c.category,
         (SELECT count(*) FROM pairs p WHERE p.model_name = m.model_name AND predicted = c.category AND actual = c.category) AS tp,
         (SELECT count(*) FROM pairs p WHERE p.model_name = m.model_name AND predicted = c.category) AS predicted,
         (SELECT count(*) FROM pairs p WHERE p.model_name = m.model_name AND actual = c.category) AS actual FROM models m CROSS JOIN cats c),
        f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, CASE WHEN actual > 0 THEN tp / actual ELSE 0.0 END AS recall FROM e),
        s AS (SELECT model_name, count(*) AS samples, count(*) FILTER (WHERE predicted = actual) AS ok FROM pairs GROUP BY model_name)
       SELECT f.model_name, category, tp, predicted, actual, CAST(round(precision, 6) AS DOUBLE) AS precision, CAST(round(recall, 6) AS DOUBLE) AS recall,
        CAST(CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0 END AS DOUBLE) AS f1,
        samples, round(ok / samples, 6) AS accuracy FROM f JOIN s ON s.model_name = f.model_name""",
)
def evaluate(v):
    return R.evaluate(pred(v), truth(v), BY_MODEL).select(
        "model_name", "category", "tp", "predicted", "actual", r6("precision"), r6("recall"), r6("f1"), "samples", r6("accuracy")
    )


@query(
    "C26_confusion_matrix",
    f"""WITH {PAIRS}, {NAMES}, {MODELS} SELECT m.model_name, p.category AS predicted, a.category AS actual,
       (SELECT count(*) FROM pairs q WHERE q.model_name = m.model_name AND predicted = p.category AND actual = a.category) AS n
       FROM models m CROSS JOIN cats p CROSS JOIN cats a""",
)
def confusion(v):
    return R.confusion_matrix(pred(v), truth(v), BY_MODEL)


@query(
    "C27_error_pairs",
    f"""WITH {PAIRS} SELECT model_name, predicted, actual, count(*) AS n,
        CAST(row_number() OVER (PARTITION BY model_name ORDER BY count(*) DESC, predicted, actual) AS INTEGER) AS rank
       FROM pairs WHERE predicted <> actual GROUP BY model_name, predicted, actual""",
)
def error_pairs(v):
    return R.error_pairs(R.misclassified(pred(v), truth(v), BY_MODEL), BY_MODEL)


@query(
    "C27_error_patterns",
    f"""WITH {PAIRS}, err AS (SELECT * FROM pairs WHERE predicted <> actual),
        s AS (SELECT model_name, predicted AS category, 'fp' AS side, post_id, substring(content, 1, 100) AS ex FROM err
          UNION ALL SELECT model_name, actual, 'fn', post_id, substring(content, 1, 100) FROM err),
        r AS (SELECT *, row_number() OVER (PARTITION BY model_name, category, side ORDER BY post_id) AS rn FROM s)
       SELECT model_name, category, count(*) FILTER (WHERE side = 'fp') AS false_positives, count(*) FILTER (WHERE side = 'fn') AS false_negatives,
        count(*) AS total_errors, count(*) > (SELECT count(*) FROM err WHERE err.model_name = r.model_name) * 0.1 AS high_error,
        coalesce(string_agg(ex, '|' ORDER BY rn) FILTER (WHERE side = 'fp' AND rn <= 3), '') AS fp_examples,
        coalesce(string_agg(ex, '|' ORDER BY rn) FILTER (WHERE side = 'fn' AND rn <= 3), '') AS fn_examples FROM r GROUP BY model_name, category""",
)
def error_patterns(v):
    return R.error_patterns(R.misclassified(pred(v), truth(v), BY_MODEL), by=BY_MODEL).select(
        "model_name", "category", "false_positives", "false_negatives", "total_errors", "high_error",
        F.array_join("fp_examples", "|").alias("fp_examples"), F.array_join("fn_examples", "|").alias("fn_examples"),
    )


@query(
    "C28_split",
    f"""WITH {TRUTH} SELECT post_id, row_number() OVER (ORDER BY num) <= floor((SELECT count(*) FROM truth) * 0.8) AS is_train FROM truth""",
)
def split(v):
    return R.split_by_order(truth(v), "num").select("post_id", "is_train")


@query(
    "C28_split_eval",
    f"""WITH {PAIRS}, {TRUTH}, t AS (SELECT post_id, row_number() OVER (ORDER BY num) <= floor((SELECT count(*) FROM truth) * 0.8) AS tr FROM truth),
        m AS (SELECT pairs.*, t.tr FROM pairs JOIN t ON t.post_id = pairs.post_id)
       SELECT model_name, count(*) FILTER (WHERE tr) AS train_rows, count(*) FILTER (WHERE NOT tr) AS validation_rows,
        round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END) FILTER (WHERE tr), 6) AS train_accuracy,
        round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT tr), 6) AS validation_accuracy FROM m GROUP BY model_name""",
)
def split_eval(v):
    return R.split_eval(pred(v), truth(v), "num", by=BY_MODEL).select(
        "model_name", "train_rows", "validation_rows", r6("train_accuracy"), r6("validation_accuracy")
    )


@query(
    "C28_converged",
    """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS run, CAST(ts AS DATE) AS iteration, round(avg(value), 4) AS accuracy FROM events GROUP BY user_id, CAST(ts AS DATE)),
        w AS (SELECT *, count(*) OVER l AS c, max(accuracy) OVER l - min(accuracy) OVER l AS d FROM h WINDOW l AS (PARTITION BY run ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
       SELECT run, CAST(iteration AS VARCHAR) AS iteration, c >= 3 AND d < 5 AS converged FROM w""",
)
def converged(v):
    history = v.raw("events").groupBy(F.col("user_id").cast("string").alias("run"), F.to_date("ts").alias("iteration")).agg(
        F.round(F.avg("value"), 4).alias("accuracy")
    )
    return R.converged(history, threshold=5).select("run", F.col("iteration").cast("string"), "converged")


@query(
    "C29_extraction_stats",
    """SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed,
       round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 4) AS avg_seconds FROM events""",
)
def extraction(v):
    rows = v.raw("events").select(F.expr("CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END").alias("status"), F.col("value").alias("seconds"))
    return R.extraction_stats(rows).select("total", "successful", "failed", r6("success_rate"), F.round("avg_seconds", 4).alias("avg_seconds"))
