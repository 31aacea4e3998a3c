"""Worklists, selections and joined views over posts and analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalens.functions.tables import ranked
from plazalens.functions.text import csv_list
from plazalens.operators.reports import consensus

REPOSTS = ["repost_other", "repost_own"]


def of_users(df: DataFrame, users: list[str] | None, column: str = "username") -> DataFrame:
    return df if not users else df.filter(F.col(column).isin(users))


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int | None = None) -> DataFrame:
    """Sorted frame, or one page of it (a top-k, not a full sort)."""
    ordered = df.orderBy(*order)
    return ordered if per_page is None else ordered.offset((page - 1) * per_page).limit(per_page)


def beyond(order: list[str], last: dict) -> Column:
    """True for rows that come after the row with the values ``last`` when sorted by ``order``, falling, nulls last.

    A page is asked by the last row of the page before: what was shown is filtered at the scan and not sorted
    again, so any page costs what the first one does.
    """
    out = F.lit(False)
    for name in reversed(order):
        value = last[name] if isinstance(last[name], Column) else F.lit(last[name])
        same = F.col(name).eqNullSafe(value)
        later = value.isNotNull() & (F.col(name).isNull() | (F.col(name) < value))
        out = later | (same & out)
    return F.coalesce(out, F.lit(False))


def page_after(df: DataFrame, order: list[str], last: dict | None, page: int, per_page: int | None) -> DataFrame:
    """The page that follows ``last``, or page number ``page`` where it is not given."""
    falling = [F.col(c).desc_nulls_last() for c in order]
    return page_of(df, falling, page, per_page) if last is None else page_of(df.filter(beyond(order, last)), falling, 1, per_page)


def pending_posts(posts: DataFrame, analyses: DataFrame, users: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Posts without analysis, except reposts whose original is already analysed."""
    done = F.col("post_type").isin(REPOSTS) & F.coalesce("rt_original_analyzed", F.lit(False))
    open_posts = of_users(posts, users).filter(~done).join(analyses.select("post_id"), "post_id", "left_anti")
    return page_of(open_posts, [F.col("post_id").desc()], per_page=n)


def all_posts_for_reanalysis(posts: DataFrame, users: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Every post, newest first. With users the limit counts per user, then in total."""
    newest = [F.col("post_ts").desc(), F.col("post_id").desc()]
    if not users:
        return page_of(posts, newest, per_page=n)
    chosen = of_users(posts, users)
    if n:
        chosen = ranked(chosen, ["username"], newest, n)
    turn = F.array_position(F.array(*[F.lit(u) for u in users]), F.col("username"))
    return page_of(chosen, [turn, *newest], per_page=n)


def _with_analysis(posts: DataFrame, analyses: DataFrame, columns: list[str]) -> DataFrame:
    return posts.join(analyses.select("post_id", *columns, F.lit(True).alias("has_analysis")), "post_id", "left")


def multi_model_posts(posts: DataFrame, analyses: DataFrame, user: str | None = None, n: int | None = None) -> DataFrame:
    joined = _with_analysis(of_users(posts, [user] if user else None), analyses, ["multi_model_analysis"])
    rows = joined.select(
        "post_id",
        "content",
        csv_list(F.col("media_links")).alias("media_urls"),
        (F.coalesce(F.col("multi_model_analysis").cast("int"), F.lit(0)) != 0).alias("already_analyzed"),
        "post_ts",
    )
    return page_of(rows, [F.col("post_ts").desc(), F.col("post_id").desc()], per_page=n)


def multi_model_pending(
    posts: DataFrame,
    analyses: DataFrame,
    user: str | None = None,
    post_id: str | None = None,
    force: bool = False,
    n: int | None = None,
) -> DataFrame:
    """Posts not yet run through several models (flag null or 0)."""
    rows = of_users(posts, [user] if user else None)
    if post_id:
        rows = rows.filter(F.col("post_id") == post_id)
    joined = _with_analysis(rows, analyses, ["multi_model_analysis"])
    if not force and not post_id:
        joined = joined.filter(F.coalesce(F.col("multi_model_analysis").cast("int"), F.lit(0)) == 0)
    out = joined.select(
        "post_id", "url", "username", "content", csv_list(F.col("media_links")).alias("media_urls"), "original_content", "post_ts"
    )
    return page_of(out, [F.col("post_ts").desc(), F.col("post_id").desc()], per_page=None if post_id else n)


def latest_per_user(posts: DataFrame, n: int, users: list[str] | None = None) -> DataFrame:
    return ranked(of_users(posts, users), ["username"], [F.col("post_ts").desc(), F.col("post_id").desc()], n, "position")


def recent(df: DataFrame, ts: str, n: int, key: str = "post_id") -> DataFrame:
    return page_of(df, [F.col(ts).desc_nulls_last(), F.col(key).desc()], per_page=n)


def _analyses_with_posts(analyses: DataFrame, posts: DataFrame) -> DataFrame:
    shown = posts.select("post_id", "content", "url", "username", "post_ts", "post_type", "is_deleted", "is_edited")
    return analyses.join(shown, "post_id")



NEWEST_ANALYSIS = ["analysis_ts", "post_id"]


def newest_analysis() -> list[Column]:
    return [F.col("analysis_ts").desc(), F.col("post_id").desc()]


def analyses_by_category(
    analyses: DataFrame, posts: DataFrame, category: str, page: int = 1, per_page: int | None = None, last: dict | None = None
) -> DataFrame:
    """Newest first; ``last`` has analysis_ts and post_id of the last row of the page before."""
    chosen = analyses.filter(F.col("category") == category)
    return page_after(_analyses_with_posts(chosen, posts), NEWEST_ANALYSIS, last, page, per_page)


def analyses_by_author(analyses: DataFrame, posts: DataFrame, authors: list[str] | None = None) -> DataFrame:
    chosen = of_users(analyses, authors, "author_username")
    return _analyses_with_posts(chosen, posts).orderBy("author_username", *newest_analysis())


def failed_posts(analyses: DataFrame, posts: DataFrame, n: int | None = None) -> DataFrame:
    """Posts whose analysis failed, with a 100-character preview and media count."""
    rows = analyses.filter(F.col("category") == "ERROR").select("post_id", "local_explanation", "analysis_ts")
    shown = posts.select(
        "post_id",
        "username",
        F.substring("content", 1, 100).alias("preview"),
        F.size(csv_list(F.col("media_links"))).alias("n_media"),
    )
    return page_of(rows.join(shown, "post_id", "left"), newest_analysis(), per_page=n)


def timeline(
    posts: DataFrame,
    analyses: DataFrame,
    users: list[str] | None = None,
    category: str | None = None,
    post_type: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    page: int = 1,
    per_page: int = 20,
    last: DataFrame | None = None,
) -> DataFrame:
    """One page of every account's timeline, with totals.

    Thread continuations are hidden, starts carry the thread size (counted before
    any filter), non-general posts come first, then the newest. ``last`` has the last row of every account's page before
    (username, flagged, post_ts, post_id, position); an account that it lacks starts at its first post. Only
    ``per_page`` rows of an account are kept by any task then, whichever page it is.
    """
    own = of_users(posts, users)
    sizes = own.filter(F.col("thread_id").isNotNull()).groupBy("username", "thread_id").agg(F.count("*").alias("_size"))
    day = F.to_date("post_ts")
    shown = own.filter(F.col("thread_id").isNull() | (F.coalesce("thread_position", F.lit(0)) <= 0))
    if post_type and post_type != "all":
        shown = shown.filter(F.col("post_type") == post_type)
    if date_from:
        shown = shown.filter(day >= F.lit(date_from).cast("date"))
    if date_to:
        shown = shown.filter(day <= F.lit(date_to).cast("date"))
    labels = analyses.select("post_id", F.col("category").alias("analysis_category"), "local_explanation", "external_explanation")
    if category and category != "all":
        joined = shown.join(labels.filter(F.col("analysis_category") == category), "post_id")
    else:
        joined = shown.join(labels, "post_id", "left")
    totals = joined.groupBy("username").agg(F.count("*").alias("total_filtered"))
    joined = joined.withColumn("flagged", F.coalesce("analysis_category", F.lit("general")) != "general")
    names = ["flagged", "post_ts", "post_id"]
    order = [F.col(c).desc_nulls_last() for c in names]
    if last is None:
        rows = ranked(joined, ["username"], order, page * per_page, "position").filter(F.col("position") > (page - 1) * per_page)
    else:
        marks = last.select("username", F.col("position").alias("_before"), *[F.col(c).alias(f"_last_{c}") for c in names])
        left = joined.join(marks, "username", "left")
        left = left.filter(F.col("_before").isNull() | beyond(names, {c: F.col(f"_last_{c}") for c in names}))
        rows = ranked(left, ["username"], order, per_page, "position")
        rows = rows.withColumn("position", F.col("position") + F.coalesce("_before", F.lit(0))).drop("_before", *[f"_last_{c}" for c in names])
    return (
        rows.join(sizes, ["username", "thread_id"], "left")
        .join(totals, "username")
        .withColumn("thread_post_count", F.coalesce("_size", F.lit(0)))
        .withColumn("is_thread_start", F.col("_size").isNotNull())
        .withColumn("total_pages", F.ceil(F.col("total_filtered") / per_page).cast("int"))
        .drop("_size")
    )


def thread_view(posts: DataFrame, analyses: DataFrame, threads: list[str] | None = None) -> DataFrame:
    own = posts.filter(F.col("thread_id").isNotNull())
    if threads:
        own = own.filter(F.col("thread_id").isin(threads))
    labels = analyses.select("post_id", "category", "local_explanation", "external_explanation")
    return own.join(labels, "post_id", "left").orderBy("thread_id", "thread_position", "post_ts", "post_id")


def accounts_in_category(accounts: DataFrame, analyses: DataFrame, category: str) -> DataFrame:
    authors = analyses.filter(F.col("category") == category).select(F.col("author_username").alias("username"))
    return accounts.join(authors, "username", "left_semi")


def post_versions(posts: DataFrame, analyses: DataFrame, edits: DataFrame) -> DataFrame:
    """Current row (no version number) and the stored versions, newest first."""
    counts = edits.groupBy("post_id").agg((F.count("*") + 1).alias("_n"))
    current = posts.select("post_id", "content", "username").join(analyses.select("post_id", "category"), "post_id", "left")
    now = current.select(
        "post_id", F.lit(None).cast("int").alias("version_number"), "content", "category", F.lit(True).alias("is_current")
    )
    old = edits.join(posts.select("post_id"), "post_id", "left_semi").select(
        "post_id", "version_number", F.col("previous_content").alias("content"),
        F.lit(None).cast("string").alias("category"), F.lit(False).alias("is_current"),
    )
    return (
        now.unionByName(old)
        .join(counts, "post_id", "left")
        .withColumn("total_versions", F.coalesce("_n", F.lit(1)))
        .drop("_n")
        .orderBy("post_id", F.col("version_number").desc_nulls_first())
    )


def post_status(ids: DataFrame, posts: DataFrame, analyses: DataFrame) -> DataFrame:
    stored = posts.select("post_id", "username", F.lit(True).alias("_stored"))
    labels = analyses.select("post_id", "category", "analysis_stages", "external_analysis_used", F.lit(True).alias("_analyzed"))
    on = F.col("_stored")
    return (
        ids.select("post_id")
        .join(stored, "post_id", "left")
        .join(labels, "post_id", "left")
        .select(
            "post_id",
            "username",
            F.coalesce("_stored", F.lit(False)).alias("exists"),
            (F.coalesce("_stored", F.lit(False)) & F.coalesce("_analyzed", F.lit(False))).alias("analyzed"),
            F.when(on, F.col("category")).alias("category"),
            F.when(on, F.col("analysis_stages")).alias("analysis_stages"),
            F.when(on, F.coalesce("external_analysis_used", F.lit(False))).alias("external_analysis_used"),
        )
    )


def recent_multi_model(
    posts: DataFrame,
    analyses: DataFrame,
    model_analyses: DataFrame,
    page: int = 1,
    per_page: int | None = None,
    post_ids: list[str] | None = None,
) -> DataFrame:
    """Multi-model posts with every model's result (newest first) and the consensus."""
    flagged = analyses.filter(F.col("multi_model_analysis").cast("int") == 1)
    if post_ids:
        flagged = flagged.filter(F.col("post_id").isin(post_ids))
    shown = posts.select(
        "post_id", "content", "url", "media_links", "media_count",
        F.col("original_content").alias("quoted_content"), F.col("original_author").alias("quoted_author"),
    )
    chosen = page_of(
        flagged.select("post_id", "author_username", "model_consensus_category", "analysis_ts").join(shown, "post_id"),
        newest_analysis(), page, per_page,
    )
    # One row per model: the list of a post is as long as the model catalogue.
    results = model_analyses.groupBy("post_id").agg(
        F.sort_array(
            F.collect_list(F.struct("analysis_ts", "model_name", "category", "confidence_score", "error_message")), asc=False
        ).alias("model_results")
    )
    return (
        chosen.join(results, "post_id", "left")
        .join(consensus(model_analyses), "post_id", "left")
        .withColumn(
            "content_preview",
            F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content")),
        )
        .withColumn("media_urls", csv_list(F.col("media_links")))
    )


def category_page(
    analyses: DataFrame, posts: DataFrame, category: str, page: int = 1, per_page: int | None = None, last: dict | None = None
) -> DataFrame:
    """Posts of a category with the explanation to show and how it was found."""
    external = F.col("external_explanation")
    stages = F.coalesce("analysis_stages", F.lit("pattern"))
    return (
        analyses_by_category(analyses, posts, category, page, per_page, last)
        .withColumn("best_explanation", F.when(F.coalesce(external, F.lit("")) != "", external).otherwise(F.col("local_explanation")))
        .withColumn(
            "display_method",
            F.when(F.coalesce("external_analysis_used", F.lit(False)), F.concat(stages, F.lit(" (external)"))).otherwise(stages),
        )
    )


def feedback_list(feedback: DataFrame, posts: DataFrame, page: int = 1, per_page: int | None = None, last: dict | None = None) -> DataFrame:
    """Newest first; ``last`` has submitted_at and id of the last row of the page before. A page is cut before
    posts are looked up."""
    order = ["submitted_at", "id"]
    rows = page_after(feedback, order, last, page, per_page)
    joined = rows.join(posts.select("post_id", "username", "content"), "post_id", "left")
    return joined.orderBy(*[F.col(c).desc_nulls_last() for c in order])


def mark_known(ids: DataFrame, posts: DataFrame) -> DataFrame:
    """Per (username, post_id): stored for that user? part of a collected thread?"""
    stored = posts.select("post_id", "username").distinct().withColumn("_known", F.lit(True))
    own = posts.filter(F.col("thread_id").isNotNull()).select("post_id")
    starts = posts.filter(F.col("thread_id").isNotNull()).select(F.col("thread_id").alias("post_id"))
    threaded = own.unionByName(starts).distinct().withColumn("_threaded", F.lit(True))
    return (
        ids.join(stored, ["post_id", "username"], "left")
        .join(threaded, "post_id", "left")
        .withColumn("known", F.coalesce("_known", F.lit(False)))
        .withColumn("in_thread", F.coalesce("_threaded", F.lit(False)))
        .drop("_known", "_threaded")
    )
