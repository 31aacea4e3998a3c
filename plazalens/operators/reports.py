"""Aggregations and reports. All counts are exact and combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plazalens.functions.tables import ranked
from plazalens.rules.categories import CATEGORIES

LOCAL_MODEL_STAGES = ["local_llm"]


def has_stage(stages: list[str]) -> Column:
    found = F.lit(False)
    for stage in stages:
        found = found | F.col("analysis_stages").contains(stage)
    return F.coalesce(found, F.lit(False))


def overall_stats(posts: DataFrame, analyses: DataFrame) -> DataFrame:
    joined = posts.select("post_id", "username").join(
        analyses.select("post_id", F.lit(True).alias("_hit")), "post_id", "left"
    )
    return joined.agg(
        F.count_distinct("username").alias("accounts"),
        F.count_if(F.coalesce("_hit", F.lit(False))).alias("analyzed_posts"),
    )


def share_of_all(counts: DataFrame, count: str = "n") -> Column:
    """Percentage of the grand total over an aggregated (small) frame."""
    return F.col(count) * F.lit(100.0) / F.sum(count).over(W.partitionBy())


def category_distribution(analyses: DataFrame) -> DataFrame:
    counts = analyses.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", share_of_all(counts)).orderBy(F.col("n").desc(), "category")


def coverage(posts: DataFrame, analyses: DataFrame, local_stages: list[str] | None = None) -> DataFrame:
    labels = analyses.select("post_id", "external_analysis_used", "analysis_stages", F.lit(True).alias("_hit"))
    return posts.select("post_id").join(labels, "post_id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("_hit", F.lit(False))).alias("analyzed"),
        F.count_if(F.coalesce("external_analysis_used", F.lit(False))).alias("external"),
        F.count_if(has_stage(local_stages or LOCAL_MODEL_STAGES)).alias("local_model"),
    )


def analysis_stats(posts: DataFrame, analyses: DataFrame, local_stages: list[str] | None = None) -> DataFrame:
    """Long form: one row per total and one per category."""
    labels = analyses.select("post_id", "external_analysis_used", "analysis_stages", F.lit(True).alias("_hit"))
    totals = posts.select("post_id").join(labels, "post_id", "left").agg(
        F.count_distinct("post_id").alias("posts"),
        F.count_if(F.coalesce("_hit", F.lit(False))).alias("analyzed"),
        F.count_if(has_stage(["pattern"])).alias("pattern"),
        F.count_if(has_stage(local_stages or LOCAL_MODEL_STAGES)).alias("local_model"),
        F.count_if(F.coalesce("external_analysis_used", F.lit(False))).alias("external"),
    )
    names = ["posts", "analyzed", "pattern", "local_model", "external"]
    long = totals.select(
        F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("r")
    ).select("r.*")
    categories = (
        analyses.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count("*").alias("n"))
        .select(F.lit("category").alias("kind"), F.col("category").alias("name"), "n")
    )
    return long.unionByName(categories)


def accounts_with_stats(accounts: DataFrame, posts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Account ranking. Posts are reduced to one row per user before they meet the accounts."""
    labels = analyses.select("post_id", "category", F.lit(True).alias("_hit"))
    per_user = (
        posts.select("post_id", "username", "post_ts")
        .join(labels, "post_id", "left")
        .groupBy("username")
        .agg(
            F.count("*").alias("post_count"),
            F.max("post_ts").alias("last_activity"),
            F.count_if(F.coalesce(F.col("category") != "general", F.lit(False))).alias("problematic_posts"),
            F.count_if(F.coalesce("_hit", F.lit(False))).alias("analyzed_posts"),
        )
    )
    counts = ["post_count", "problematic_posts", "analyzed_posts"]
    joined = accounts.join(per_user, "username", "left")
    for name in counts:
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))
    return joined.orderBy(
        F.col("problematic_posts").desc(), F.col("analyzed_posts").desc(), F.col("post_count").desc(), "username"
    )


def account_activity(posts: DataFrame, as_of: Column, latest: int | None = None, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Per user: activity figures over all or the ``latest`` posts, and daily counts of the last days."""
    newest = posts
    if latest is not None:
        newest = ranked(posts, ["username"], [F.col("post_ts").desc(), F.col("post_id").desc()], latest)
    totals = posts.groupBy("username").agg(F.count("*").alias("total_posts"))
    media = F.coalesce("media_count", F.lit(0))
    basic = newest.groupBy("username").agg(
        F.count_distinct(F.to_date("post_ts")).alias("active_days"),
        F.count_if(media > 0).alias("posts_with_media"),
        F.avg(media).alias("avg_media"),
    )
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("post_ts")) / F.lit(86_400_000_000))
    daily = (
        newest.filter(age <= days)
        .groupBy("username", F.to_date("post_ts").alias("day"))
        .agg(F.count("*").alias("n"))
        .orderBy("username", F.col("day").desc())
    )
    return totals.join(basic, "username"), daily


def user_category_share(analyses: DataFrame) -> DataFrame:
    counts = analyses.groupBy("author_username", F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("n")
    )
    total = F.sum("n").over(W.partitionBy("author_username"))
    return counts.withColumn("total_analyzed", total).withColumn("percentage", F.col("n") * 100.0 / F.col("total_analyzed"))


def category_stats(analyses: DataFrame, local_stages: list[str] | None = None) -> DataFrame:
    return (
        analyses.groupBy("category")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.coalesce("external_analysis_used", F.lit(False))).alias("external"),
            F.count_if(has_stage(local_stages or LOCAL_MODEL_STAGES)).alias("local_model"),
            F.count_distinct("author_username").alias("unique_users"),
        )
        .withColumn("pattern", F.col("total") - F.col("external") - F.col("local_model"))
    )


def top_users(analyses: DataFrame, category: str | None = None, n: int = 10) -> DataFrame:
    """Top users of one category, or of every category."""
    rows = analyses if category is None else analyses.filter(F.col("category") == category)
    counts = rows.groupBy("category", F.col("author_username").alias("username")).agg(F.count("*").alias("post_count"))
    order = [F.col("post_count").desc(), F.col("username")]
    return ranked(counts, ["category"], order, n, "rank")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("feedback_type") == "correction").alias("corrections"),
        F.count_if(F.col("feedback_type") == "flag").alias("flags"),
        F.count_distinct("post_id").alias("unique_posts"),
    )


def recent_fetch(posts: DataFrame, as_of: Column, days: int = 7, n: int = 5) -> DataFrame:
    since = as_of - F.expr(f"INTERVAL '{int(days)}' DAY")
    return (
        posts.filter(F.col("scraped_at") >= since)
        .groupBy("username")
        .agg(F.count("*").alias("post_count"), F.max("scraped_at").alias("latest_scraped"))
        .orderBy(F.col("latest_scraped").desc(), "username")
        .limit(n)
    )


def activity_feed(posts: DataFrame, analyses: DataFrame, feedback: DataFrame, as_of: Column, n: int = 15) -> DataFrame:
    """Latest analyses, feedback and collection rows in one feed."""
    shown = posts.select("post_id", "username", "content")
    stages = F.coalesce("analysis_stages", F.lit("pattern"))
    method = F.when(F.coalesce("external_analysis_used", F.lit(False)), F.concat(stages, F.lit(" (external)"))).otherwise(stages)
    latest = (
        analyses.join(posts.select("post_id"), "post_id", "left_semi")
        .orderBy(F.col("analysis_ts").desc(), F.col("post_id").desc())
        .limit(10)
    )
    analysed = latest.join(shown, "post_id").select(
        F.lit("analysis").alias("activity_type"),
        F.col("analysis_ts").alias("ts"),
        "category",
        method.alias("method"),
        "username",
        F.substring("content", 1, 100).alias("preview"),
        "post_id",
    )
    sent = feedback.orderBy(F.col("submitted_at").desc(), F.col("id").desc()).limit(5)
    comment = F.when(F.coalesce("user_comment", F.lit("")) != "", F.col("user_comment")).otherwise(F.coalesce("content", F.lit("")))
    returned = sent.join(shown, "post_id", "left").select(
        F.lit("feedback").alias("activity_type"),
        F.col("submitted_at").alias("ts"),
        F.concat(
            F.coalesce("original_category", F.lit("None")), F.lit(" → "), F.coalesce("corrected_category", F.lit("None"))
        ).alias("category"),
        F.concat(F.lit("feedback ("), "feedback_type", F.lit(")")).alias("method"),
        F.coalesce("username", F.lit("unknown")).alias("username"),
        F.substring(comment, 1, 100).alias("preview"),
        "post_id",
    )
    fetched = recent_fetch(posts, as_of).select(
        F.lit("fetch").alias("activity_type"),
        F.col("latest_scraped").alias("ts"),
        F.concat(F.lit("Fetched "), F.col("post_count").cast("string"), F.lit(" tweets")).alias("category"),
        F.lit("fetch").alias("method"),
        "username",
        F.concat(F.lit("Content collection from @"), "username").alias("preview"),
        F.lit(None).cast("string").alias("post_id"),
    )
    return (
        analysed.unionByName(returned)
        .unionByName(fetched)
        .orderBy(F.col("ts").desc(), "activity_type", F.col("post_id").desc_nulls_last(), "username")
        .limit(n)
    )


def model_performance(model_analyses: DataFrame, model: str | None = None) -> DataFrame:
    """Per model totals, mean time of good rows, error rate and category map.

    Two-level aggregate: (model, category, ok) first, so a model that produced most
    rows is reduced on the map side.
    """
    rows = model_analyses if model is None else model_analyses.filter(F.col("model_name") == model)
    ok = F.col("error_message").isNull()
    parts = rows.groupBy("model_name", "category", ok.alias("ok")).agg(
        F.count("*").alias("n"),
        F.sum("processing_time_seconds").alias("t"),
        F.count("processing_time_seconds").alias("timed"),
    )
    good = F.col("ok")
    return parts.groupBy("model_name").agg(
        F.sum("n").alias("total_analyses"),
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("successful"),
        F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.try_divide(F.sum(F.when(good, F.col("t"))), F.sum(F.when(good, F.col("timed")))), F.lit(0.0)).alias(
            "avg_processing_time"
        ),
        (F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)) / F.sum("n")).alias("error_rate"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(good & F.col("category").isNotNull(), F.struct("category", "n"))))
        ).alias("category_distribution"),
    )


def consensus(model_analyses: DataFrame) -> DataFrame:
    """Majority label per post over rows without error; ties go to the smaller category."""
    votes = (
        model_analyses.filter(F.col("error_message").isNull())
        .groupBy("post_id", "category")
        .agg(F.count("*").alias("n"))
    )
    # A post has at most one entry per category.
    per_post = votes.groupBy("post_id").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("category"))).alias("_best"),
        F.sum("n").alias("total_models"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("votes"),
    )
    return per_post.select(
        "post_id",
        F.col("_best.category").alias("consensus_category"),
        (-F.col("_best.neg") / F.col("total_models")).alias("agreement_score"),
        "total_models",
        "votes",
    )


def _multi(model_analyses: DataFrame) -> DataFrame:
    good = model_analyses.filter(F.col("error_message").isNull())
    several = good.groupBy("post_id").agg(F.count_distinct("model_name").alias("_m")).filter(F.col("_m") > 1)
    return consensus(model_analyses).join(several.select("post_id"), "post_id", "left_semi")


def agreement(model_analyses: DataFrame) -> DataFrame:
    """Agreement over posts judged by more than one model; empty input gives zeros."""
    score = F.col("agreement_score")
    return _multi(model_analyses).agg(
        F.count("*").alias("total_posts"),
        F.count_if(score == 1.0).alias("full_agreement"),
        F.count_if((score >= 0.5) & (score < 1.0)).alias("partial_agreement"),
        F.count_if(score < 0.5).alias("no_agreement"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_agreement"),
    )


def agreement_by_category(model_analyses: DataFrame) -> DataFrame:
    return _multi(model_analyses).groupBy("consensus_category").agg(F.avg("agreement_score").alias("avg_agreement"))


def category_agreement(analyses: DataFrame, model_analyses: DataFrame, category: str | None = None) -> DataFrame:
    """Agreement of the posts stored under each (or one) consensus category."""
    flagged = analyses.filter(
        (F.col("multi_model_analysis").cast("int") == 1) & F.col("model_consensus_category").isNotNull()
    ).select("post_id", "model_consensus_category")
    if category is not None:
        flagged = flagged.filter(F.col("model_consensus_category") == category)
    votes = consensus(model_analyses).select("post_id", "consensus_category", "agreement_score")
    same = F.col("consensus_category") == F.col("model_consensus_category")
    out = flagged.join(votes, "post_id", "left").groupBy(F.col("model_consensus_category").alias("category")).agg(
        F.count("*").alias("total_posts"),
        F.coalesce(F.avg(F.when(same, F.col("agreement_score"))), F.lit(0.0)).alias("avg_agreement"),
        F.count_if(F.coalesce(same & (F.col("agreement_score") == 1.0), F.lit(False))).alias("full_agreement"),
    )
    return out.withColumn("full_percentage", F.col("full_agreement") * 100.0 / F.col("total_posts"))


def apply_consensus(analyses: DataFrame, posts: DataFrame, model_analyses: DataFrame, as_of: Column) -> DataFrame:
    """Write the consensus of every stored post back as its analysis row."""
    won = consensus(model_analyses).join(posts.select("post_id", "username"), "post_id")
    label = F.col("consensus_category")
    note = F.concat(
        F.lit("Multi-model consensus analysis: "), label,
        F.lit(" (agreement: "), F.format_number("agreement_score", 2), F.lit(")"),
    )
    flag = dict(analyses.dtypes)["multi_model_analysis"]
    rows = won.select(
        "post_id",
        F.col("username").alias("author_username"),
        label.alias("category"),
        note.alias("local_explanation"),
        as_of.alias("analysis_ts"),
        F.lit(1).cast(flag).alias("multi_model_analysis"),
        label.alias("model_consensus_category"),
    )
    kept = analyses.join(rows.select("post_id"), "post_id", "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True).select(*analyses.columns)


def model_summary(model_analyses: DataFrame) -> DataFrame:
    models = model_analyses.agg(F.count_distinct("model_name").alias("total_models"))
    # Both sides are one-row aggregates.
    return agreement(model_analyses).select("total_posts", "avg_agreement").join(F.broadcast(models), F.lit(True))


def collection_stats(progress: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return progress.groupBy("username").agg(
        F.count("*").alias("ranges"),
        F.count_if(done).alias("completed"),
        F.coalesce(F.sum("posts_collected"), F.lit(0)).alias("posts_collected"),
    )


def date_bounds(posts: DataFrame) -> DataFrame:
    day = F.to_date("post_ts")
    return posts.groupBy("username").agg(F.min(day).alias("oldest"), F.max(day).alias("newest"))


def collection_rollup(results: DataFrame) -> DataFrame:
    """Totals of a collection run; error texts are counted, not listed row by row."""
    bad = F.col("status") == "failed"
    parts = results.groupBy(F.when(bad, F.col("error")).alias("error"), bad.alias("bad")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("posts_collected", F.lit(0))).alias("posts")
    )
    return parts.groupBy().agg(
        F.coalesce(F.sum("posts"), F.lit(0)).alias("total_posts"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("windows_completed"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("windows_failed"),
        F.sort_array(F.collect_list(F.when(F.col("bad") & F.col("error").isNotNull(), F.struct("error", "n")))).alias("errors"),
    )


def run_metrics(runs: DataFrame) -> DataFrame:
    """Counts by method, category, model and in total from one pass (grouping sets)."""
    grouped = runs.groupingSets(
        [[F.col("method")], [F.col("category")], [F.col("model")], []], F.col("method"), F.col("category"), F.col("model")
    ).agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("n"),
        F.count_if(F.col("is_multimodal")).alias("multimodal"),
        F.sum("duration").alias("total_time"),
        F.avg("duration").alias("avg_time"),
    )
    kind = F.expr("CASE _set WHEN 3 THEN 'method' WHEN 5 THEN 'category' WHEN 6 THEN 'model' ELSE 'total' END")
    named = grouped.select(
        kind.alias("kind"),
        F.coalesce("method", "category", "model").alias("name"),
        "n", "multimodal", "total_time", "avg_time",
    ).filter((F.col("kind") != "model") | (F.coalesce("name", F.lit("")) != ""))
    total = F.max(F.when(F.col("kind") == "total", F.col("n"))).over(W.partitionBy())
    return named.withColumn("percentage", F.col("n") * 100.0 / total)


# Timed stages in pipeline order.
TIMED_STAGES = ["pattern_detection", "category_detection", "media_analysis", "explanation", "verification"]


def stage_timing(timings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overall and per-stage timing from (post_id, timings map<string,double>)."""
    entries = timings.filter(F.size("timings") > 0).select("post_id", F.explode("timings").alias("stage", "seconds"))
    totals = entries.groupBy("post_id").agg(F.sum("seconds").alias("total"))
    overall = totals.agg(
        F.count("*").alias("posts"),
        F.avg("total").alias("avg_total"),
        F.max("total").alias("max_total"),
        F.min("total").alias("min_total"),
    )
    stages = entries.filter(F.col("stage").isin(TIMED_STAGES)).groupBy("stage").agg(
        F.avg("seconds").alias("avg_seconds"), F.count("*").alias("posts")
    )
    share = F.when(F.col("avg_total") > 0, F.col("avg_seconds") * 100.0 / F.col("avg_total")).otherwise(0.0)
    one_row = overall.select("avg_total", F.col("posts").alias("all_posts"))
    return overall, stages.join(F.broadcast(one_row), F.lit(True)).withColumn("share", share)


def run_summary(results: DataFrame) -> DataFrame:
    counts = results.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", share_of_all(counts)).orderBy("category")


def confusion_matrix(pred: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All category pairs with their counts; ``truth`` is keyed by post_id, ``pred`` by post_id and ``by``, such as
    the model. Every value of ``by`` has its own matrix."""
    pairs = (
        pred.select("post_id", *by, F.col("category").alias("predicted"))
        .join(truth.select("post_id", F.col("category").alias("actual")), "post_id")
        .groupBy(*by, "predicted", "actual")
        .agg(F.count("*").alias("n"))
    )
    spark = pred.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "predicted string")
    grid = names.crossJoin(F.broadcast(names.withColumnRenamed("predicted", "actual")))  # 12 x 12 fixed rows
    if by:
        grid = pred.select(*by).distinct().crossJoin(F.broadcast(grid))
    return grid.join(pairs, [*by, "predicted", "actual"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))


def evaluate(pred: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 per category with the overall accuracy, for each value of ``by``; 0 when undefined."""
    cells = confusion_matrix(pred, truth, by)
    sides = cells.select(
        *by,
        "n",
        F.explode(
            F.array(
                F.struct(F.lit("p").alias("side"), F.col("predicted").alias("category")),
                F.struct(F.lit("a").alias("side"), F.col("actual").alias("category")),
            )
        ).alias("s"),
        (F.col("predicted") == F.col("actual")).alias("hit"),
    )
    per = (
        sides.groupBy(*by, F.col("s.category").alias("category"))
        .agg(
            F.sum(F.when((F.col("s.side") == "p") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("s.side") == "a", F.col("n")).otherwise(0)).alias("actual"),
        )
        .filter(F.col("category").isin(CATEGORIES))
    )
    overall = cells.groupBy(*by).agg(
        F.sum("n").alias("samples"), F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)).alias("_ok")
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("actual")), F.lit(0.0))
    scored = per.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return (
        scored.withColumn("f1", f1)
        .join(F.broadcast(overall), list(by) or F.lit(True))  # a row for each model
        .withColumn("accuracy", F.coalesce(F.try_divide(F.col("_ok"), F.col("samples")), F.lit(0.0)))
        .drop("_ok")
    )


def misclassified(pred: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Wrong rows with both labels; ``truth`` carries the content."""
    return (
        pred.select("post_id", *by, F.col("category").alias("predicted"))
        .join(truth.select("post_id", F.col("category").alias("actual"), "content"), "post_id")
        .filter(F.col("predicted") != F.col("actual"))
    )


def error_pairs(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    counts = errors.groupBy(*by, "predicted", "actual").agg(F.count("*").alias("n"))
    # At most 12 x 12 pairs of each value of ``by`` remain here.
    rank = F.row_number().over(W.partitionBy(*by, F.lit(1)).orderBy(F.col("n").desc(), "predicted", "actual"))
    return counts.withColumn("rank", rank)


def error_patterns(errors: DataFrame, examples: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Per category, and value of ``by``: false positives and negatives, first examples, above-10 % mark."""
    sides = errors.select(
        "post_id",
        *by,
        F.substring("content", 1, 100).alias("example"),
        F.explode(
            F.array(
                F.struct(F.lit("fp").alias("side"), F.col("predicted").alias("category")),
                F.struct(F.lit("fn").alias("side"), F.col("actual").alias("category")),
            )
        ).alias("s"),
    ).select("post_id", *by, "example", "s.side", "s.category")
    counts = sides.groupBy(*by, "category").agg(
        F.count_if(F.col("side") == "fp").alias("false_positives"),
        F.count_if(F.col("side") == "fn").alias("false_negatives"),
        F.count("*").alias("total_errors"),
    )
    first = ranked(sides, [*by, "category", "side"], [F.col("post_id")], examples, "r")
    listed = first.groupBy(*by, "category").agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("r", "example")))), lambda x: x["example"]
            ).alias(f"{side}_examples")
            for side in ("fp", "fn")
        ]
    )
    total = errors.groupBy(*by).agg(F.count("*").alias("_all"))
    return (
        counts.join(listed, [*by, "category"])
        .join(F.broadcast(total), list(by) or F.lit(True))
        .withColumn("high_error", F.col("total_errors") > F.col("_all") * 0.1)
        .drop("_all")
    )


#: Rows of the bucket with the cut that one task may rank.
RANKED_ROWS = 100_000


def split_by_order(rows: DataFrame, order: str, share: float = 0.8, chunks: int = 256) -> DataFrame:
    """Mark the first ``share`` of the rows (by a unique numeric column) as training rows.

    Only the cut value is needed: a histogram over ``chunks`` quantile buckets finds
    the bucket that holds the cut, and that bucket is divided again until few rows are left to rank.
    """
    value = F.col(order)
    inside = rows.select(value.alias("_v")).filter(value.isNotNull())
    place = int(rows.count() * share)
    n = inside.count()
    while n > RANKED_ROWS:
        bounds = inside.agg(F.percentile_approx("_v", [i / chunks for i in range(1, chunks)], 10_000)).first()[0]
        steps = sorted(set(bounds))
        bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda k, b: k + (b < F.col("_v")).cast("int"))
        sizes = sorted((r["_b"], r["_n"]) for r in inside.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n")).collect())  # at most ``chunks``
        for number, size in sizes:
            if place <= size:
                break
            place -= size
        if size == n:  # equal values
            break
        low, high = (steps[number - 1] if number else None), (steps[number] if number < len(steps) else None)
        inside = inside.filter(F.lit(True) if low is None else F.col("_v") > low).filter(F.lit(True) if high is None else F.col("_v") <= high)
        n = size
    last = inside.orderBy("_v").limit(place).agg(F.max("_v")).first()[0] if place > 0 else None
    return rows.withColumn("is_train", F.lit(False) if last is None else F.coalesce(value <= F.lit(last), F.lit(False)))


def split_eval(pred: DataFrame, truth: DataFrame, order: str, share: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy on both parts of the split of ``truth`` and their gap, for each value of ``by``."""
    marked = split_by_order(truth, order, share)
    ok = F.col("predicted") == F.col("actual")
    rows = pred.select("post_id", *by, F.col("category").alias("predicted")).join(
        marked.select("post_id", F.col("category").alias("actual"), "is_train"), "post_id"
    )
    out = rows.groupBy(*by).agg(
        F.count_if(F.col("is_train")).alias("train_rows"),
        F.count_if(~F.col("is_train")).alias("validation_rows"),
        F.coalesce(F.avg(F.when(F.col("is_train"), ok.cast("int"))), F.lit(0.0)).alias("train_accuracy"),
        F.coalesce(F.avg(F.when(~F.col("is_train"), ok.cast("int"))), F.lit(0.0)).alias("validation_accuracy"),
    )
    return out.withColumn("gap", F.col("train_accuracy") - F.col("validation_accuracy"))


def converged(history: DataFrame, threshold: float = 0.005, window: int = 3) -> DataFrame:
    """Per run and iteration: spread of the last accuracies below the threshold?"""
    last = W.partitionBy("run").orderBy("iteration").rowsBetween(-(window - 1), 0)
    spread = F.max("accuracy").over(last) - F.min("accuracy").over(last)
    return history.withColumn("converged", (F.count("*").over(last) >= window) & (spread < threshold))


def extraction_stats(rows: DataFrame) -> DataFrame:
    """Share of parsed pages and mean parse time from (status, seconds)."""
    ok = F.col("status") != "failed"
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.avg(ok.cast("int")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
    )
