"""Table maintenance: batch cleaning, upserts, deletes, edit history, exports.

Every write is "current table in, next table out", keyed by a full outer or anti
join, so applying the same batch twice gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plazalens.functions.limiter import admit
from plazalens.functions.scan import by_width, running
from plazalens.functions.tables import one_per_key, replace_by_key
from plazalens.functions.text import csv_list

# How a stored post reacts to a new copy of it.
THREAD_FIELDS = ["reply_to_post_id", "conversation_id", "thread_id", "thread_position", "is_thread_start"]
INSERT_ONLY = ["username", "url", "post_ts", "reply_to_username"]
REFRESHED = [
    "content", "original_content", "original_author", "original_post_id", "reply_to_username",
    "media_links", "media_count", "likes", "reposts", "replies",
]
COUNTERS = {"media_count", "likes", "reposts", "replies"}
FLAGS = {"is_pinned", "is_thread_start"}
NOT_A_POST = "analytics"
MANUAL_NOTE = "Categoría asignada manualmente por administrador"
FAILURE_PREFIX = "Analysis failed: "
FEEDBACK_SECONDS = 3600


def clean_batch(incoming: DataFrame, order: list[Column], key: str = "post_id") -> DataFrame:
    """Drop rows without a usable id and keep the first row per id."""
    usable = F.col(key).isNotNull() & (F.lower(key) != NOT_A_POST)
    return one_per_key(incoming.filter(usable), [key], order)


def _outer(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with both rows kept as structs (null when a side is missing)."""
    left = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_cur"))
    right = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("_new"))
    return left.join(right, keys, "full_outer")


def _inserted(name: str, value: Column) -> Column:
    if name in COUNTERS:
        return F.coalesce(value, F.lit(0))
    if name in FLAGS:
        return F.coalesce(value, F.lit(False))
    return F.coalesce(value, F.lit("original")) if name == "post_type" else value


def _merged_posts(current: DataFrame, incoming: DataFrame, applies: Column) -> list[Column]:
    out = []
    for name, kind in current.dtypes:
        if name == "post_id":
            out.append(F.col(name))
            continue
        old = F.col(f"_cur.{name}")
        if name not in incoming.columns:
            out.append(old.alias(name))
            continue
        new = F.col(f"_new.{name}").cast(kind)
        if name in INSERT_ONLY:
            updated = old
        elif name in THREAD_FIELDS:
            updated = F.coalesce(new, old)
        else:
            updated = _inserted(name, new)
        chosen = F.when(F.col("_new").isNull(), old).when(F.col("_cur").isNull(), _inserted(name, new))
        out.append(chosen.when(applies, updated).otherwise(old).alias(name))
    return out


def replaced_columns(incoming: list[str]) -> list[str]:
    """Of the incoming columns those whose value an upsert takes without regard to the stored one."""
    return [c for c in incoming if c != "post_id" and c not in INSERT_ONLY and c not in THREAD_FIELDS]


def upsert_posts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Batch upsert; ``incoming`` is unique per post_id (see ``clean_batch``)."""
    return _outer(current, incoming, ["post_id"]).select(*_merged_posts(current, incoming, F.lit(True)))


def upsert_if_changed(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert only rows that differ; adds ``change_kind`` (null for untouched stored rows).

    Columns the incoming rows lack neither count as a difference nor change."""
    changed = ~F.coalesce(F.col("_new.post_type"), F.lit("original")).eqNullSafe(F.col("_cur.post_type"))
    for name in ("original_author", "original_post_id", "content"):
        if name in incoming.columns:
            new = F.col(f"_new.{name}")
            changed = changed | ((F.coalesce(new, F.lit("")) != "") & ~new.eqNullSafe(F.col(f"_cur.{name}")))
    for name in ("thread_id", "conversation_id"):
        if name in incoming.columns:
            changed = changed | (F.coalesce(F.col(f"_new.{name}"), F.lit("")) != "")
    kind = (
        F.when(F.col("_new").isNull(), F.lit(None).cast("string"))
        .when(F.col("_cur").isNull(), "inserted")
        .when(changed, "updated")
        .otherwise("unchanged")
    )
    return _outer(current, incoming, ["post_id"]).select(
        *_merged_posts(current, incoming, changed), kind.alias("change_kind")
    )


def refresh_posts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Forced refresh of known posts; unknown ids are ignored."""
    fields = [c for c in REFRESHED if c in current.columns and c in incoming.columns]
    fresh = incoming.select("post_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = current.join(fresh, "post_id", "left")

    def column(name: str, kind: str) -> Column:
        if name not in fields:
            return F.col(name)
        new = F.col(f"_n_{name}").cast(kind)
        new = F.coalesce(new, F.lit(0)) if name in COUNTERS else new
        return F.when(F.col("_hit"), new).otherwise(F.col(name)).alias(name)

    return joined.select(*[column(c, k) for c, k in current.dtypes])


def upsert_accounts(current: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Set picture and times of accounts; incoming rows without a picture are ignored."""
    fresh = incoming.filter(F.coalesce("profile_pic_url", F.lit("")) != "").select(
        "username", F.col("profile_pic_url").alias("_pic")
    )
    hit = F.col("_pic").isNotNull()
    replaced = {
        "profile_pic_url": F.coalesce("_pic", "profile_pic_url"),
        "profile_pic_updated": F.when(hit, as_of).otherwise(F.col("profile_pic_updated")),
        "last_scraped": F.when(hit, as_of).otherwise(F.col("last_scraped")),
    }
    joined = current.join(fresh, "username", "full_outer")
    return joined.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in current.columns])


def upsert_analyses(current: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Replace whole analysis rows by post_id; the last incoming row of a post wins."""
    last = one_per_key(incoming, ["post_id"], order or [F.col("analysis_ts").desc()])
    return replace_by_key(current, last, ["post_id"])


def upsert_model_results(current: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Replace model results by (post_id, model_name)."""
    keys = ["post_id", "model_name"]
    last = one_per_key(incoming, keys, order or [F.col("analysis_ts").desc()])
    return replace_by_key(current, last, keys)


def patch_analyses(current: DataFrame, patch: DataFrame, as_of: Column) -> DataFrame:
    """Set only the supplied (non-null) columns and restamp; unknown posts are inserted."""
    joined = _outer(current, patch, ["post_id"])

    def column(name: str, kind: str) -> Column:
        if name == "post_id":
            return F.col(name)
        old = F.col(f"_cur.{name}")
        if name == "analysis_ts":
            return F.when(F.col("_new").isNull(), old).otherwise(as_of).alias(name)
        if name in patch.columns:
            return F.coalesce(F.col(f"_new.{name}").cast(kind), old).alias(name)
        return old.alias(name)

    return joined.select(*[column(c, k) for c, k in current.dtypes])


def failed_rows(failures: DataFrame, as_of: Column) -> DataFrame:
    """Analysis rows for failed posts from (post_id, author_username, error_message, media_urls)."""
    message = F.coalesce(F.col("error_message"), F.lit(""))
    return failures.select(
        "post_id",
        "author_username",
        F.lit("ERROR").alias("category"),
        F.lit('["ERROR"]').alias("categories_detected"),
        F.concat(F.lit(FAILURE_PREFIX), message).alias("local_explanation"),
        F.lit("").alias("external_explanation"),
        F.lit("error").alias("analysis_stages"),
        F.lit(False).alias("external_analysis_used"),
        F.lit("").alias("media_type"),
        as_of.alias("analysis_ts"),
        F.to_json(
            F.struct(
                message.alias("error"),
                F.greatest(F.size("media_urls"), F.lit(0)).alias("media_urls"),
            )
        ).alias("analysis_json"),
    )


def set_status(posts: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the deleted / edited flags; a null flag keeps the stored one."""
    new = changes.select("post_id", F.col("is_deleted").alias("_deleted"), F.col("is_edited").alias("_edited"))
    joined = posts.join(new, "post_id", "left")
    replaced = {
        "is_deleted": F.coalesce("_deleted", "is_deleted").alias("is_deleted"),
        "is_edited": F.coalesce("_edited", "is_edited").alias("is_edited"),
    }
    return joined.select(*[replaced.get(c, F.col(c)) for c in posts.columns])


def append_edits(edits: DataFrame, changes: DataFrame) -> DataFrame:
    """Append previous contents with the next version numbers of each post."""
    last = edits.groupBy("post_id").agg(F.max("version_number").alias("_last"))
    order = W.partitionBy("post_id").orderBy("detected_at", "previous_content")
    numbered = changes.withColumn("_n", F.row_number().over(order)).join(last, "post_id", "left")
    fresh = numbered.select(
        "post_id",
        (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int").alias("version_number"),
        "previous_content",
        "detected_at",
    )
    return edits.select(*fresh.columns).unionByName(fresh)


def manual_override(analyses: DataFrame, posts: DataFrame, corrections: DataFrame, as_of: Column) -> DataFrame:
    """Relabel posts by hand: update the analysis, or create it when the post is stored."""
    author = posts.select("post_id", F.col("username").alias("_author"))
    known = corrections.select(
        "post_id",
        F.col("category").alias("_category"),
        (F.col("explanation") if "explanation" in corrections.columns else F.lit(MANUAL_NOTE)).alias("_note"),
    ).join(author, "post_id", "left")
    joined = analyses.withColumn("_stored", F.lit(True)).join(known, "post_id", "full_outer")
    hit = F.col("_category").isNotNull()
    replaced = {
        "category": F.coalesce("_category", "category"),
        "local_explanation": F.when(hit, F.coalesce("_note", F.lit(MANUAL_NOTE))).otherwise(F.col("local_explanation")),
        "analysis_stages": F.when(hit, "manual").otherwise(F.col("analysis_stages")),
        "analysis_ts": F.when(hit, as_of).otherwise(F.col("analysis_ts")),
        "author_username": F.coalesce("author_username", "_author"),
    }
    return joined.filter(F.col("_stored") | F.col("_author").isNotNull()).select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in analyses.columns]
    )


def attach_external(analyses: DataFrame, external: DataFrame, as_of: Column) -> DataFrame:
    """Store external explanations and note the stage once."""
    joined = analyses.join(external.select("post_id", F.col("external_explanation").alias("_ext")), "post_id", "left")
    hit = F.col("_ext").isNotNull()
    stages = F.coalesce(F.col("analysis_stages"), F.lit(""))
    with_stage = (
        F.when(stages == "", F.lit("external"))
        .when(F.array_contains(F.split(stages, ","), "external"), stages)
        .otherwise(F.concat(stages, F.lit(",external")))
    )
    replaced = {
        "external_explanation": F.coalesce("_ext", "external_explanation"),
        "external_analysis_used": hit | F.coalesce("external_analysis_used", F.lit(False)),
        "analysis_stages": F.when(hit, with_stage).otherwise(F.col("analysis_stages")),
        "analysis_ts": F.when(hit, as_of).otherwise(F.col("analysis_ts")),
    }
    return joined.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in analyses.columns])


def accept_feedback(incoming: DataFrame, posts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Decide each feedback row: adds ``accepted`` and ``reason``.

    A row is refused if any stored row of its (post, ip) lies in the hour before it, however that row came
    to be stored. Of the others, one per (post, ip) and hour is accepted; refused rows do not block later ones.
    """
    known = posts.select("post_id").distinct().withColumn("_known", F.lit(True))
    kind = F.coalesce("feedback_type", F.lit("correction"))
    reason = (
        F.when(F.coalesce("post_id", F.lit("")) == "", "post_id missing")
        .when((kind == "correction") & (F.coalesce("corrected_category", F.lit("")) == ""), "corrected_category missing")
        .when(F.col("_known").isNull(), "post not found")
    )
    checked = incoming.join(known, "post_id", "left").withColumn("reason", reason).drop("_known")
    if existing is not None:
        recent = F.when(F.col("reason").isNull() & stored_recently("submitted_at"), "already submitted recently")
        checked = _with_last_stored(checked, existing).withColumn("reason", F.coalesce("reason", recent)).drop("_stored")
    valid = checked.filter(F.col("reason").isNull())
    limited = admit(valid, ["post_id", "user_ip"], "submitted_at", ["id"], F.lit(1), F.lit(FEEDBACK_SECONDS))
    decided = limited.withColumn("reason", F.when(~F.col("admitted"), "already submitted recently")).drop("admitted")
    refused = checked.filter(F.col("reason").isNotNull())
    return decided.unionByName(refused).withColumn("accepted", F.col("reason").isNull())


def stored_recently(at: str) -> Column:
    """Whether the last stored time is less than FEEDBACK_SECONDS before ``at``."""
    return F.coalesce(F.unix_micros(at) - F.col("_stored") < FEEDBACK_SECONDS * 1_000_000, F.lit(False))


def _with_last_stored(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``_stored``: the last time, in microseconds and not after the row, at which its (post, ip) has a stored
    row. A running maximum in chunks of days, so that a busy pair is not one task."""
    keys = {"_post": F.coalesce("post_id", F.lit("")), "_ip": F.coalesce("user_ip", F.lit(""))}
    own = incoming.withColumns(keys).withColumns({"_us": F.unix_micros("submitted_at"), "_was": F.lit(None).cast("long")})
    old = existing.withColumns(keys).select("_post", "_ip", F.unix_micros("submitted_at").alias("_us"), F.unix_micros("submitted_at").alias("_was"))
    both = own.unionByName(old, allowMissingColumns=True)
    order = [F.col("_us"), F.col("_was").isNull()]
    last = running(both, ["_post", "_ip"], order, by_width(F.col("_us"), 86_400_000_000), {"_stored": ("max", F.col("_was"))})
    return last.filter(F.col("_was").isNull()).select(*incoming.columns, "_stored")


def delete_account(tables: dict[str, DataFrame], usernames: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove accounts with everything that hangs on them; also deleted counts per table."""
    names = usernames.select("username").distinct()
    gone = tables["posts"].join(names, "username", "left_semi").select("post_id").distinct()
    kept, counts = {}, []
    for name, table in tables.items():
        if name == "content_analyses":
            by_author = names.withColumnRenamed("username", "author_username")
            drop = table.join(gone, "post_id", "left_semi").select("post_id").unionByName(
                table.join(by_author, "author_username", "left_semi").select("post_id")
            ).distinct()
            keys, side = ["post_id"], drop
        elif "username" in table.columns:
            keys, side = ["username"], names
        else:
            keys, side = ["post_id"], gone
        kept[name] = table.join(side, keys, "left_anti").select(*table.columns)
        counts.append(
            table.join(side, keys, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        )
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    return kept, report


def delete_analyses(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete by post ids, or by (post, model) when the key frame has both columns."""
    on = [c for c in ("post_id", "model_name") if c in keys.columns and c in table.columns]
    return table.join(keys.select(*on).distinct(), on, "left_anti").select(*table.columns)


# Header of the CSV export, with the column each title shows.
CSV_COLUMNS = {
    "Post ID": "post_id", "Author Username": "author_username", "Category": "category",
    "Local Explanation": "local_explanation", "External Explanation": "external_explanation",
    "Analysis Stages": "analysis_stages", "External Analysis Used": "external_analysis_used",
    "Analysis Timestamp": "analysis_ts", "Post Content": "content", "Post URL": "url", "Post Timestamp": "post_ts",
}


def export_rows(analyses: DataFrame, posts: DataFrame) -> DataFrame:
    """The CSV export as a frame, newest analysis first."""
    joined = analyses.join(posts.select("post_id", "content", "url", "post_ts"), "post_id")
    return joined.orderBy(F.col("analysis_ts").desc(), "post_id").select(
        *[F.col(c).alias(title) for title, c in CSV_COLUMNS.items()]
    )


def export_csv(analyses: DataFrame, posts: DataFrame, path: str) -> None:
    export_rows(analyses, posts).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_documents(analyses: DataFrame, posts: DataFrame) -> DataFrame:
    """The JSON export as a frame: every analysis, JSON texts parsed, newest first."""
    joined = analyses.join(posts.select("post_id", "content", "url"), "post_id", "left")
    return joined.orderBy(F.col("analysis_ts").desc(), "post_id").select(
        "post_id", "author_username", "category", "local_explanation", "external_explanation", "analysis_stages",
        F.coalesce("external_analysis_used", F.lit(False)).alias("external_analysis_used"),
        "analysis_ts",
        F.col("content").alias("post_content"),
        F.col("url").alias("post_url"),
        F.from_json("categories_detected", "array<string>").alias("categories_detected"),
        F.try_parse_json("verification_data").alias("verification_data"),
        "verification_confidence",
    )


def export_envelope(analyses: DataFrame, as_of: Column) -> DataFrame:
    return analyses.agg(F.count("*").alias("total_records")).select(as_of.alias("export_timestamp"), "total_records")


def export_json(analyses: DataFrame, posts: DataFrame, path: str, as_of: Column) -> None:
    export_documents(analyses, posts).write.mode("overwrite").json(f"{path}/data")
    export_envelope(analyses, as_of).write.mode("overwrite").json(f"{path}/envelope")


def merge_media(posts: DataFrame, captured: DataFrame) -> DataFrame:
    """Existing links, then at most one captured video, then the quoted post's media."""
    found = captured.select(
        "post_id",
        F.slice("video_urls", 1, 1).alias("_video"),
        (F.col("quoted_urls") if "quoted_urls" in captured.columns else F.array().cast("array<string>")).alias("_quoted"),
    )
    none = F.array().cast("array<string>")
    merged = F.array_distinct(
        F.filter(
            F.concat(csv_list(F.col("media_links")), F.coalesce("_video", none), F.coalesce("_quoted", none)),
            lambda u: u.isNotNull() & (u != ""),
        )
    )
    joined = posts.join(found, "post_id", "left").withColumn("_urls", merged)
    hit = F.col("_video").isNotNull()
    replaced = {
        "media_links": F.when(hit & (F.size("_urls") > 0), F.array_join("_urls", ",")).otherwise(F.col("media_links")),
        "media_count": F.when(hit, F.size("_urls")).otherwise(F.col("media_count")),
    }
    return joined.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in posts.columns])

