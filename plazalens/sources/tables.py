"""Typed loads of the logical tables, thread-column evolution, platform dimension."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plazalens.functions.text import csv_list

SCHEMAS = {
    "accounts": "username string, platform string, profile_pic_url string, profile_pic_updated timestamp, "
    "last_scraped timestamp, created_at timestamp",
    "posts": "post_id string, url string, username string, content string, post_type string, is_pinned boolean, "
    "original_author string, original_post_id string, original_content string, reply_to_username string, "
    "media_links string, media_count int, hashtags string, mentions string, external_links string, likes bigint, "
    "reposts bigint, replies bigint, is_deleted boolean, is_edited boolean, rt_original_analyzed boolean, "
    "post_ts timestamp, scraped_at timestamp, reply_to_post_id string, conversation_id string, thread_id string, "
    "thread_position int, is_thread_start boolean",
    "content_analyses": "post_id string, author_username string, category string, categories_detected string, "
    "local_explanation string, external_explanation string, analysis_stages string, external_analysis_used boolean, "
    "analysis_ts timestamp, media_type string, verification_data string, verification_confidence double, "
    "multi_model_analysis boolean, model_consensus_category string",
    "model_analyses": "post_id string, model_name string, category string, explanation string, "
    "confidence_score double, processing_time_seconds double, analysis_ts timestamp, error_message string",
    "post_edits": "post_id string, version_number int, previous_content string, detected_at timestamp",
    "user_feedback": "id bigint, post_id string, feedback_type string, original_category string, "
    "corrected_category string, user_comment string, user_ip string, submitted_at timestamp",
    "collection_progress": "username string, start_date date, end_date date, status string, "
    "posts_collected int, completed_at timestamp",
}

# Columns added by the later schema version, with their defaults.
THREAD_COLUMNS = {
    "reply_to_post_id": ("string", None),
    "conversation_id": ("string", None),
    "thread_id": ("string", None),
    "thread_position": ("int", 0),
    "is_thread_start": ("boolean", False),
}

# Platform dimension.
PLATFORMS = [
    ("twitter", "social_media", "Twitter", "Twitter/X"),
    ("telegram", "messenger", "Telegram", "Telegram"),
    ("news", "news", "News", "News Sources"),
]


@dataclass(frozen=True)
class Tables:
    """The stored tables; one that does not exist yet is empty."""

    accounts: DataFrame
    posts: DataFrame
    content_analyses: DataFrame
    model_analyses: DataFrame
    post_edits: DataFrame
    user_feedback: DataFrame
    collection_progress: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def load(spark: SparkSession, folder: str) -> Tables:
    """Read every table with its schema; columns a file lacks come back as null."""

    def table(name: str) -> DataFrame:
        try:
            found = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            found = spark.createDataFrame([], SCHEMAS[name])
        return with_thread_columns(found) if name == "posts" else found

    return Tables(**{name: table(name) for name in SCHEMAS})


def with_thread_columns(posts: DataFrame) -> DataFrame:
    """Add the thread columns when absent and fill their defaults."""
    for name, (kind, default) in THREAD_COLUMNS.items():
        if name not in posts.columns:
            posts = posts.withColumn(name, F.lit(default).cast(kind))
        elif default is not None:
            posts = posts.withColumn(name, F.coalesce(F.col(name), F.lit(default).cast(kind)))
    return posts


def with_media_list(posts: DataFrame) -> DataFrame:
    """Decode the comma list of media links."""
    return posts.withColumn("media_urls", csv_list(F.col("media_links")))


def platforms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLATFORMS, "platform_id string, category string, name string, display_name string")


def with_platform(accounts: DataFrame) -> DataFrame:
    """Look the platform of each account up; the dimension is three fixed rows."""
    dim = platforms(accounts.sparkSession).select(
        F.col("platform_id").alias("platform"), F.col("category").alias("platform_category"), "display_name"
    )
    return accounts.join(F.broadcast(dim), "platform", "left")
