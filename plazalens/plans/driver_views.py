"""The logical tables, derived from the driver's parquet tables.

Each view is a projection of a whole driver table (or a join of two). The column
expressions are common SQL text, so the Spark frame and the oracle CTE of a view
have one definition, while the operators under test do not.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazalens.session import spread

ID = "VARCHAR(32)"

_POSTS = {
    "post_id": f"CAST(doc_id AS {ID})",
    "post_num": "doc_id",
    "username": "source",
    "content": "concat(text, ' ', CASE doc_id % 8 "
    "WHEN 0 THEN 'Según datos oficiales el PIB creció un 3% en 2023.' "
    "WHEN 1 THEN 'Todos a las calles, hay que actuar ya.' "
    "WHEN 2 THEN 'La población es de 47 millones de habitantes.' "
    "WHEN 3 THEN 'Las elecciones fueron el 23/07/2023.' "
    "WHEN 4 THEN 'El sistema corrupto y el estado profundo mandan.' ELSE '' END)",
    "url": f"concat('https://x.com/', source, '/status/', CAST(doc_id AS {ID}))",
    "post_type": "CASE doc_id % 10 WHEN 8 THEN 'repost_other' WHEN 9 THEN 'repost_own' ELSE 'original' END",
    "rt_original_analyzed": "(doc_id % 20 = 8)",
    "media_count": "CAST(doc_id % 4 AS INTEGER)",
    "media_links": "CASE doc_id % 4 "
    f"WHEN 1 THEN concat('https://img.example/', CAST(doc_id AS {ID}), '.jpg') "
    f"WHEN 2 THEN concat('https://v.example/', CAST(doc_id AS {ID}), '.mp4, https://img.example/b.png') "
    "WHEN 3 THEN 'https://v.example/x.m3u8,https://v.example/y.mov,,https://v.example/z' END",
    "post_ts": "TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 720) * INTERVAL '1' HOUR",
    "scraped_at": "TIMESTAMP '2024-02-01 00:00:00' + (doc_id % 500) * INTERVAL '1' HOUR",
    "is_pinned": "(doc_id % 50 = 7)",
    "original_author": "CASE doc_id % 10 WHEN 8 THEN 'src1' WHEN 9 THEN source END",
    "original_post_id": f"CASE WHEN doc_id % 10 >= 8 THEN CAST(doc_id - 3 AS {ID}) END",
    "original_content": "CASE WHEN doc_id % 10 = 9 THEN concat('cita ', lang) END",
    "reply_to_username": "CASE doc_id % 5 WHEN 1 THEN source WHEN 2 THEN 'someone' END",
    "is_deleted": "(doc_id % 11 = 3)",
    "is_edited": "(doc_id % 13 = 5)",
    "likes": "n_chars % 97",
    "thread_id": f"CASE WHEN doc_id % 6 < 3 THEN CAST(doc_id - doc_id % 6 AS {ID}) END",
    "conversation_id": f"CASE WHEN doc_id % 6 < 3 THEN CAST(doc_id - doc_id % 6 AS {ID}) END",
    "thread_position": "CAST(CASE WHEN doc_id % 6 < 3 THEN doc_id % 6 ELSE 0 END AS INTEGER)",
    "is_thread_start": "(doc_id % 6 = 0)",
    "reply_to_post_id": f"CASE WHEN doc_id % 6 = 1 OR doc_id % 6 = 2 THEN CAST(doc_id - 1 AS {ID}) END",
}

# A second collection run over the same documents: what the upserts receive.
_INCOMING = {
    "post_id": f"CAST(doc_id + CASE WHEN doc_id % 9 = 0 THEN 1000000000 ELSE 0 END AS {ID})",
    "username": "CASE WHEN doc_id % 18 = 0 THEN concat('new_', source) ELSE source END",
    "content": "CASE doc_id % 7 WHEN 0 THEN concat(text, ' editado') WHEN 1 THEN '' ELSE "
    + _POSTS["content"] + " END",
    "url": _POSTS["url"],
    "post_type": "CASE WHEN doc_id % 14 = 3 THEN 'thread' ELSE " + _POSTS["post_type"] + " END",
    "is_pinned": "(doc_id % 25 = 4)",
    "original_author": "CASE doc_id % 10 WHEN 8 THEN 'src2' WHEN 9 THEN source END",
    "original_post_id": _POSTS["original_post_id"],
    "reply_to_username": "CASE doc_id % 5 WHEN 2 THEN 'changed' END",
    "likes": "n_chars % 97 + 1",
    "media_links": _POSTS["media_links"],
    "media_count": _POSTS["media_count"],
    "post_ts": "TIMESTAMP '2023-12-16 06:00:00' + (doc_id * 7 % 1440) * INTERVAL '1' HOUR",
    "thread_id": f"CASE WHEN doc_id % 12 = 4 THEN CAST(doc_id AS {ID}) END",
    "conversation_id": f"CASE WHEN doc_id % 12 = 4 THEN CAST(doc_id AS {ID}) END",
    "thread_position": "CAST(CASE WHEN doc_id % 12 = 4 THEN 0 END AS INTEGER)",
    "is_thread_start": "CASE WHEN doc_id % 12 = 4 THEN TRUE END",
    "reply_to_post_id": f"CASE WHEN doc_id % 12 = 4 THEN CAST(doc_id - 2 AS {ID}) END",
}

_ANALYSES = {
    "post_id": f"CAST(doc_id AS {ID})",
    "author_username": "source",
    "category": "CASE WHEN toxic = 1 THEN 'hate_speech' WHEN quality = 0 THEN 'disinformation' ELSE 'general' END",
    "categories_detected": """CASE WHEN toxic = 1 THEN '["hate_speech", "disinformation"]' """
    """WHEN quality = 0 THEN '["disinformation"]' WHEN doc_id % 7 = 0 THEN 'broken [' END""",
    "local_explanation": "CASE doc_id % 4 WHEN 0 THEN 'El texto es desinformación clara.' "
    "WHEN 1 THEN 'No contiene desinformación alguna.' WHEN 2 THEN '' ELSE 'Comentario neutro.' END",
    "external_explanation": "CASE doc_id % 3 WHEN 0 THEN 'Se trata de un bulo ya revisado.' WHEN 1 THEN '  ' END",
    "analysis_stages": "CASE doc_id % 4 WHEN 0 THEN 'pattern,local_llm' WHEN 1 THEN 'pattern,category_detection,explanation,external' "
    "WHEN 2 THEN 'pattern' END",
    "external_analysis_used": "(doc_id % 3 = 0)",
    "analysis_ts": "TIMESTAMP '2024-02-01 00:00:00' + (doc_id % 720) * INTERVAL '1' MINUTE",
    "verification_data": f"""CASE WHEN doc_id % 5 = 0 THEN concat('{{"overall_verdict": "debunked", "total": ', CAST(doc_id % 9 AS {ID}), '}}') END""",
    "verification_confidence": "CAST(doc_id % 10 AS DOUBLE) / 10",
    "multi_model_analysis": "CAST(CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INTEGER)",
    "model_consensus_category": "CASE WHEN doc_id % 3 = 0 THEN 'general' END",
}

_MODEL_ANALYSES = {
    "post_id": f"CAST(doc_id AS {ID})",
    "model_name": "model_name",
    "category": "CASE WHEN (doc_id + k) % 5 = 0 THEN 'political_general' WHEN toxic = 1 THEN 'hate_speech' "
    "WHEN quality = 0 THEN 'disinformation' ELSE 'general' END",
    "explanation": f"concat(model_name, ' dice ', CAST(doc_id AS {ID}))",
    "confidence_score": "CAST((doc_id + k) % 10 AS DOUBLE) / 10",
    "processing_time_seconds": "CAST((doc_id * 7 + k * 3) % 90 AS DOUBLE)",
    "analysis_ts": "TIMESTAMP '2024-03-01 00:00:00' + (doc_id % 300) * INTERVAL '1' HOUR + k * INTERVAL '1' MINUTE",
    "error_message": "CASE WHEN (doc_id + k) % 17 = 0 THEN 'timeout' END",
}

_THREAD_POSTS = {
    "post_id": f"concat(CAST(conv_id AS {ID}), '-', CAST(turn AS {ID}))",
    "post_num": "conv_id * 1000 + turn",
    "conv_id": "conv_id",
    "content": "text",
    "username": f"CASE WHEN turn % 4 = 3 THEN concat('other_', role) ELSE concat('u', CAST(conv_id % 10 AS {ID})) END",
    "has_thread_line": "(turn % 4 < 3)",
    "reply_to_post_id": f"CASE WHEN turn > 0 THEN concat(CAST(conv_id AS {ID}), '-', CAST(turn - 1 AS {ID})) END",
}

_EVIDENCE = {
    "post_id": f"CAST(page_id - page_id % 24 AS {ID})",
    "claim_id": "page_id - page_id % 4",
    "evidence_no": "page_id",
    "claim_text": "CASE (page_id - page_id % 4) % 3 WHEN 0 THEN 'La tasa de paro según el informe' "
    "WHEN 1 THEN 'El presidente viajó ayer' ELSE 'Las vacunas y la salud de todos' END",
    "claim_type": "CASE (page_id - page_id % 4) % 5 WHEN 0 THEN 'temporal' ELSE 'numerical' END",
    "source_name": "CASE page_id % 8 WHEN 0 THEN 'Maldita' WHEN 1 THEN 'INE' WHEN 2 THEN 'elpais.com' "
    "WHEN 3 THEN 'Wikipedia (es)' WHEN 4 THEN 'desconocida' WHEN 5 THEN 'Newtral verifica' ELSE concat('sitio ', url) END",
    "source_type": "CASE page_id % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'web_search' WHEN 2 THEN 'fact_checker' ELSE 'official' END",
    "url": "CASE page_id % 10 WHEN 9 THEN '' ELSE url END",
    "title": "regexp_extract(html, '<title>(.*?)</title>', 1)",
    "content_snippet": "concat(regexp_extract(html, '<title>(.*?)</title>', 1), CASE page_id % 6 "
    "WHEN 0 THEN ' Informe oficial con datos oficiales del estudio sobre tasa de paro según' "
    "WHEN 1 THEN ' creo que probablemente' WHEN 2 THEN ' parece opinión, quizás' WHEN 3 THEN ' informe de verificación' ELSE '' END)",
    "publication_date": "CASE WHEN page_id % 9 <> 0 THEN TIMESTAMP '2024-05-30 12:00:00' - (page_id % 1500) * INTERVAL '1' DAY END",
    "verdict": "CASE WHEN page_id % 24 >= 12 THEN CASE page_id % 7 WHEN 1 THEN 'debunked' WHEN 3 THEN 'questionable' ELSE 'verified' END "
    "ELSE CASE page_id % 7 WHEN 0 THEN 'verified' WHEN 3 THEN 'questionable' WHEN 6 THEN 'unverified' ELSE 'debunked' END END",
    "confidence": "CAST(page_id % 10 AS DOUBLE) / 10",
    "credibility_score": "CAST(page_id % 6 AS DOUBLE) / 5",
}

_FEEDBACK = {
    "id": "event_id",
    "post_id": f"CAST(event_id % 1300 AS {ID})",
    "feedback_type": "CASE WHEN event_id % 3 = 0 THEN 'correction' WHEN event_id % 3 = 1 THEN 'flag' ELSE 'praise' END",
    "original_category": "'general'",
    "corrected_category": "CASE WHEN event_id % 6 = 0 THEN 'disinformation' END",
    "user_comment": "props",
    "user_ip": f"CAST(user_id AS {ID})",
    "submitted_at": "CAST(ts AS TIMESTAMP)",
}

# What the table already holds when the feedback above arrives: rows from 20 to 120 minutes earlier.
_STORED_FEEDBACK = _FEEDBACK | {
    "id": "event_id + 1000000000",
    "submitted_at": "CAST(ts AS TIMESTAMP) - (20 + 25 * (event_id % 5)) * INTERVAL '1' MINUTE",
}

_REQUESTS = {
    "event_id": "event_id",
    "key": f"CAST(user_id AS {ID})",
    "endpoint": "event_type",
    "ts": "CAST(ts AS TIMESTAMP)",
    "value": "value",
}

_PROGRESS = {
    "username": f"concat('u', CAST(user_id AS {ID}))",
    "start_date": "CAST(ts AS DATE)",
    "end_date": "CAST(ts AS DATE) + INTERVAL '1' DAY",
    "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' ELSE 'completed' END",
    "posts_collected": "CAST(event_id % 200 AS INTEGER)",
    "completed_at": "CAST(ts AS TIMESTAMP)",
}


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM " + source


_DOCS = "(SELECT doc_id, text, source, lang, n_chars FROM documents)"
_LABELLED = (
    "(SELECT l.doc_id AS doc_id, l.quality AS quality, l.toxic AS toxic, d.source AS source "
    "FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
)
_MODELS = "(SELECT 0 AS k, 'm_fast' AS model_name UNION ALL SELECT 1, 'm_mid' UNION ALL SELECT 2, 'm_large')"
_VOTES = f"(SELECT doc_id, quality, toxic, k, model_name FROM labels CROSS JOIN {_MODELS} m)"

# Oracle CTEs, named as the operators' inputs.
CTES: dict[str, str] = {
    "posts": _select(_POSTS, _DOCS + " d"),
    "incoming_posts": _select(_INCOMING, _DOCS + " d"),
    "content_analyses": _select(_ANALYSES, _LABELLED + " l"),
    "model_analyses": _select(_MODEL_ANALYSES, _VOTES + " v"),
    "thread_posts": _select(_THREAD_POSTS, "conversations"),
    "evidence": _select(_EVIDENCE, "pages"),
    "feedback": _select(_FEEDBACK, "events"),
    "stored_feedback": _select(_STORED_FEEDBACK, "events"),
    "requests": _select(_REQUESTS, "events"),
    "progress": "SELECT username, start_date, CAST(end_date AS DATE) AS end_date, max(status) AS status, "
    "max(posts_collected) AS posts_collected, max(completed_at) AS completed_at FROM ("
    + _select(_PROGRESS, "events")
    + ") e GROUP BY username, start_date, CAST(end_date AS DATE)",
    "accounts": "SELECT username, CASE CAST(length(username) AS INTEGER) % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'news' ELSE 'telegram' END AS platform, "
    "concat('https://img.example/', username, '.png') AS profile_pic_url FROM "
    "(SELECT DISTINCT source AS username FROM documents UNION ALL SELECT 'ghost' AS username) a",
}


def compose(sql: str) -> str:
    """Put the CTEs a query names (and those they name) in front of it."""
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name, body in CTES.items():
            if name != own and name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body, name)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{name} AS ({CTES[name]})" for name in needed)
    head = sql.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {head[14:].lstrip()}"
    return f"WITH {ctes}, {head[4:].lstrip()}" if head.upper().startswith("WITH ") else f"WITH {ctes} {head}"


class Views:
    """The same views as Spark frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, columns: dict[str, str], df: DataFrame) -> DataFrame:
        return df.select(*[F.expr(e.replace(ID, "STRING").replace("VARCHAR", "STRING")).alias(n) for n, e in columns.items()])

    @cached_property
    def posts(self) -> DataFrame:
        return self._view(_POSTS, self.raw("documents"))

    @cached_property
    def texts(self) -> DataFrame:
        """Post texts, spread over the cores when they sit in one small file."""
        return spread(self.posts.select("post_id", "content"))

    @cached_property
    def incoming_posts(self) -> DataFrame:
        return self._view(_INCOMING, self.raw("documents"))

    @cached_property
    def labelled(self) -> DataFrame:
        return self.raw("labels").join(self.raw("documents").select("doc_id", "source"), "doc_id")

    @cached_property
    def content_analyses(self) -> DataFrame:
        return self._view(_ANALYSES, self.labelled)

    @cached_property
    def model_analyses(self) -> DataFrame:
        models = self.spark.createDataFrame([(0, "m_fast"), (1, "m_mid"), (2, "m_large")], "k int, model_name string")
        return self._view(_MODEL_ANALYSES, self.raw("labels").crossJoin(F.broadcast(models)))

    @cached_property
    def thread_posts(self) -> DataFrame:
        return self._view(_THREAD_POSTS, self.raw("conversations"))

    @cached_property
    def evidence(self) -> DataFrame:
        return self._view(_EVIDENCE, self.raw("pages"))

    @cached_property
    def feedback(self) -> DataFrame:
        return self._view(_FEEDBACK, self.raw("events"))

    @cached_property
    def stored_feedback(self) -> DataFrame:
        return self._view(_STORED_FEEDBACK, self.raw("events"))

    @cached_property
    def requests(self) -> DataFrame:
        return self._view(_REQUESTS, self.raw("events"))

    @cached_property
    def progress(self) -> DataFrame:
        rows = self._view(_PROGRESS, self.raw("events")).withColumn("end_date", F.col("end_date").cast("date"))
        return rows.groupBy("username", "start_date", "end_date").agg(
            F.max("status").alias("status"),
            F.max("posts_collected").alias("posts_collected"),
            F.max("completed_at").alias("completed_at"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        names = self.raw("documents").select(F.col("source").alias("username")).distinct()
        ghost = self.spark.createDataFrame([("ghost",)], "username string")
        return names.unionByName(ghost).select(
            "username",
            F.expr("CASE length(username) % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'news' ELSE 'telegram' END").alias("platform"),
            F.expr("concat('https://img.example/', username, '.png')").alias("profile_pic_url"),
        )
