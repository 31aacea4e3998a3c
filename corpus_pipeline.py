"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language ID: texts without letters, or that no learned language explains, go;
2. near-dedup: SimHash fingerprints meet in the shards of a vantage-point tree; of texts that share 0.8 of their 5-word
   shingles (exact Jaccard), and of groups of such texts, the document with the smallest doc_id stays;
3. benchmark decontamination: documents into which a test item leaks go;
4. secret scans: owner-specific secrets are replaced in the text, copied examples stay;
5. BPE: the ids of every text that is left.

Each stage works on what the stage before it kept. Defined results: null and empty texts have no letters and go at
stage 1; texts are read whole, however long; of rows with equal or nearly equal texts the smallest doc_id stays, a row without
doc_id only where no other has the text, and of repeated rows one; a null ``source`` is an owner of its own at stage 4; an
empty table gives an empty result; other columns pass all stages, whatever their names, but ``ids`` and ``n_tokens``, which
stage 5 sets. Every stage removes the tables it made for itself once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazalens.llm import bpe, decontamination, language, nearcopies, secrets
from plazalens.llm.common import MADE, discard, ready, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return nearcopies.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, table(ready(spark), sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("encode", encode),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        since = len(MADE)
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, since, docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
