"""The subpackage's registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plazalens.llm import audit, bpe, decontamination, fingerprints, language, linededup, secrets, sharding, simhash, substrings, tokenfiles, toxicity, whitening
from plazalens.llm.common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(ready(spark), folder)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


@query("op1_decontamination")
def op1(spark, folder):
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_toxicity")
def op2(spark, folder):
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


REPEATS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
  x AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 35 THEN string_agg(word, ' ') OVER f END AS win FROM t
    WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
  r AS (SELECT doc_id, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM x),
  c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r)
  SELECT d.doc_id, CAST(count(c.i) AS BIGINT) AS n_words, CAST(count(c.i) FILTER (WHERE c.gone) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op3_substrings", REPEATS)
def op3(spark, folder):
    return substrings.report(table(spark, folder, "documents"))


@query("op4_sharding")
def op4(spark, folder):
    return sharding.shard(table(spark, folder, "documents"))


@query("op5_language")
def op5(spark, folder):
    return language.report(table(spark, folder, "documents"))


@query("op6_token_files")
def op6(spark, folder):
    return tokenfiles.report(table(spark, folder, "documents"))


@query("op7_fingerprints")
def op7(spark, folder):
    return fingerprints.report(table(spark, folder, "documents"))


@query("op8_secrets")
def op8(spark, folder):
    return secrets.report(table(spark, folder, "documents"))


@query("op9_bpe")
def op9(spark, folder):
    return bpe.report(table(spark, folder, "documents"))


@query("op10_simhash")
def op10(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  r AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE holder <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
  FROM k LEFT JOIN r USING (key) GROUP BY doc_id"""


@query("op11_line_dedup", LINES)
def op11(spark, folder):
    return linededup.report(table(spark, folder, "documents"))


@query("op12_whitening")
def op12(spark, folder):
    return whitening.report(table(spark, folder, "embeddings"))


AUDIT = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lowest FROM documents),
  f AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > lowest THEN 16 ELSE 0 END AS fails FROM w),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  d AS (SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
  c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
  b(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o AS (SELECT b1.x || b2.x || b3.x || b4.x || b5.x AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits FROM b b1, b b2, b b3, b b4, b b5
    WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31 AND len(list_distinct([b1.x, b2.x, b3.x, b4.x, b5.x])) = 5),
  s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier FROM o, range(1, 6) AS r(step))
  SELECT part, filter_order, step,
    CAST(sum(CASE WHEN fails & own = 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails & own <> 0 AND fails & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails & own <> 0 AND fails & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fails & own <> 0 AND fails & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN fails & own <> 0 AND fails & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(sum(CASE WHEN fails & own <> 0 AND fails & earlier = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
  FROM c, s GROUP BY part, filter_order, step, own"""


@query("op13_filter_audit", AUDIT)
def op13(spark, folder):
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
