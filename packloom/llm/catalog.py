"""The ten operator queries and the pipeline, with their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from packloom.llm import jaccard_join, language, licenses, mixing, neighbours, oracles, piece_codec, quality, secrets, sharding, url_rules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Fixed values of the contract.
URL_RULES = [
    url_rules.Rule("allow", "org", "/"),
    url_rules.Rule("block", "example.org", "/es/"),
    url_rules.Rule("block", "example.org", "/en/1"),
    url_rules.Rule("allow", "com", "/fr/"),
    url_rules.Rule("block", "com", "/de/"),
]


#: Where the tokenizer model lies; read on the driver only.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: One text in about so many is also encoded by the sentencepiece library.
PARITY_EVERY = 16
#: A source is read at most this often while every source is read whole.
MIX_TARGET = mixing.Target(repetition=2.0)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), MIX_TARGET)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).drop("rejected_by", "n_marks", "n_bangs")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), wins AS (
  SELECT doc_id, p, array_to_string(w[p:p+7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, p FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), rep AS (
  SELECT doc_id, sum(c) AS n FROM (SELECT doc_id, least(8, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 8)) AS c FROM twice) GROUP BY 1
), f AS (
  SELECT d.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM d LEFT JOIN rep USING (doc_id)
), g AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 5 * n_lines
    OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars OR 2 * len(regexp_extract_all(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]')) > word_chars
    OR 5 * len(regexp_extract_all(text, '!')) > n_words
    OR 100 * len(regexp_extract_all(text, '(?m)(\.\.\.|…)$')) > 30 * n_lines
    OR 100 * len(regexp_extract_all(text, '(?m)^[•*-][\x20\t]')) > 90 * n_lines) AS kept FROM g
"""


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec(_read(spark, sf_dir, "documents"), Path(PIECE_MODEL).read_bytes(), digest=True, parity_every=PARITY_EVERY)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("detections")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, *language.train(docs))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_read(spark, sf_dir, "documents"), 16)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = """
WITH r AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), m AS (
  SELECT page_id, host, path,
    CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""


def queries() -> dict:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_quality_rules": op2_quality_rules,
        "op3_piece_codec": op3_piece_codec,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_license_scans": op5_license_scans,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_language_id": op7_language_id,
        "op8_secret_scans": op8_secret_scans,
        "op9_sharding": op9_sharding,
        "op10_url_filters": op10_url_filters,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {
        "op1_source_mixing": oracles.mixing_sql(MIX_TARGET.repetition, mixing.BLOCK_TOKENS),
        "op2_quality_rules": OP2_SQL,
        "op4_jaccard_join": oracles.jaccard_sql(),
        "op8_secret_scans": oracles.secrets_sql(),
        "op9_sharding": oracles.sharding_sql(16),
        "op10_url_filters": OP10_SQL,
    } | pipeline
