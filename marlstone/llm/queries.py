"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, new_path
from . import decontam, langid, lm, pieces, pii, quality, shards, simhash, tokencounts, urlfilter

Query = Callable[[SparkSession, str], DataFrame]
N_SHARDS = 24
#: ``host/path`` and verdict.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def piece_model() -> str:
    """Path of the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(documents(spark, sf_dir), piece_model(), packed=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.assign(documents(spark, sf_dir), [1.0] * N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    found = pii.find(rows, pii.train(rows))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(F.encode(pii.joined(F.col("base")), "UTF-8"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.joined(F.concat("base", "added")).alias("spans"))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(rows.where("not held_out"))
    return langid.identify(rows, model, carry=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads every row, a fifth of them under counts that are revised later and in a source that they leave, then deletes and inserts a fifth again.

    The batches net to the table; one comes twice.  Tokens are counted once, into a table that the batches read.
    """
    rollup = tokencounts.Rollup(spark, new_path(spark, "rollup"))
    counted = cut(tokencounts.counted(documents(spark, sf_dir), {"piece_bpe_32k": piece_model()}, carry=("doc_id", "source", "lang")), "counted")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(5)), F.lit(0))
    moved, again = counted.where(part == 1), counted.where(part == 2)
    before = moved.withColumn("source", F.concat(F.lit("old-"), "source")).withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup.commit("load", tokencounts.inserts(counted.where(part != 1).unionByName(before)))
    rollup.commit("revise", tokencounts.revisions(before, moved))
    rollup.commit("revise", tokencounts.revisions(before, moved))  # a batch that comes again changes nothing
    rollup.commit("delete", tokencounts.deletes(again))
    rollup.commit("restore", tokencounts.inserts(again))
    return rollup.totals()


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("held_out", lm.held_out(F.col("doc_id")))
    return lm.score(rows, lm.train(rows.where("not held_out")), carry=("doc_id", "held_out"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1,
        "op2_rendezvous_shards": op2,
        "op3_pii_spans": op3,
        "op4_quality_rules": op4,
        "op5_simhash_groups": op5,
        "op6_language_mixture": op6,
        "op7_url_filter": op7,
        "op8_token_rollup": op8,
        "op9_bloom_lm": op9,
        "op10_decontamination": op10,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express a query; the others are tested against brute force."""
    return {"op7_url_filter": OP7_SQL}


OP7_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
"""
