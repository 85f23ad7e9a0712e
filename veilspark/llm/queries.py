"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.scaling import checkpoint_dir

from . import balance, chained_dedup, conversation_repair, decontaminate, jaccard_join, language_id, license_scan, ngram_trie, quality_rules, resampling, simhash, spelling, sql, token_rollups

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(parts=7)
    return ngram_trie.score(docs, ngram_trie.build(docs.filter(~held_out)), held_out)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("doc_key")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in one batch; the next, sent twice, deletes those labelled toxic and revises those
    of low quality, whose symbols were stripped."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = token_rollups.Rollup(spark, f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("1-load", docs.withColumn("op", F.lit("insert")))
    verdicts = (labels.groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min("quality").alias("quality"))
                .select("doc_id", F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 0, "revise").alias("op"))
                .filter("op IS NOT NULL"))
    cleaned = docs.withColumn("text", F.regexp_replace("text", r"[#*$%&|<>!]+", " "))
    changes = cleaned.join(verdicts.hint("merge"), "doc_id").select("op", "doc_id", "text", "source", "lang")
    for _ in range(2):
        rollup.commit("2-review", changes)
    return rollup.totals()


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()).select("lang", "text"))
    return language_id.identify(docs, model)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chained_dedup.passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("first").alias("first_word"), F.col("last").alias("end_word"),
                        F.col("other_id").alias("other_doc_id"), F.col("other_first").alias("other_first_word"),
                        F.col("other_last").alias("other_end_word"), "n_equal")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op10_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = balance.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(rows), of=rows)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_rules, op2_decontamination, op3_lm_scoring, op4_quality_classifier, op5_jaccard_join, op6_token_counts, op7_language_id, op8_substring_dedup, op9_license_scan, op10_entropy_balance,
    op11_simhash_dedup, op12_conversation_repair, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op1_quality_rules": sql.quality_rules(), "op2_decontamination": sql.decontamination(),
                           "op9_license_scan": sql.license_scan(),
                           "op10_entropy_balance": sql.entropy_balance(),
                           "op12_conversation_repair": sql.conversation_repair(), "op13_spelling_variants": sql.spelling_variants()}
