"""Queries of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.format_duplicates import format_duplicates
from lodestrata.llm.leakage import leaked_items, without_leaks
from lodestrata.llm.personal import find_personal
from lodestrata.llm.subjects import assign_subjects
from lodestrata.llm.tokenize import token_ids
from lodestrata.session import ensure_checkpoint_dir
from lodestrata.sources.tables import latest, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_duplicates(table(spark, sf_dir, "facts", "id", "content"))
    return found.where("id <> keep_id").select("keep_id", "id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and episodes, each once, behind a checkpoint: name words, sample and search read them one after the other."""
    ensure_checkpoint_dir(spark)
    facts = latest(table(spark, sf_dir, "facts", "id", "content", "updated_at"), "id", "updated_at")
    episodes = latest(table(spark, sf_dir, "episodes", "episode_id", "summary", "created_at"), "episode_id", "created_at")
    return facts.select(F.lit("facts").alias("src"), F.col("id").alias("rec_id"), F.col("content").alias("text")).unionByName(
        episodes.select(F.lit("episodes").alias("src"), F.col("episode_id").alias("rec_id"), F.col("summary").alias("text"))
    ).checkpoint()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(_texts(spark, sf_dir))
    return found.select("src", "rec_id", F.explode(F.array_distinct("found.type")).alias("pii_type"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(_texts(spark, sf_dir)).select("src", "rec_id", F.col("redacted").alias("text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))
    return found.select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars) of the corpus without the documents that evaluation texts leaked into."""
    leaks = leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))
    return without_leaks(table(spark, sf_dir, "documents", "doc_id", "n_chars"), leaks)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "doc_labels", "doc_id", "subject"), table(spark, sf_dir, "subjects", "subject", "label")
    )


def queries() -> dict:
    return {"p4_found": p4_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found}


def oracle_sql() -> dict:
    return {}
