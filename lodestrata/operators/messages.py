"""Conversations: messages of session documents, episodes made of them, context windows, injected facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import session_title


def messages(documents: DataFrame) -> DataFrame:
    """(session, turn, role, content) of documents whose lines begin with 'user:' or 'assistant:'."""
    lines = documents.select(F.col("doc_id").alias("session"), F.posexplode(F.split("text", r"\r?\n")).alias("turn", "line"))
    role = F.regexp_extract("line", r"^(user|assistant): ?", 1)
    return lines.select("session", "turn", role.alias("role"), F.regexp_replace("line", r"^(user|assistant): ?", "").alias("content")).where("role <> ''")


def distilled(msgs: DataFrame) -> DataFrame:
    """(session, title, summary, n): an episode of each session that has a message of the user."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    e = msgs.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("turn"))).alias("first_user"),
        F.max_by(F.when(user, F.col("content")), F.when(user, F.col("turn"))).alias("last_user"),
        F.max_by(F.when(assistant, F.col("content")), F.when(assistant, F.col("turn"))).alias("last_assistant"),
    )
    title = session_title(F.col("first_user"))
    part = lambda head, c, n, tail: F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit(head), F.trim(F.substring(c, 1, n)), F.lit(tail)))
    summary = F.concat(
        F.lit("Session "), F.col("session").cast("string"), F.lit(". Started: "), F.col("title"), F.lit(". "),
        part("Last request: ", F.col("last_user"), 200, ". "), part("Outcome: ", F.col("last_assistant"), 280, ""),
    )
    return e.withColumn("title", title).where("title <> ''").select("session", "title", F.substring(summary, 1, 600).alias("summary"), "n")


def context_query(msgs: DataFrame, query: Column, turns: int = 3, width: int = 200, most: int = 1000) -> DataFrame:
    """(session, context): the query and the user's messages among the last 2 * turns, each cut, distinct, in order."""
    recent = msgs.withColumn("_n", F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn")))).where(F.col("_n") <= 2 * turns)
    said = recent.where("role = 'user'").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("content", 1, width).alias("c")))).alias("m"))
    parts = F.array_distinct(F.concat(F.array(query), F.transform("m", lambda x: x["c"])))
    return said.select("session", F.substring(F.array_join(parts, " "), 1, most).alias("context"))


def conversation_key(msgs: DataFrame, last: int = 4, width: int = 100) -> DataFrame:
    """(session, key): digest of the last messages, each cut."""
    recent = msgs.withColumn("_n", F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn")))).where(F.col("_n") <= last)
    parts = recent.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("content", 1, width).alias("c")))).alias("m"))
    return parts.select("session", F.sha2(F.array_join(F.transform("m", lambda x: x["c"]), "\n"), 256).alias("key"))
