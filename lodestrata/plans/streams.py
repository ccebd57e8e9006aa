"""Streaming queries, run over all files there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.operators import extract
from lodestrata.plans.base import Queries
from lodestrata.sources.tables import table
from lodestrata.streaming import jobs

Q = Queries()


@Q.add("SELECT action, ok, date_trunc('day', ts) AS start, count(*) AS n FROM (SELECT DISTINCT id, ts, action, ok FROM audit_log) WHERE ts IS NOT NULL GROUP BY ALL")
def stream_audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    stream = jobs.follow(spark, sf, "audit_log", "id", "ts", "action", "ok").where("ts IS NOT NULL")
    return jobs.run_available(jobs.audit_counts(jobs.once(stream, "ts")), "complete")


@Q.add(
    """WITH a AS (SELECT DISTINCT id, ts, session_id FROM audit_log), r AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) <= INTERVAL 13 HOUR THEN 0 ELSE 1 END AS fresh FROM a WHERE session_id <> '' AND NOT starts_with(session_id, 'cron') AND ts IS NOT NULL),
g AS (SELECT session_id, ts, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 13 HOUR AS "end", count(*) AS n FROM g GROUP BY session_id, k"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    stream = jobs.follow(spark, sf, "audit_log", "id", "ts", "session_id").where("ts IS NOT NULL")
    return jobs.run_available(jobs.captured_sessions(jobs.once(stream, "ts")), "complete")


def _recalls(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "audit_log", "id", "ts", "session_id", "fact_id").distinct().where("session_id <> '' AND fact_id <> '' AND ts IS NOT NULL")
    turn = F.row_number().over(W.partitionBy("session_id").orderBy("ts", "id")).cast("bigint")
    return a.select("session_id", F.lower(F.trim("fact_id")).alias("fact_id"), turn.alias("turn"))


@Q.add()
def injected_facts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.injected(_recalls(spark, sf))


@Q.add()
def stream_injected_facts(spark: SparkSession, sf: str) -> DataFrame:
    stream = jobs.follow(spark, sf, "audit_log", "id", "ts", "session_id", "fact_id").where("session_id <> '' AND fact_id <> '' AND ts IS NOT NULL")
    stream = jobs.once(stream, "ts").select("session_id", F.lower(F.trim("fact_id")).alias("fact_id"), F.col("ts").alias("at"), "id")
    return jobs.run_available(jobs.to_inject(stream))


@Q.add()
def stream_injected_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a session's facts of one month as a turn; a turn without a fresh fact repeats the two injected
    longest ago."""
    stream = jobs.follow(spark, sf, "audit_log", "id", "ts", "session_id", "fact_id").where("session_id <> '' AND fact_id <> '' AND ts IS NOT NULL")
    stream = jobs.once(stream, "ts").select("session_id", F.lower(F.trim("fact_id")).alias("fact_id"), F.date_trunc("month", "ts").alias("at"), "id")
    return jobs.run_available(jobs.to_inject(stream, together=True, repeats=2))


@Q.add()
def stream_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Preferences in arriving facts, each once, without those already stored."""
    stream = jobs.follow(spark, sf, "facts", "id", "content").where("content IS NOT NULL")
    found = extract.preferences_in(stream, "id", F.col("content"))
    return extract.unknown(jobs.run_available(found), table(spark, sf, "facts", "id"))
