"""Registering queries with their SQL, and the tables with each record once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import latest, table

#: The moment all age-dependent queries refer to; never the clock.
AS_OF = "2026-06-01 00:00:00"

_ONCE = {
    "f": "f AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, content) = 1)",
    "e": "e AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY created_at DESC NULLS LAST, summary) = 1)",
    "t": "t AS (SELECT * FROM triples QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)",
    "n": "n AS (SELECT * FROM notes_meta QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY updated DESC NULLS LAST) = 1)",
    "g": "g AS (SELECT * FROM graph_edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)",
    "v": "v AS (SELECT lower(fact_id) AS fid, vector, model, dim, created_at FROM fact_embeddings QUALIFY row_number() OVER (PARTITION BY lower(fact_id) ORDER BY created_at DESC NULLS LAST, model DESC NULLS LAST, vector DESC NULLS LAST) = 1)",
    "a": "a AS (SELECT * FROM audit_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST) = 1)",
}


def facts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf, "facts", *dict.fromkeys(["id", *columns, "updated_at"])), "id", "updated_at")


def episodes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf, "episodes", *dict.fromkeys(["episode_id", *columns, "created_at"])), "episode_id", "created_at")


def triples(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf, "triples", *dict.fromkeys(["id", *columns, "created_at"])), "id", "created_at")


def notes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf, "notes_meta", *dict.fromkeys(["note_id", *columns, "updated"])), "note_id", "updated")


def edges(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf, "graph_edges", *dict.fromkeys(["id", *columns, "created_at"])), "id", "created_at")


def vectors(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    df = table(spark, sf, "fact_embeddings", *dict.fromkeys(["fact_id", "model", *columns, "created_at"]))
    return latest(df.withColumn("fact_id", F.lower("fact_id")), "fact_id", "created_at", "model")


def audit(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf, "audit_log", *dict.fromkeys(["id", *columns, "ts"])), "id", "ts")


class Queries:
    """The queries of one module."""

    def __init__(self):
        self.made: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, once: str = "") -> Callable:
        """Registers the function under its name. once: letters of the tables to be read with each record once."""

        def register(fn: Callable) -> Callable:
            self.made[fn.__name__] = fn
            if sql:
                ctes = ", ".join(_ONCE[c] for c in once)
                body = sql.strip()
                self.sql[fn.__name__] = (f"WITH RECURSIVE {ctes}{body if body.startswith(',') else ' ' + body}") if ctes else body
            return fn

        return register

    def queries(self) -> dict[str, Callable]:
        return dict(self.made)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
