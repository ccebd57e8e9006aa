"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import general, links, lists, records, search, streams, texts, views

MODULES = (general, records.Q, links.Q, texts.Q, search.Q, streams.Q, lists.Q, views.Q)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recall_relevance(spark, sf_dir)
