"""Retrieval composed of its parts: expansion along links, re-ranking, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expanded(hits: DataFrame, edges: DataFrame, seeds: int = 5, per_seed: int = 3) -> DataFrame:
    """(id, score, via): the hits, and up to `per_seed` linked notes of each of the best `seeds`, at half the least
    score of the hits. A note found twice keeps its best score; `via` is the note that led to it.

    hits: id, score, a short ranked list. edges: node, other, weight, in both directions.
    """
    best = hits.orderBy(F.desc("score"), "id").limit(seeds)
    half = hits.agg((F.min("score") * 0.5).alias("half"))
    linked = edges.join(F.broadcast(best.select(F.col("id").alias("node"))), "node")
    linked = linked.groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    order = W.partitionBy("node").orderBy(F.desc_nulls_last("weight"), "other")
    linked = linked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_seed)
    more = linked.crossJoin(F.broadcast(half)).select(F.col("other").alias("id"), F.col("half").alias("score"), F.col("node").alias("via"))
    both = hits.select("id", "score", F.lit("").alias("via")).unionByName(more)
    return both.groupBy("id").agg(F.max("score").alias("score"), F.min("via").alias("via"))


def snippet(text: Column, term: str, radius: int = 60) -> Column:
    """The text around the first place of the term, or its beginning."""
    at = F.instr(F.lower(text), term.lower())
    return F.when(at > 0, F.substring(text, F.greatest(at - radius, F.lit(1)), F.lit(2 * radius + len(term)))).otherwise(F.substring(text, 1, 2 * radius))


def rendered(key: Column, content: Column, score: Column, width: int = 300) -> Column:
    """A line of a context block; null contents are empty."""
    text = F.coalesce(content, F.lit(""))
    cut = F.concat(F.substring(text, 1, width), F.when(F.length(text) > width, "...").otherwise(""))
    return F.concat(F.format_string("- [%s] %s", key, cut), F.when(score > 0, F.format_string(" [score:%.2f]", score)).otherwise(""))
