"""Relevance, decay, reinforcement, fusion and budgeted selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.times import micros_of


def normalised(score: Column, by: list[str]) -> Column:
    """0 for the smallest score of the group, 1 for the largest; 1 where all are equal."""
    w = W.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def decay(last_accessed: Column, as_of: str, half_life_days: float = 30.0) -> Column:
    """Halves every `half_life_days` since the last access; 1 where it is unknown."""
    days = (micros_of(F.to_timestamp_ntz(F.lit(as_of))) - micros_of(last_accessed)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) / half_life_days * F.greatest(days, F.lit(0.0))), F.lit(1.0))


def reinforcement(access_count: Column, boost: float = 0.1, most: int = 10) -> Column:
    return F.lit(1.0) + F.lit(boost) * F.least(F.coalesce(access_count, F.lit(0)), F.lit(most))


def fused(lexical: DataFrame, semantic: DataFrame, key: str, lexical_share: float = 0.6) -> DataFrame:
    """(key, score): weighted sum of two score lists, each divided by its maximum; a missing score is 0."""
    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = df.agg(F.max("score").alias("_top"))
        return df.crossJoin(F.broadcast(top)).select(key, (F.col("score") / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))).alias(name))

    both = scaled(lexical, "a").join(scaled(semantic, "b"), key, "full_outer")
    return both.select(key, (F.coalesce("a", F.lit(0.0)) * lexical_share + F.coalesce("b", F.lit(0.0)) * (1 - lexical_share)).alias("score"))


def budgeted(df: DataFrame, by: list[str], order: list[Column], text: str, budget: int, least: int = 100) -> DataFrame:
    """The first rows of each group whose texts fit into `budget` characters; the first that doesn't is cut if at
    least `least` characters are left for it, and the group ends there. Empty texts are left out."""
    ordered = W.partitionBy(*by).orderBy(*order)
    w = ordered.rowsBetween(W.unboundedPreceding, -1)
    # every text takes a character at least, so rows beyond the budget are cut off before the shuffle
    df = df.where(F.length(text) > 0).withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= budget + 1).drop("_n")
    used = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    room = F.lit(budget) - F.col("_used")
    fits = F.length(text) <= room
    return (
        df.withColumn("_used", used)
        .where(fits | ((room >= least) & (F.col("_used") <= budget)))
        .withColumn(text, F.when(fits, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), room.cast("int"))))
        .drop("_used")
    )


def disclosed(df: DataFrame, by: list[str], score: str, order: list[Column], tiers: tuple = ((0.7, 2), (0.4, 3)), rest: int = 5) -> DataFrame:
    """Fewer rows the better the best one is: the first two at a top score of 0.7, three at 0.4, else five."""
    cap = F.lit(rest)
    for limit, most in reversed(tiers):
        cap = F.when(F.col("_top") >= limit, most).otherwise(cap)
    # a few rows of each group and its maximum: no group is sorted or collected whole
    few = df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= max(rest, *(m for _, m in tiers)))
    tops = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(score).alias("_top"))
    same = reduce(lambda a, b: a & b, [few[c].eqNullSafe(tops[f"_{c}"]) for c in by])
    return few.join(tops, same).where(F.col("_n") <= cap).drop("_n", "_top", *[f"_{c}" for c in by])
