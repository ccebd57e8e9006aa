"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows, so there are at most 1 / HOT_SHARE hot keys: a proven size.
HOT_SHARE = 0.005


def join_hot_aside(
    rows: DataFrame, dictionary: DataFrame, key: str, n_rows: int, count: str = "n", prepare: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """Inner join of `rows` with a dictionary of unique `key`s that carries each key's row count in column `count`.

    Keys with at least HOT_SHARE of the rows (never more than 200) are broadcast, the rest is shuffled. `prepare` is
    costly work on the dictionary's rows; it is done once for each key, after hot and other keys are parted.
    """
    hot = F.col(count) >= max(1.0, HOT_SHARE * n_rows)
    few = F.broadcast(prepare(dictionary.where(hot).drop(count)))
    rest = rows.join(F.broadcast(dictionary.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(prepare(dictionary.where(~hot).drop(count)), key))


def integer_ids(values: DataFrame, key: str, n_rows: int, per_range: int = 50_000) -> DataFrame:
    """Adds `code`, one integer for each distinct `key`: its hash range and its rank there.

    Codes depend on the set of keys only, so a recomputed task gives the same ones.
    """
    from pyspark.sql import Window as W

    ranges = max(1, -(-n_rows // per_range))
    return (
        values.withColumn("_range", F.pmod(F.xxhash64(key), F.lit(ranges)))
        .withColumn("code", F.shiftleft(F.col("_range"), 32) + F.row_number().over(W.partitionBy("_range").orderBy(key)))
        .drop("_range")
    )
