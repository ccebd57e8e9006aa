"""Scans of the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan of one table; columns are pruned at the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: a record delivered again counts once.

    The row with the largest `order` columns is kept; full ties fall to the smallest remaining values, so the
    result does not depend on row order. Null keys form one group. Aggregates map-side: no group is collected.
    """
    rest = [c for c in df.columns if c != key]
    nulls_first = [F.col(c) for c in order] + [F.col(c) for c in rest if c not in order]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*nulls_first)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in the given order (a window; use for row sets that need a full sort order)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
