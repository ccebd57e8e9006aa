"""Dictionaries of names made of the data: titles with aliases, canonical spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names_of(df: DataFrame, id_col: str, path: str, names: Column) -> DataFrame:
    """(name, <id_col>, notes): each name or alias with the record it leads to; of several the last path wins.

    names: ARRAY<STRING>. Null and blank names are left out; outer blanks don't count.
    """
    each = df.select(F.explode(names).alias("name"), id_col, path).select(F.trim("name").alias("name"), id_col, path).where("name <> ''")
    return each.groupBy("name").agg(F.max_by(id_col, F.struct(path, id_col)).alias(id_col), F.count(F.lit(1)).alias("notes"))


def canonical(df: DataFrame, col: str) -> DataFrame:
    """(alias, name, spellings, mentions): every spelling, letter case and outer blanks aside, with the one used most,
    ties by the smallest. Counted before the shuffle, so a hot name is a few rows by then.
    """
    each = df.select(F.trim(col).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(F.lower("name").alias("alias")).agg(
        F.min_by("name", F.struct((-F.col("n")).alias("n"), "name")).alias("name"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("mentions")
    )


def renamed(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
    """The column under its canonical name; rows with a name that isn't in `names` (alias, name) are left out."""
    look = names.select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
    return df.join(look, F.lower(F.trim(col)) == F.col("_alias")).withColumn(col, F.col("_name")).drop("_alias", "_name")
