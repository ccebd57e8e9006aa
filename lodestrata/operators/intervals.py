"""Continuous periods of overlapping intervals, and the gaps between them.

Intervals of one entity are merged by `session_window` with a duration of its own for each row. A hot entity would
put all its rows into one window task, so the sessions are first built per entity and time block, which is also
the pre-aggregation. Sessions that overlap or touch across blocks are then joined through a summary of one row per
entity and block: the latest end of all earlier blocks, carried in. No task ever holds more than one block's
sessions or one entity's block summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import strip_blanks
from lodestrata.functions.times import parse_micros, text_of

#: An open end: 10000-01-01, after every year-9999 value.
OPEN_US = 253_402_300_800_000_000


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(right[f"_{c}"])
    return cond


def _lookup(df: DataFrame, summary: DataFrame, on: list[str]) -> DataFrame:
    """Adds the summary's columns to each row by null-safe equality on `on`."""
    other = summary.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in summary.columns if c not in on])
    return df.join(other, _same(df, other, on)).drop(*[f"_{c}" for c in on])


def merge_intervals(df: DataFrame, keys: list[str], start_us: str, end_us: str, block_us: int = 7 * 86_400_000_000) -> DataFrame:
    """Rows (keys..., kind, from_us, until_us): `period` for each continuous period, `gap` between two successive ones.

    `start_us` and `end_us` are microseconds, ends excluded; touching intervals join. Rows whose start or end is null
    or whose end isn't after the start don't count. Null keys form an entity of their own. Repeated rows change
    nothing; an empty table gives no rows; other columns of `df` are ignored, whatever their names.
    """
    # sessions are merged in each map task before the shuffle, so that a hot entity's block arrives as few rows
    df.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(start_us).alias("a"), F.col(end_us).alias("b"))
    ks = [f"k{i}" for i in range(len(keys))]
    rows = rows.where("b > a").withColumn("block", F.floor(F.col("a") / block_us))
    length = ((F.col("b") - F.col("a")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    sessions = (
        rows.withColumn("at", F.timestamp_micros("a"))
        .groupBy(*ks, "block", F.session_window("at", F.make_interval(secs=length)))
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .select(*ks, "block", "a", "b")
    )
    by_entity = W.partitionBy(*ks).orderBy("block")
    carried = (
        sessions.groupBy(*ks, "block")
        .agg(F.max("b").alias("block_end"), F.min("a").alias("block_start"))
        .where("block_start IS NOT NULL")  # always so; it keeps both uses of the sessions alike, so that they are computed once
        .select(
            *ks,
            "block",
            F.max("block_end").over(by_entity.rowsBetween(W.unboundedPreceding, -1)).alias("carry"),
            F.max("block_end").over(W.partitionBy(*ks)).alias("last_end"),
        )
    )
    in_block = W.partitionBy(*ks, "block").orderBy("a", "b")
    starts = (
        _lookup(sessions, carried, [*ks, "block"])
        .withColumn("before", F.greatest("carry", F.max("b").over(in_block.rowsBetween(W.unboundedPreceding, -1))))
        .where("before IS NULL OR a > before")
    )
    following = (
        starts.groupBy(*ks, "block")
        .agg(F.min_by("before", "a").alias("first_before"))
        .select(*ks, "block", F.lead("first_before").over(by_entity).alias("next_before"))
    )
    periods = _lookup(starts, following, [*ks, "block"]).withColumn(
        "until", F.coalesce(F.lead("before").over(in_block), F.col("next_before"), F.col("last_end"))
    )
    out = periods.select(
        *ks,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("a").alias("from_us"), F.col("until").alias("until_us")),
                    F.struct(F.lit("gap").alias("kind"), F.col("before").alias("from_us"), F.col("a").alias("until_us")),
                ),
                lambda x: x["from_us"].isNotNull(),
            )
        ).alias("x"),
    )
    return out.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], "x.*")


def statement_periods(triples: DataFrame, block_us: int = 7 * 86_400_000_000) -> DataFrame:
    """Periods and gaps of each subject and predicate as written (subject, predicate, kind, from_ts, until_ts).

    A null, blank or year-9999 end is open and comes out as ''. Statements without a real start don't count.
    """
    # each text is read once: what a generator makes is not computed again by the filters above it
    read = F.struct(parse_micros(F.col("valid_from")).alias("a"), parse_micros(F.col("valid_until")).alias("end"), strip_blanks(F.col("valid_until")).alias("until"))
    rows = triples.select("subject", "predicate", F.inline(F.array(read)))
    is_open = F.col("until").isNull() | (F.col("until") == "") | (F.col("until").startswith("9999") & F.col("end").isNotNull())
    rows = rows.select("subject", "predicate", "a", F.when(is_open, F.lit(OPEN_US)).otherwise(F.col("end")).alias("b"))
    merged = merge_intervals(rows, ["subject", "predicate"], "a", "b", block_us)
    return merged.select(
        "subject",
        "predicate",
        "kind",
        text_of(F.col("from_us")).alias("from_ts"),
        F.when(F.col("until_us") == OPEN_US, F.lit("")).otherwise(text_of(F.col("until_us"))).alias("until_ts"),
    )
