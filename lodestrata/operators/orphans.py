"""References to records that do not exist, are deleted, or came later than the reference.

Keys are dictionary-encoded: the key space is cut into ranges by hash, and a key's integer is its dense rank in its
range. One bitmap per key range and month holds the keys referred to in that month, another the keys whose parent
was created in it. Per range, references AND-NOT the parents known to be there before the month leaves the keys
that may be missing or late; these bits are decoded to keys by the range's dictionary, checked exactly against
parents and removals, and joined to the referring rows. A hot key is one bit per month and map task before any
shuffle; in the last join the referring rows are salted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.frames import frame
from lodestrata.functions.text import strip_blanks

#: Keys a range is sized for, and bits in one bitmap of the built-in bitmap functions. A fuller range uses several.
KEYS_PER_RANGE = 16_384
BITS = 32_768
SURVIVOR = "space string, ref_key string, month int"


def _pack(bitmaps: pd.Series) -> pd.Series:
    return bitmaps.map(lambda b: zlib.compress(bytes(b), 1))


def _surviving(key: tuple, words: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
    """One key range: decodes references AND-NOT parents of earlier months."""
    found = []
    for part, rows in maps.groupby("part"):
        there = np.zeros(BITS // 8, np.uint8)
        rows = rows.assign(is_ref=rows["role"] == "ref").sort_values(["month", "is_ref"], ascending=[True, False])
        # a month's references meet the parents of earlier months only; parents of the same month may be late
        for r in rows.itertuples():
            bits = np.frombuffer(zlib.decompress(r.bits), np.uint8)
            if r.is_ref:
                left = np.nonzero(np.unpackbits(bits & ~there, bitorder="little"))[0]
                found.append(pd.DataFrame({"pos": left + int(part) * BITS, "month": r.month}))
            else:
                there = there | bits
    if not found:
        return frame([], SURVIVOR)
    hits = pd.concat(found).merge(words, on="pos")
    return frame(list(zip(hits["space"], hits["ref_key"], hits["month"])), SURVIVOR)


def missing_keys(refs: DataFrame, parents: DataFrame, keys_per_range: int = KEYS_PER_RANGE, n_keys: int | None = None) -> DataFrame:
    """Distinct (space, ref_key, month) of `refs` with no parent known to be created before that month.

    refs: space, ref_key, created_at. parents: space, ref_key, created_at. `month` counts months, -1 for an
    unknown time of the reference; a parent of unknown time counts as always there. Null keys are left out.
    n_keys sizes the key ranges, as a count of rows that stands in for that of keys; without it the rows are counted.
    """
    month = F.coalesce((F.year("created_at") * 12 + F.month("created_at")).cast("int"), F.lit(-1))
    marks = (
        refs.select("space", "ref_key", month.alias("month"), F.lit("ref").alias("role"))
        .unionByName(
            parents.select(
                "space",
                "ref_key",
                F.when(F.col("created_at").isNull(), -2).otherwise(month).alias("month"),
                F.lit("parent").alias("role"),
            )
        )
        .where("ref_key IS NOT NULL")
        .distinct()
    )
    n_keys = refs.count() + parents.count() if n_keys is None else n_keys
    ranges = max(1, -(-n_keys // keys_per_range))
    coded = (
        marks.withColumn("key_range", F.pmod(F.xxhash64("space", "ref_key"), F.lit(ranges)).cast("int"))
        .repartition("key_range")
        .withColumn("pos", F.dense_rank().over(W.partitionBy("key_range").orderBy("space", "ref_key")) - 1)
    )
    # a reference of unknown time is never late: it meets every parent
    bitmaps = (
        coded.withColumn("month", F.when((F.col("role") == "ref") & (F.col("month") == -1), 10**6).otherwise(F.col("month")))
        .groupBy("key_range", (F.col("pos") / BITS).cast("int").alias("part"), "role", "month")
        .agg(F.bitmap_construct_agg((F.col("pos") % BITS).cast("long")).alias("bits"))
        .withColumn("bits", F.pandas_udf(_pack, "binary")("bits"))
    )
    words = coded.where("role = 'ref'").groupBy("key_range", "pos", "space", "ref_key").agg(F.lit(1).alias("_"))
    out = (
        words.groupBy("key_range")
        .cogroup(bitmaps.groupBy("key_range"))
        .applyInPandas(_surviving, SURVIVOR)
    )
    return out.withColumn("month", F.when(F.col("month") == 10**6, -1).otherwise(F.col("month")))


def orphan_references(
    refs: DataFrame, parents: DataFrame, removals: DataFrame, keys_per_range: int = KEYS_PER_RANGE, salts: int = 8, n_keys: int | None = None
) -> DataFrame:
    """References whose target is absent, removed or late (src, src_key, ref_id, reason, ref_month).

    refs: src, src_key, space, ref_key, created_at (TIMESTAMP_NTZ). parents: space, ref_key, created_at, where null
    is an unknown time and repeated keys count with their earliest known time. removals: space, ref_key.
    `deleted` is an absent key among the removals, `missing` any other absent key, `late` a key whose parent was
    created after the reference; an unknown time on either side is never late. Null keys are no references.
    References delivered twice come out once. Empty tables give no rows. Other columns are ignored. n_keys: see
    `missing_keys`.
    """
    refs = refs.select("src", "src_key", "space", "ref_key", "created_at")
    known = parents.where("ref_key IS NOT NULL").groupBy("space", "ref_key").agg(
        F.min("created_at").alias("parent_at"), F.max(F.col("created_at").isNull()).alias("undated")
    )
    known = known.select("space", "ref_key", F.when(~F.col("undated"), F.col("parent_at")).alias("parent_at"))
    left = missing_keys(refs, known.withColumnRenamed("parent_at", "created_at"), keys_per_range, n_keys)
    removed = removals.where("ref_key IS NOT NULL").select("space", "ref_key").distinct().withColumn("removed", F.lit(True))
    suspects = (
        left.join(known.withColumn("there", F.lit(True)), ["space", "ref_key"], "left")
        .join(removed, ["space", "ref_key"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    month = F.coalesce((F.year("created_at") * 12 + F.month("created_at")).cast("int"), F.lit(-1))
    rows = refs.where("ref_key IS NOT NULL").withColumn("month", month).withColumn(
        "salt", F.pmod(F.xxhash64("src_key"), F.lit(salts)).cast("int")
    )
    reason = (
        F.when(F.col("there").isNull() & F.col("removed"), "deleted")
        .when(F.col("there").isNull(), "missing")
        .when(F.col("parent_at") > F.col("created_at"), "late")
    )
    return (
        rows.join(suspects, ["space", "ref_key", "month", "salt"])
        .select(
            "src",
            "src_key",
            F.col("ref_key").alias("ref_id"),
            reason.alias("reason"),
            F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("")).alias("ref_month"),
        )
        .where("reason IS NOT NULL")
        .distinct()
    )


def store_references(edges: DataFrame, vectors: DataFrame, episodes: DataFrame) -> DataFrame:
    """The store's references (src, src_key, space, ref_key, created_at), without blanks around keys, fact ids in lower case."""
    links = edges.where(F.col("kind").startswith("wikilink") | F.col("kind").startswith("triple:")).select(
        F.lit("graph_edges").alias("src"),
        F.col("id").cast("string").alias("src_key"),
        F.when(F.col("kind").startswith("triple:"), "entity").otherwise("note").alias("space"),
        F.nullif(strip_blanks(F.col("target_id")), F.lit("")).alias("ref_key"),
        "created_at",
    )
    fact = F.nullif(F.lower(strip_blanks(F.col("fact_id"))), F.lit(""))
    embedded = vectors.select(F.lit("fact_embeddings").alias("src"), fact.alias("src_key"), F.lit("fact").alias("space"), fact.alias("ref_key"), "created_at")
    ids = F.array_distinct(F.regexp_extract_all(F.lower("linked_fact_ids"), F.lit(r"(?<![0-9a-z])([0-9a-f]{16})(?![0-9a-z])"), 1))
    linked = episodes.select(F.lit("episodes").alias("src"), F.col("episode_id").alias("src_key"), F.lit("fact").alias("space"), F.explode(ids).alias("ref_key"), "created_at")
    return links.unionByName(embedded).unionByName(linked)
