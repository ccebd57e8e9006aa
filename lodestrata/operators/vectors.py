"""Vector search by cosine similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int, block: int = 2048, shard: int = 32_768) -> DataFrame:
    """(query, id, score, rank): the `k` rows nearest to each query, itself left out, ties by id.

    The queries, a stated set, are cut into blocks and the rows into shards of bounded size by their ids; each block
    meets each shard in a task of its own, by one matrix product, and keeps its best `k` per query; a window merges
    these. Nothing passes the driver but the two counts. Null and empty vectors are no rows.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("size(v) > 0")
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("size(v) > 0")
    kind = rows.schema["id"].dataType.simpleString()
    count = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(asked.agg(F.count(F.lit(1)).alias("q"))).first()
    shards, blocks = -(-count.n // shard) or 1, -(-count.q // block) or 1

    def all_of(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)

    part = lambda name, n: F.pmod(F.xxhash64("id"), F.lit(n).cast("bigint")).alias(name)
    left = asked.select("id", "v", part("block", blocks)).select("*", all_of("shard", shards))
    right = rows.select("id", "v", part("shard", shards)).select("*", all_of("block", blocks))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query": [], "id": [], "score": []})
        ids, own = q["id"].to_numpy(), r["id"].to_numpy()
        s = np.round(_unit(q["v"]) @ _unit(r["v"]).T, 6)
        s[ids[:, None] == own[None, :]] = -2
        take = min(k, len(own))
        # ties at the border are kept, the window settles them
        edge = -np.partition(-s, take - 1, axis=1)[:, take - 1]
        a, b = np.nonzero((s >= edge[:, None]) & (s > -2))
        return pd.DataFrame({"query": ids[a], "id": own[b], "score": s[a, b]})

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(search, f"query {kind}, id {kind}, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
