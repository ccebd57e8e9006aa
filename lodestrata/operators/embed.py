"""Text vectors from a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed feature hashing of words, each vector of length 1: a stand-in where no model is installed."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """(id, vector) of each text, in Arrow batches; null and blank texts have none. The embedder runs in the tasks."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("trim(text) <> ''")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "vector": list(embedder(pdf["text"].tolist()))})

    return rows.mapInPandas(run, f"id {kind}, vector array<float>")


def coverage(records: DataFrame, id_col: str, vectors: DataFrame) -> DataFrame:
    """(total, embedded, pct) of the records that have a vector."""
    v = vectors.select(F.col("id").alias("_id")).distinct()
    joined = records.join(v, records[id_col] == F.col("_id"), "left")
    n, m = F.count(F.lit(1)), F.count("_id")
    return joined.agg(n.alias("total"), m.alias("embedded"), F.when(n == 0, 0.0).otherwise(F.round(m * 100.0 / n, 1)).alias("pct"))
