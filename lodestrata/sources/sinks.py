"""Writing: notes as files, partitioned tables, exports, snapshots, the audit log."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions import text as tx


def note_text(title: Column, domain: Column, tags: Column, created: Column, body: Column) -> Column:
    """A note with its frontmatter."""
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), title), F.concat(F.lit("domain: "), domain),
        F.concat(F.lit("tags: ["), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", "), F.lit("]")),
        F.concat(F.lit("created: "), created), F.lit("---"), F.concat(F.lit("# "), title), F.lit(""), body,
    )


def note_paths(df: DataFrame, folder: str, title: str, order: str) -> DataFrame:
    """Adds `note_path`, folder/stub.md; the second of one stub in a folder gets -2, the third -3.

    The stub is numbered by a window over one folder's notes of one stub; `order` decides, so the paths are stable.
    """
    stub = df.withColumn("_stub", tx.file_stub(F.col(title)))
    nth = F.row_number().over(W.partitionBy(folder, "_stub").orderBy(order))
    name = F.when(nth > 1, F.concat("_stub", F.lit("-"), nth.cast("string"))).otherwise(F.col("_stub"))
    return stub.withColumn("note_path", F.concat(F.col(folder), F.lit("/"), name, F.lit(".md"))).drop("_stub")


def write_notes(df: DataFrame, path: str) -> None:
    """Notes (note_path, text), partitioned by folder: text files of one note a line of JSON, written by the tasks."""
    df.withColumn("folder", F.substring_index("note_path", "/", 1)).write.mode("overwrite").partitionBy("folder").json(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit rows, the detail cut at 2000 characters, a folder for each day."""
    rows = df.withColumn("detail", F.substring("detail", 1, 2000)).withColumn("day", F.to_date("ts"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def export_store(tables: dict[str, DataFrame], path: str) -> None:
    """A snapshot of the tables and a manifest of their names and row counts."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    spark.createDataFrame(manifest, "name string, n bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    names = [r.name for r in spark.read.schema("name string, n bigint").json(f"{path}/manifest").collect()]
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def derive_key(password: str, salt: bytes, rounds: int = 480_000) -> bytes:
    """A 256-bit key from a password (PBKDF2 with SHA-256)."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """The columns encrypted (AES-GCM) and in base64."""
    return df.withColumns({c: F.base64(F.aes_encrypt(F.col(c), F.unhex(F.lit(key.hex())), F.lit("GCM"))) for c in columns})


def decrypted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    return df.withColumns({c: F.aes_decrypt(F.unbase64(F.col(c)), F.unhex(F.lit(key.hex())), F.lit("GCM")).cast("string") for c in columns})


def keep_last(snapshots: DataFrame, by: str, at: str, n: int = 7, tie: str | None = None) -> DataFrame:
    """The newest `n` snapshots of each kind; of one time those with the largest `tie`."""
    order = [F.desc_nulls_last(c) for c in (at, tie) if c]
    return snapshots.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
