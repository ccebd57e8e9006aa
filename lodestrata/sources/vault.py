"""Markdown notes, logs and other files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import text as tx
from lodestrata.functions.times import parse_micros


def _values(raw: Column) -> Column:
    """'[a, b]' or 'a, b' as ARRAY<STRING>."""
    inner = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\[", ""), r"\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def read_notes(spark: SparkSession, root: str, folder: str | None = None, archive: bool = False) -> DataFrame:
    """Notes of a directory tree of Markdown files, one row a file (note_id, path, title, domain, tags, note_type, body).

    Files under _archive/ are left out unless asked for; `folder` picks one folder, letter case aside. The title is
    the frontmatter's, else the file's name in title case. note_id is folder and file name without its ending.
    """
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
        .select("value", F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^file:/+", "/").alias("path"))
    )
    if not archive:
        files = files.where(~F.col("path").contains("/_archive/"))
    if folder:
        files = files.where(F.lower(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)) == folder.lower())
    meta = files.withColumn("meta", tx.frontmatter(F.col("value")))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    get = lambda k: F.nullif(F.try_element_at("meta", F.lit(k)), F.lit(""))
    return meta.select(
        F.regexp_extract("path", r"([^/]+/[^/]+)\.md$", 1).alias("note_id"),
        "path",
        F.coalesce(get("title"), F.initcap(F.regexp_replace(stem, "-", " "))).alias("title"),
        F.coalesce(get("domain"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("domain"),
        _values(get("tags")).alias("tags"),
        _values(get("aliases")).alias("aliases"),
        F.coalesce(get("type"), F.lit("permanent")).alias("note_type"),
        tx.body(F.col("value")).alias("body"),
    )


def read_pile(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of a directory's Markdown, text, HTML and JSON files."""
    files = spark.read.option("pathGlobFilter", "*.{md,txt,html,json}").text(root, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    return files.select(path.alias("path"), F.when(path.endswith(".html"), tx.html_text(F.col("value"))).otherwise(F.col("value")).alias("text"))


def read_gate_log(spark: SparkSession, path: str) -> DataFrame:
    """(day, status) of 'date,status' lines; malformed lines are left out, a day's last line wins."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    lines = lines.where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2},\s*\w+\s*$"))
    rows = lines.select("path", "pos", F.substring_index("value", ",", 1).try_cast("date").alias("day"), F.upper(F.trim(F.substring_index("value", ",", -1))).alias("status"))
    return rows.where("day IS NOT NULL").groupBy("day").agg(F.max_by("status", F.struct("path", "pos")).alias("status"))


RUN = T.StructType(
    [T.StructField("event", T.StringType()), T.StructField("ts", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("total", "written", "skipped", "errors", "parity_ok", "parity_total")]
    + [T.StructField("parity_rate", T.DoubleType()), T.StructField("error", T.StringType())]
)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Run summaries of JSON-lines logs."""
    return spark.read.schema(RUN).json(pattern).where("event = 'run_summary'").withColumn("at", parse_micros(F.col("ts")))


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON snapshot of an external workspace, one array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
