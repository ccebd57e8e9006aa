"""Changes of tables as pure functions: (table, changes) -> table. Persisting is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.privacy import pattern_redacted, tier, write_action
from lodestrata.functions.text import record_id, sanitized
from lodestrata.operators.similar import most_similar
from lodestrata.sources.tables import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; columns missing on either side are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return latest(rows, key, *order)


def upsert_statements(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by subject, predicate and object: valid_from keeps the old value where the new one is null, the rest is
    the new row's. Both sides hold one row per key."""
    keys = ["subject", "predicate", "object"]
    a, b = old.alias("a"), new.alias("b").withColumn("_new", F.lit(True))
    joined = a.join(b, keys, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return joined.select(
        *keys,
        F.coalesce(F.col("b.valid_from"), F.col("a.valid_from")).alias("valid_from"),
        *[pick(c) for c in ("valid_until", "source", "confidence")],
    )


def forget(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame) -> dict[str, DataFrame]:
    """Removes the keys (column `key`) from every table, each given with its key column."""
    gone = keys.select("key").distinct()
    return {name: df.join(gone, df[col] == gone["key"], "left_anti") for name, (df, col) in tables.items()}


def consolidate(facts: DataFrame, as_of: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): facts created more than `days` before and never accessed go to the archive."""
    stale = (F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))) & (F.coalesce("access_count", F.lit(0)) <= 0)
    stale = F.coalesce(stale, F.lit(False))
    return facts.where(~stale), facts.where(stale)


def reinforced(facts: DataFrame, accesses: DataFrame) -> DataFrame:
    """access_count and last_accessed with the accesses (fact_id, ts) added; counted before the join."""
    seen = accesses.groupBy(F.col("fact_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_at"))
    return (
        facts.join(seen, facts["id"] == F.col("_id"), "left")
        .withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)))
        .withColumn("last_accessed", F.greatest("last_accessed", "_at"))
        .drop("_id", "_n", "_at")
    )


def remapped(domain: Column, known: list[str], remap: dict[str, str], default: str = "Knowledge") -> Column:
    """A stray domain by the map, else the default; known ones stay."""
    out = F.when(domain.isin(known), domain)
    for stray, to in remap.items():
        out = out.when(domain == stray, to)
    return out.otherwise(default)


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that are missing, null, of the given types; does nothing the second time."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def imported(rows: DataFrame, category: str, name: str, body: str, importance: float = 0.85) -> DataFrame:
    """(id, content, title, importance, tags, source) of foreign records: '[category] name: body'."""
    content = F.concat(F.lit("["), F.coalesce(F.col(category), F.lit("misc")), F.lit("] "), F.coalesce(F.col(name), F.lit("")), F.lit(": "), F.coalesce(F.col(body), F.lit("")))
    tags = F.array_compact(F.array(F.lit("imported"), F.lower(category), F.lower(name)))
    out = rows.select(content.alias("content"), F.col(name).alias("title"), F.lit(importance).alias("importance"), tags.alias("tags"), F.lit("import").alias("source"))
    return out.withColumn("id", record_id(F.col("content"))).groupBy("id").agg(*[F.min(c).alias(c) for c in ("content", "title", "importance", "tags", "source")])


def remembered(facts: DataFrame, incoming: DataFrame) -> DataFrame:
    """The write decision on each incoming fact: (id, content, domain, source, tier, action, exists).

    Sanitised, then judged, then redacted unless blocked; the id is the stored content's. `exists` tells an update
    from an insert. incoming: content, domain, source, sensitivity. Facts given twice come out once.
    """
    clean = sanitized(F.col("content"))
    judged = incoming.where("content IS NOT NULL").select(
        clean.alias("content"), "domain", "source", tier(F.col("sensitivity"), F.col("domain")).alias("tier"),
        write_action(clean, F.col("sensitivity"), F.col("domain"), F.col("source")).alias("action"),
    )
    stored = F.when(F.col("action") == "block", F.lit(None).cast("string")).otherwise(pattern_redacted(F.col("content")))
    rows = judged.withColumn("id", record_id(F.coalesce(stored, F.col("content")))).withColumn("content", stored).distinct()
    known = facts.select("id").distinct().withColumn("exists", F.lit(True))
    return rows.join(known, "id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def recalled(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds `found`: whether the table has a fact under the id of the stored content."""
    ids = facts.select(F.col("id").alias("_id")).distinct()
    own = stored.withColumn("_own", record_id(F.col("content")))
    return own.join(ids, F.col("_own") == F.col("_id"), "left").withColumn("found", F.col("_id").isNotNull()).drop("_own", "_id")


def merged(facts: DataFrame, incoming: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, kept_id, how): what becomes of each incoming fact (id, content): `update` of the fact of its id, else
    `merge` into the most similar one, which keeps its id, else `insert`. Facts without words are never merged.
    """
    new = incoming.select("id", "content").distinct()
    known = facts.select("id").distinct().withColumn("_known", F.lit(True))
    marked = new.join(known, "id", "left")
    like = most_similar(marked.where("_known IS NULL"), facts, "id", F.col("content"), threshold).select("id", "match_id").groupBy("id").agg(F.min("match_id").alias("match_id"))
    how = F.when(F.col("_known"), "update").when(F.col("match_id").isNotNull(), "merge").otherwise("insert")
    return marked.join(like, "id", "left").select("id", F.coalesce("match_id", "id").alias("kept_id"), how.alias("how"))
