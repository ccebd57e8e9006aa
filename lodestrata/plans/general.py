"""Queries of the general data problems: continuous periods, orphan references, packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import strip_blanks
from lodestrata.functions.times import ntz_of, parse_micros
from lodestrata.operators.intervals import statement_periods
from lodestrata.operators.multivalue import split_values
from lodestrata.operators.orphans import orphan_references, store_references
from lodestrata.sources.tables import latest, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_periods(table(spark, sf_dir, "triples", "subject", "predicate", "valid_from", "valid_until"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = store_references(
        table(spark, sf_dir, "graph_edges", "id", "target_id", "kind", "created_at"),
        table(spark, sf_dir, "fact_embeddings", "fact_id", "created_at"),
        table(spark, sf_dir, "episodes", "episode_id", "linked_fact_ids", "created_at"),
    )
    triples = table(spark, sf_dir, "triples", "subject", "object")
    key = lambda c: strip_blanks(F.col(c))
    unknown = F.lit(None).cast("timestamp_ntz")
    parents = (
        table(spark, sf_dir, "facts", "id", "created_at")
        .select(F.lit("fact").alias("space"), F.lower(key("id")).alias("ref_key"), "created_at")
        .unionByName(
            table(spark, sf_dir, "notes_meta", "note_id", "created").select(
                F.lit("note").alias("space"), key("note_id").alias("ref_key"), ntz_of(parse_micros(F.col("created"))).alias("created_at")
            )
        )
        .unionByName(
            triples.select(F.explode(F.array(key("subject"), key("object"))).alias("ref_key")).distinct().select(
                F.lit("entity").alias("space"), "ref_key", unknown.alias("created_at")
            )
        )
    )
    removals = table(spark, sf_dir, "audit_log", "action", "fact_id", "detail", "ok").where("ok AND action IN ('forget', 'delete_note')").select(
        F.when(F.col("action") == "forget", "fact").otherwise("note").alias("space"),
        F.when(F.col("action") == "forget", F.lower(key("fact_id"))).otherwise(key("detail")).alias("ref_key"),
    )
    # from the footers alone: no more than this many keys but for facts that an episode links in plenty
    n_keys = sum(table(spark, sf_dir, name).count() for name in ("graph_edges", "fact_embeddings", "episodes", "facts", "notes_meta", "triples", "triples"))
    return orphan_references(refs, parents, removals, n_keys=n_keys)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = latest(table(spark, sf_dir, "facts", "id", "tags", "updated_at"), "id", "updated_at")
    notes = latest(table(spark, sf_dir, "notes_meta", "note_id", "tags"), "note_id")
    rows = facts.select(F.lit("facts").alias("src"), F.col("id").alias("rec_id"), "tags").unionByName(
        notes.select(F.lit("notes_meta").alias("src"), F.col("note_id").alias("rec_id"), "tags")
    )
    return split_values(rows, ["src", "rec_id"], "tags")


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found}


def _micros_sql(col: str) -> str:
    """TIMESTAMP in UTC of the same time spellings, NULL where the text is no real time."""
    s = f"trim({col})"
    for pattern, to in (
        (r"^(\d{4})/(\d{2})/(\d{2})", r"\1-\2-\3"),
        (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", r"\1-\2-\3T\4:\5:\6"),
        (r"^(.{10})T(\d{2}:\d{2})$", r"\1T\2:00"),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{to}')"
    off = f"regexp_extract({col}, '([+-][0-9]{{2}}):[0-9]{{2}}$', 1)"
    zone = f"coalesce(TRY_CAST({off} AS INTEGER), 0) * 60 + coalesce(TRY_CAST(left({off}, 1) || regexp_extract({col}, '[+-][0-9]{{2}}:([0-9]{{2}})$', 1) AS INTEGER), 0)"
    bare = f"regexp_replace({s}, '([+-][0-9]{{2}}:[0-9]{{2}}|Z)$', '')"
    return f"(CASE WHEN regexp_matches({col}, '[0-9]{{4}}') THEN TRY_CAST({bare} AS TIMESTAMP) - to_minutes({zone}) END)"


def _bare(col: str) -> str:
    """The text without blanks of any kind around it."""
    blank = r"[\s\p{Z}\x{0085}\x{200B}\x{2060}\x{FEFF}]"
    return f"regexp_replace({col}, '^{blank}+|{blank}+$', '', 'g')"


def oracle_sql() -> dict:
    return {
        "p1_found": f"""
WITH t AS (
  SELECT subject, predicate, {_micros_sql("valid_from")} AS a,
         CASE WHEN valid_until IS NULL OR trim(valid_until) = '' OR valid_until LIKE '9999%' THEN TIMESTAMP '9999-12-31 23:59:59'
              ELSE {_micros_sql("valid_until")} END AS b
  FROM triples),
r AS (SELECT *, max(b) OVER (PARTITION BY subject, predicate ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM t WHERE b > a),
i AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR a > before) OVER (PARTITION BY subject, predicate ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM r),
p AS (SELECT subject, predicate, g, min(a) AS a, max(b) AS b FROM i GROUP BY ALL),
o AS (SELECT subject, predicate, 'period' AS kind, a AS f, b AS u FROM p
      UNION ALL
      SELECT subject, predicate, 'gap', b, n FROM (SELECT *, lead(a) OVER (PARTITION BY subject, predicate ORDER BY a) AS n FROM p) WHERE n IS NOT NULL)
SELECT subject, predicate, kind, strftime(f, '%Y-%m-%d %H:%M:%S') AS from_ts,
       CASE WHEN year(u) = 9999 THEN '' ELSE strftime(u, '%Y-%m-%d %H:%M:%S') END AS until_ts
FROM o""",
        "p2_found": f"""
WITH refs AS (
  SELECT 'graph_edges' AS src, CAST(id AS VARCHAR) AS src_key, CASE WHEN kind = 'wikilink' THEN 'note' ELSE 'entity' END AS space,
         {_bare('target_id')} AS k, created_at FROM graph_edges
  UNION SELECT 'fact_embeddings', lower({_bare('fact_id')}), 'fact', lower({_bare('fact_id')}), created_at FROM fact_embeddings
  UNION SELECT 'episodes', episode_id, 'fact', unnest(regexp_extract_all(lower(linked_fact_ids), '[0-9a-f]{{16}}')), created_at FROM episodes),
parents AS (
  SELECT 'fact' AS space, lower({_bare('id')}) AS k, created_at AS born FROM facts
  UNION SELECT 'note', {_bare('note_id')}, {_micros_sql("created")} FROM notes_meta
  UNION SELECT 'entity', {_bare('subject')}, NULL FROM triples UNION SELECT 'entity', {_bare('object')}, NULL FROM triples),
known AS (SELECT space, k, CASE WHEN count(*) = count(born) THEN min(born) END AS born FROM parents GROUP BY ALL),
gone AS (SELECT DISTINCT 'fact' AS space, lower({_bare('fact_id')}) AS k FROM audit_log WHERE ok AND action = 'forget'
         UNION SELECT DISTINCT 'note', {_bare('detail')} FROM audit_log WHERE ok AND action = 'delete_note')
SELECT DISTINCT r.src, r.src_key, r.k AS ref_id,
  CASE WHEN p.k IS NULL AND g.k IS NOT NULL THEN 'deleted' WHEN p.k IS NULL THEN 'missing' ELSE 'late' END AS reason,
  coalesce(strftime(r.created_at, '%Y-%m'), '') AS ref_month
FROM refs r LEFT JOIN known p ON p.space = r.space AND p.k = r.k LEFT JOIN gone g ON g.space = r.space AND g.k = r.k
WHERE r.k <> '' AND (p.k IS NULL OR p.born > r.created_at)""",
    }
