"""Queries over facts, episodes, notes and the audit log: filters, aggregates, windows, changes, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.privacy import PERSONAL, personal_types
from lodestrata.functions.text import parity_key, record_id
from lodestrata.functions.times import micros_of, parse_micros, text_of
from lodestrata.operators import changes
from lodestrata.operators.graph import active, dead_links
from lodestrata.operators.lexical import like_any
from lodestrata.operators.similar import near_duplicates
from lodestrata.plans.base import AS_OF, Queries, audit, edges, episodes, facts, notes, triples, vectors
from lodestrata.plans.general import _micros_sql
from lodestrata.sources.tables import table

Q = Queries()
#: Domains a record may have, and where strays go.
DOMAINS = ["Finance", "Home Systems", "Infrastructure", "Knowledge", "People", "Products-Research", "Programming", "Projects", "Social-Growth", "Workflows"]
REMAP = {d.lower(): d for d in DOMAINS} | {"infra": "Infrastructure", "misc": "Knowledge"}


@Q.add("SELECT domain, count(*) AS n, round(avg(importance), 6) AS avg_importance FROM f GROUP BY domain", "f")
def facts_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain", "importance")
    return f.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("avg_importance"))


@Q.add("SELECT id, importance, created_at FROM f ORDER BY importance DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 50", "f")
def facts_top_importance(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "importance", "created_at").select("id", "importance", "created_at")
    return f.orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("created_at"), "id").limit(50)


@Q.add(
    "SELECT id, domain, created_at FROM f WHERE created_at >= TIMESTAMP '2025-06-15' AND created_at < TIMESTAMP '2025-07-15' + INTERVAL 1 DAY", "f"
)
def facts_timeline(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain", "created_at").select("id", "domain", "created_at")
    start, end = F.to_timestamp_ntz(F.lit("2025-06-15 00:00:00")), F.to_timestamp_ntz(F.lit("2025-07-16 00:00:00"))
    return f.where((F.col("created_at") >= start) & (F.col("created_at") < end))


@Q.add("SELECT domain, count(*) AS n, count(*) FILTER (WHERE left(sha256(content), 16) = id) AS matching FROM f GROUP BY domain", "f")
def fact_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain", "content")
    return f.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(record_id(F.col("content")) == F.col("id"), 1)).alias("matching"))


@Q.add(
    """SELECT id, round(importance * 0.8, 6) AS score FROM f
WHERE contains(lower(coalesce(content, '')), 'restore drill') OR contains(lower(coalesce(title, '')), 'restore drill') OR contains(lower(coalesce(tags, '')), 'restore drill')""",
    "f",
)
def facts_like_search(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content", "title", "tags", "importance")
    hit = like_any([F.col("content"), F.col("title"), F.col("tags")], "restore drill")
    return f.where(hit).select("id", F.round(F.col("importance") * 0.8, 6).alias("score"))


@Q.add(
    "SELECT id, source, domain, importance FROM f WHERE source NOT IN ('auto_extracted', 'cron') AND domain IN ('Projects', 'Infrastructure') AND importance >= 0.7", "f"
)
def facts_filtered(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "source", "domain", "importance").select("id", "source", "domain", "importance")
    return f.where(~F.col("source").isin("auto_extracted", "cron") & F.col("domain").isin("Projects", "Infrastructure") & (F.col("importance") >= 0.7))


@Q.add(
    """SELECT id, coalesce(nullif(content, ''), '') AS content, coalesce(nullif(source, ''), 'agent') AS source, coalesce(importance, 0.5) AS importance,
coalesce(nullif(domain, ''), 'Knowledge') AS domain, coalesce(nullif(sensitivity, ''), 'internal') AS sensitivity, coalesce(access_count, 0) AS access_count FROM f""",
    "f",
)
def facts_defaults(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content", "source", "importance", "domain", "sensitivity", "access_count")
    fill = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return f.select(
        "id", fill("content", ""), fill("source", "agent"), F.coalesce("importance", F.lit(0.5)).alias("importance"),
        fill("domain", "Knowledge"), fill("sensitivity", "internal"), F.coalesce("access_count", F.lit(0)).cast("bigint").alias("access_count"),
    )


@Q.add(
    "SELECT domain, count(*) AS n, count(DISTINCT source_session) AS sessions, CAST(sum(length(summary)) AS BIGINT) AS chars FROM e GROUP BY domain", "e"
)
def episodes_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf, "domain", "source_session", "summary")
    return e.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_session").alias("sessions"), F.sum(F.length("summary")).alias("chars")
    )


@Q.add(
    f""", s AS (SELECT episode_id, domain, {_micros_sql("start_ts")} AS st, created_at FROM e)
SELECT episode_id, domain, strftime(st, '%Y-%m-%d %H:%M:%S') AS start_ts FROM s
WHERE st >= TIMESTAMP '2025-06-15' AND coalesce(st, created_at) < TIMESTAMP '2025-07-16'""",
    "e",
)
def episodes_window(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf, "domain", "start_ts").withColumn("st", parse_micros(F.col("start_ts")))
    start, end = (micros_of(F.to_timestamp_ntz(F.lit(x))) for x in ("2025-06-15 00:00:00", "2025-07-16 00:00:00"))
    e = e.where((F.col("st") >= start) & (F.coalesce("st", micros_of(F.col("created_at"))) < end))
    return e.select("episode_id", "domain", text_of(F.col("st")).alias("start_ts"))


@Q.add(
    """SELECT action, ok, count(*) AS n, count(DISTINCT fact_id) AS facts, min(ts) AS first_ts, max(ts) AS last_ts FROM a GROUP BY action, ok""", "a"
)
def audit_by_action(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(spark, sf, "action", "ok", "fact_id")
    return a.groupBy("action", "ok").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fact_id").alias("facts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """(day, status): OK for days with at most a twentieth of failures."""
    a = audit(spark, sf, "ok").where("ts IS NOT NULL")
    share = F.count(F.when(~F.coalesce("ok", F.lit(False)), 1)) / F.count(F.lit(1))
    return a.groupBy(F.to_date("ts").alias("day")).agg(F.when(share <= 0.05, "OK").otherwise("WARN").alias("status"))


@Q.add(
    """, d AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (WHERE NOT coalesce(ok, false)) / count(*) <= 0.05 THEN 'OK' ELSE 'WARN' END AS status FROM a WHERE ts IS NOT NULL GROUP BY 1),
i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM d WHERE status = 'OK')
SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days, max(day) = (SELECT max(day) FROM d) AS current, max(day) = (SELECT max(day) FROM d) AND count(*) >= 7 AS gate FROM i GROUP BY island""",
    "a",
)
def stability_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of clean days; only the run that ends with the log's newest day can open the gate."""
    # one row per day is left, so the global order is small whatever the log's size
    days = _days(spark, sf)
    island = F.date_sub("day", F.row_number().over(W.orderBy("day")))
    runs = days.where("status = 'OK'").withColumn("island", island).groupBy("island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))
    current = F.col("last_day") == F.col("newest")
    runs = runs.crossJoin(F.broadcast(days.agg(F.max("day").alias("newest"))))
    return runs.select("first_day", "last_day", "days", current.alias("current"), (current & (F.col("days") >= 7)).alias("gate"))


@Q.add(
    """, m AS (SELECT date_trunc('month', ts) AS m, round(count(*) FILTER (WHERE ok) / count(*), 4) AS rate FROM a WHERE ts IS NOT NULL GROUP BY 1),
l AS (SELECT m, rate, lag(rate) OVER (ORDER BY m) AS prev FROM m)
SELECT strftime(m, '%Y-%m') AS month, rate, CASE WHEN prev IS NULL THEN 'first' WHEN rate > prev + 0.001 THEN 'up' WHEN rate < prev - 0.001 THEN 'down' ELSE 'flat' END AS trend FROM l""",
    "a",
)
def parity_trend(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(spark, sf, "ok").where("ts IS NOT NULL")
    m = a.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.count(F.when(F.col("ok"), 1)) / F.count(F.lit(1)), 4).alias("rate"))
    prev = F.lag("rate").over(W.orderBy("month"))
    trend = F.when(F.col("prev").isNull(), "first").when(F.col("rate") > F.col("prev") + 0.001, "up").when(F.col("rate") < F.col("prev") - 0.001, "down").otherwise("flat")
    return m.withColumn("prev", prev).select("month", "rate", trend.alias("trend"))


@Q.add(
    "SELECT left(split_part(left(coalesce(detail, ''), 80), '=', 1), 40) AS kind, action, count(*) AS n FROM a WHERE NOT ok GROUP BY ALL", "a"
)
def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(spark, sf, "action", "ok", "detail").where(~F.col("ok"))
    kind = F.substring(F.substring_index(F.substring(F.coalesce("detail", F.lit("")), 1, 80), "=", 1), 1, 40)
    return a.groupBy(kind.alias("kind"), "action").agg(F.count(F.lit(1)).alias("n"))


@Q.add(
    """SELECT coalesce(v.model, '') AS model, count(*) AS facts, count(v.fid) AS embedded, round(100.0 * count(v.fid) / count(*), 1) AS pct
FROM f LEFT JOIN v ON v.fid = f.id GROUP BY 1""",
    "fv",
)
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    f, v = facts(spark, sf).select("id"), vectors(spark, sf, "model").select("fact_id", "model")
    return f.join(v, f["id"] == v["fact_id"], "left").groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(
        F.count(F.lit(1)).alias("facts"), F.count("fact_id").alias("embedded"), F.round(F.lit(100.0) * F.count("fact_id") / F.count(F.lit(1)), 1).alias("pct")
    )


@Q.add("SELECT fid AS fact_id FROM v WHERE NOT EXISTS (SELECT 1 FROM facts WHERE facts.id = v.fid)", "v")
def embedding_orphans(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("fact_id")
    return v.join(table(spark, sf, "facts", "id"), F.col("fact_id") == F.col("id"), "left_anti")


@Q.add(
    """, d AS (SELECT id, sha256(regexp_replace(lower(content), '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM f WHERE content IS NOT NULL),
c AS (SELECT k, min(id) AS keep_id, count(*) AS copies FROM d GROUP BY k)
SELECT keep_id, copies FROM c WHERE copies > 1""",
    "f",
)
def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    d = facts(spark, sf, "content").where("content IS NOT NULL")
    return d.groupBy(parity_key(F.col("content")).alias("k")).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("k")


@Q.add(
    """, s AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> ''))) AS w FROM f WHERE content IS NOT NULL),
c AS (SELECT w, min(id) AS class_id, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
x AS (SELECT class_id, unnest(w) AS word, n FROM c),
p AS (SELECT a.class_id AS x, b.class_id AS y FROM x a JOIN x b ON a.word = b.word AND a.class_id <> b.class_id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
      GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8 - 1e-9),
l AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT s.id, c.class_id, coalesce(l.links, 0) AS links FROM s JOIN c ON c.w = s.w LEFT JOIN l ON l.x = c.class_id""",
    "f",
)
def jaccard_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(facts(spark, sf, "content"), "id", F.col("content"))


@Q.add(
    f"""SELECT domain, count(*) AS n, CAST(sum(CASE WHEN created_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND coalesce(access_count, 0) <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS archived FROM f GROUP BY domain""",
    "f",
)
def archive_split(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain", "created_at", "access_count").select("domain", "created_at", "access_count")
    kept, archived = changes.consolidate(f, F.to_timestamp_ntz(F.lit(AS_OF)))
    both = kept.select("domain", F.lit(0).alias("x")).unionByName(archived.select("domain", F.lit(1).alias("x")))
    return both.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("archived"))


@Q.add(
    """, r AS (SELECT lower(trim(fact_id)) AS k, count(*) AS n, max(ts) AS at FROM a WHERE action = 'reinforce' AND ok GROUP BY 1)
SELECT f.id, coalesce(access_count, 0) + coalesce(n, 0) AS access_count, CASE WHEN last_accessed IS NULL THEN r.at WHEN r.at IS NULL THEN last_accessed ELSE greatest(last_accessed, r.at) END AS last_accessed
FROM f LEFT JOIN r ON r.k = f.id""",
    "fa",
)
def facts_reinforced(spark: SparkSession, sf: str) -> DataFrame:
    hits = audit(spark, sf, "action", "ok", "fact_id").where("action = 'reinforce' AND ok").select(F.lower(F.trim("fact_id")).alias("fact_id"), "ts")
    return changes.reinforced(facts(spark, sf, "access_count", "last_accessed").select("id", "access_count", "last_accessed"), hits)


@Q.add(
    """SELECT id, updated_at, importance, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS version
FROM (SELECT DISTINCT id, updated_at, importance FROM facts)"""
)
def version_history(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "facts", "id", "updated_at", "importance").distinct()
    return v.withColumn("version", F.row_number().over(W.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"))).cast("bigint"))


@Q.add(
    """, gone AS (SELECT DISTINCT lower(trim(fact_id)) AS k FROM a WHERE action = 'forget' AND ok AND fact_id IS NOT NULL)
SELECT 'facts' AS tab, count(*) AS left_over FROM f WHERE id NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'vectors', count(*) FROM v WHERE fid NOT IN (SELECT k FROM gone)""",
    "fva",
)
def forget_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = audit(spark, sf, "action", "ok", "fact_id").where("action = 'forget' AND ok").select(F.lower(F.trim("fact_id")).alias("key"))
    left = changes.forget({"facts": (facts(spark, sf), "id"), "vectors": (vectors(spark, sf), "fact_id")}, gone)
    parts = [df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(name).alias("tab"), "left_over") for name, df in left.items()]
    return parts[0].unionByName(parts[1])


@Q.add(
    """, q AS (SELECT lower(trim(fact_id)) AS k, max(ts) AS at FROM a WHERE action = 'quarantine' AND ok GROUP BY 1),
p AS (SELECT lower(trim(fact_id)) AS k, max(ts) AS at FROM a WHERE action = 'promote_pending' AND ok GROUP BY 1)
SELECT q.k AS fact_id, q.at AS quarantined_at FROM q LEFT JOIN p ON p.k = q.k AND p.at >= q.at WHERE p.k IS NULL AND q.k IS NOT NULL""",
    "a",
)
def pending_facts(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(spark, sf, "action", "ok", "fact_id").where("ok AND fact_id IS NOT NULL").withColumn("fact_id", F.lower(F.trim("fact_id")))
    at = a.where("action IN ('quarantine', 'promote_pending')").groupBy("fact_id").agg(
        F.max(F.when(F.col("action") == "quarantine", F.col("ts"))).alias("quarantined_at"), F.max(F.when(F.col("action") == "promote_pending", F.col("ts"))).alias("p")
    )
    return at.where("quarantined_at IS NOT NULL AND (p IS NULL OR p < quarantined_at)").select("fact_id", "quarantined_at")


@Q.add(
    f"""SELECT CASE WHEN domain IN ({", ".join(repr(d) for d in DOMAINS)}) THEN domain {" ".join(f"WHEN domain = {a!r} THEN {b!r}" for a, b in REMAP.items())} ELSE 'Knowledge' END AS domain, count(*) AS n FROM f GROUP BY 1""",
    "f",
)
def domain_remap(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain")
    return f.groupBy(changes.remapped(F.col("domain"), DOMAINS, REMAP).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@Q.add(
    f""", x AS (SELECT note_id, unnest(regexp_extract_all(body_preview, '\\[\\[([^\\]|]+)', 1)) AS link FROM n),
names AS (SELECT title AS k FROM n WHERE title IS NOT NULL UNION SELECT note_id FROM n)
SELECT DISTINCT 'dead-link' AS rule, note_id, trim(link) AS detail FROM x WHERE trim(link) NOT IN (SELECT k FROM names)
UNION ALL SELECT 'stub', note_id, CAST(length(coalesce(body_preview, '')) AS VARCHAR) FROM n WHERE length(coalesce(body_preview, '')) < 50
UNION ALL SELECT 'no-domain', note_id, '' FROM n WHERE coalesce(trim(domain), '') = ''
UNION ALL SELECT 'stale', note_id, strftime({_micros_sql("updated")}, '%Y-%m-%d') FROM n WHERE {_micros_sql("updated")} < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY""",
    "n",
)
def lint_rules(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "title", "domain", "body_preview").select("note_id", "title", "domain", "body_preview", parse_micros(F.col("updated")).alias("at"))
    size = F.length(F.coalesce("body_preview", F.lit("")))
    old = F.col("at") < micros_of(F.to_timestamp_ntz(F.lit(AS_OF))) - 90 * 86_400_000_000
    found = F.filter(
        F.array(
            F.struct(F.lit("stub").alias("rule"), F.when(size < 50, size.cast("string")).alias("detail")),
            F.struct(F.lit("no-domain").alias("rule"), F.when(F.coalesce(F.trim("domain"), F.lit("")) == "", F.lit("")).alias("detail")),
            F.struct(F.lit("stale").alias("rule"), F.when(old, F.substring(text_of(F.col("at")), 1, 10)).alias("detail")),
        ),
        lambda x: x["detail"].isNotNull(),
    )
    rules = n.select("note_id", F.explode(found).alias("x")).select("x.rule", "note_id", "x.detail")
    return rules.unionByName(dead_links(n).select(F.lit("dead-link").alias("rule"), "note_id", F.col("link").alias("detail")))


@Q.add(
    f"""(SELECT 'recent' AS part, id, domain FROM f WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY ORDER BY domain, created_at DESC, id LIMIT 30)
UNION ALL (SELECT 'long', id, domain FROM f WHERE content IS NOT NULL ORDER BY length(content) DESC, id LIMIT 20)""",
    "f",
)
def hotcache(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain", "created_at", "content").select("id", "domain", "created_at", F.length("content").alias("n"))
    since = F.to_timestamp_ntz(F.lit(AS_OF)) - F.make_dt_interval(F.lit(14))
    recent = f.where(F.col("created_at") >= since).orderBy(F.asc_nulls_last("domain"), F.desc("created_at"), "id").limit(30)
    long = f.where("n IS NOT NULL").orderBy(F.desc("n"), "id").limit(20)
    return recent.select(F.lit("recent").alias("part"), "id", "domain").unionByName(long.select(F.lit("long").alias("part"), "id", "domain"))


@Q.add(
    """SELECT 'facts' AS name, CASE WHEN count(*) = 0 THEN 'FAIL' ELSE 'OK' END AS status, count(*) AS value FROM f
UNION ALL SELECT 'vault', CASE WHEN count(*) = 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE coalesce(domain, '') = '') > 0 THEN 'WARN' ELSE 'OK' END, count(*) FILTER (WHERE coalesce(domain, '') = '') FROM n
UNION ALL SELECT 'embeddings', CASE WHEN count(*) FILTER (WHERE id NOT IN (SELECT fid FROM v WHERE fid IS NOT NULL)) > 0.1 * count(*) THEN 'WARN' ELSE 'OK' END, count(*) FILTER (WHERE id NOT IN (SELECT fid FROM v WHERE fid IS NOT NULL)) FROM f
UNION ALL SELECT 'episodes', CASE WHEN count(*) FILTER (WHERE start_ts IS NULL OR start_ts = '') > 0 THEN 'WARN' ELSE 'OK' END, count(*) FILTER (WHERE start_ts IS NULL OR start_ts = '') FROM e
UNION ALL SELECT 'triples', CASE WHEN count(*) FILTER (WHERE subject IS NULL OR object IS NULL) > 0 THEN 'FAIL' ELSE 'OK' END, count(*) FILTER (WHERE subject IS NULL OR object IS NULL) FROM t
UNION ALL SELECT 'audit', CASE WHEN count(*) FILTER (WHERE NOT ok) > 0.05 * count(*) THEN 'WARN' ELSE 'OK' END, count(*) FILTER (WHERE NOT ok) FROM a""",
    "fnveta",
)
def health_checks(spark: SparkSession, sf: str) -> DataFrame:
    f, v = facts(spark, sf).select("id"), vectors(spark, sf).select("fact_id")
    bad = lambda c: F.count(F.when(c, 1))
    total = F.count(F.lit(1))
    unembedded = f.join(v, f["id"] == v["fact_id"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [
        f.agg(total.alias("value"), F.when(total == 0, "FAIL").otherwise("OK").alias("status")).select(F.lit("facts").alias("name"), "status", "value"),
        *[
            df.agg(bad(c).alias("value"), F.when(F.lit(empty_fails) & (total == 0), "FAIL").when(bad(c) > share * total, level).otherwise("OK").alias("status")).select(F.lit(name).alias("name"), "status", "value")
            for name, df, c, share, level, empty_fails in (
                ("vault", notes(spark, sf, "domain"), blank("domain"), 0.0, "WARN", True),
                ("embeddings", unembedded, F.col("fact_id").isNull(), 0.1, "WARN", False),
                ("episodes", episodes(spark, sf, "start_ts"), blank("start_ts"), 0.0, "WARN", False),
                ("triples", triples(spark, sf, "subject", "object"), F.col("subject").isNull() | F.col("object").isNull(), 0.0, "FAIL", False),
                ("audit", audit(spark, sf, "ok"), ~F.col("ok"), 0.05, "WARN", False),
            )
        ],
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@Q.add(
    """, k AS (SELECT DISTINCT sha256(regexp_replace(lower(body_preview), '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM n WHERE body_preview IS NOT NULL)
SELECT 'facts' AS category, count(*) AS total, count(*) FILTER (WHERE sha256(regexp_replace(lower(content), '[^\\p{L}\\p{N}]', '', 'g')) NOT IN (SELECT k FROM k)) AS missing FROM f WHERE content IS NOT NULL
UNION ALL SELECT 'statements', count(*), count(*) FILTER (WHERE (lower(trim(subject)), 'triple:' || predicate, lower(trim(object))) NOT IN (SELECT lower(trim(source_id)), kind, lower(trim(target_id)) FROM g WHERE source_id IS NOT NULL AND kind IS NOT NULL AND target_id IS NOT NULL)) FROM t""",
    "fntg",
)
def parity_audit(spark: SparkSession, sf: str) -> DataFrame:
    there = notes(spark, sf, "body_preview").where("body_preview IS NOT NULL").select(parity_key(F.col("body_preview")).alias("k")).distinct().withColumn("hit", F.lit(1))
    f = facts(spark, sf, "content").where("content IS NOT NULL").select(parity_key(F.col("content")).alias("k")).join(there, "k", "left")
    norm = lambda c: F.lower(F.trim(c))
    g = edges(spark, sf, "source_id", "target_id", "kind").select(norm("source_id").alias("s"), F.col("kind").alias("p"), norm("target_id").alias("o")).distinct().withColumn("hit", F.lit(1))
    t = triples(spark, sf, "subject", "predicate", "object").select(norm("subject").alias("s"), F.concat(F.lit("triple:"), "predicate").alias("p"), norm("object").alias("o")).join(g, ["s", "p", "o"], "left")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hit").isNull(), 1)).alias("missing")).select(F.lit(name).alias("category"), "total", "missing")
    return count(f, "facts").unionByName(count(t, "statements"))


@Q.add(
    f"""SELECT * FROM (SELECT id, concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{kind}' END" for kind, p, _ in PERSONAL)}) AS types FROM f) WHERE types <> ''""", "f"
)
def pii_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content")
    return f.select("id", F.array_join(personal_types(F.col("content")), ",").alias("types")).where("types <> ''")


@Q.add(
    """, m AS (SELECT episode_id, source_session, created_at, row_number() OVER (PARTITION BY source_session ORDER BY created_at, episode_id) AS rn FROM e WHERE source_session NOT LIKE 'cron%' AND created_at IS NOT NULL)
SELECT source_session, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, min(CASE WHEN rn = 1 THEN episode_id END) AS first_id FROM m GROUP BY source_session""",
    "e",
)
def episodes_per_session(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf, "source_session").where(~F.col("source_session").startswith("cron") & F.col("created_at").isNotNull())
    return e.groupBy("source_session").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.min_by("episode_id", F.struct("created_at", "episode_id")).alias("first_id"),
    )


@Q.add("SELECT count(*) AS n_notes, count(DISTINCT domain) AS domains, count(*) FILTER (WHERE note_type = 'moc') AS mocs, round(avg(importance), 6) AS avg_importance FROM n", "n")
def index_status(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "domain", "note_type", "importance")
    return n.agg(
        F.count(F.lit(1)).alias("n_notes"), F.countDistinct("domain").alias("domains"), F.count(F.when(F.col("note_type") == "moc", 1)).alias("mocs"),
        F.round(F.avg("importance"), 6).alias("avg_importance"),
    )


@Q.add(
    """SELECT episode_id, title FROM e WHERE source_session IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.session_id = e.source_session AND f.importance >= 0.9)""", "ef"
)
def episodes_without_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes whose session left no fact of importance."""
    e = episodes(spark, sf, "title", "source_session").where("source_session IS NOT NULL")
    sessions = facts(spark, sf, "session_id", "importance").where("importance >= 0.9").select(F.col("session_id").alias("source_session")).where("source_session IS NOT NULL").distinct()
    return e.join(sessions, "source_session", "left_anti").select("episode_id", "title")


@Q.add(
    """SELECT subject, predicate, object, valid_from, confidence FROM t WHERE (valid_until IS NULL OR valid_until = '') AND confidence >= 0.7 AND source = 'manual'""", "t"
)
def triple_active(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "subject", "predicate", "object", "valid_from", "valid_until", "confidence", "source")
    return t.where(active(F.col("valid_until")) & (F.col("confidence") >= 0.7) & (F.col("source") == "manual")).select("subject", "predicate", "object", "valid_from", "confidence")


@Q.add(
    """SELECT domain, count(*) AS n, count(*) FILTER (WHERE left(sha256(content), 16) IN (SELECT id FROM f)) AS found FROM f WHERE content IS NOT NULL GROUP BY domain""", "f"
)
def self_recall(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content", "domain")
    checked = changes.recalled(f.where("content IS NOT NULL"), f)
    return checked.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("found"), 1)).alias("found"))


@Q.add()
def write_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Every fact as if it came in again: decision, tier, and whether its id is there after redaction."""
    f = facts(spark, sf, "content", "domain", "source", "sensitivity")
    decided = changes.remembered(f, f)
    return decided.groupBy("action", "tier", "exists").agg(F.count(F.lit(1)).alias("n"))


@Q.add(
    """, x AS (SELECT '[' || coalesce(domain, 'misc') || '] ' || coalesce(title, '') || ': ' || coalesce(body_preview, '') AS content, title,
list_filter(['imported', lower(domain), lower(title)], lambda t: t IS NOT NULL) AS tags FROM n)
SELECT left(sha256(content), 16) AS id, min(content) AS content, min(title) AS title, 0.85::DOUBLE AS importance, min(tags) AS tags, 'import' AS source FROM x GROUP BY 1""",
    "n",
)
def imported_notes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.imported(notes(spark, sf, "domain", "title", "body_preview"), "domain", "title", "body_preview")
