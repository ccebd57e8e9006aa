"""Queries of recall, episode search, ordered lists and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import phrases
from lodestrata.operators import changes, lexical
from lodestrata.plans.base import AS_OF, Queries, audit, edges, episodes, facts, notes, triples

Q = Queries()

#: What the recall query asks for, with the date phrase in it.
ASKED = "prompt router in may"

_WORDS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_HIT = " OR ".join(f"len(list_filter({_WORDS.format(c)}, lambda x: starts_with(x, '{w}'))) > 0" for c in ("content", "title", "tags") for w in ("prompt", "router"))


@Q.add(
    f""", w AS (SELECT id, content, importance FROM f WHERE created_at >= TIMESTAMP '2026-05-01' AND created_at < TIMESTAMP '2026-06-01' AND ({_HIT} OR content = 'prompt router' OR id = left(sha256('prompt router'), 16)))
SELECT id, coalesce(content = 'prompt router', false) OR id = left(sha256('prompt router'), 16) AS exact FROM w ORDER BY 2 DESC, importance DESC NULLS LAST, id LIMIT 50""",
    "f",
)
def recall(spark: SparkSession, sf: str) -> DataFrame:
    """Exact hits first, then facts with a word that begins like one asked for, within the time the query names; if
    there are none, facts that contain the query."""
    f = facts(spark, sf, "content", "title", "tags", "importance", "created_at")
    asked = spark.range(1).select(F.lit(ASKED).alias("q"))
    asked = asked.select(phrases.without_phrases(F.col("q")).alias("q"), phrases.date_range(F.col("q"), F.to_date(F.lit(AS_OF[:10]))).alias("span"))
    query = asked.select("q", "span.*").first()
    return lexical.recalled(f, query.q, query.from_date, query.to_date).select("id", "exact").limit(50)


@Q.add(
    f"""SELECT episode_id FROM e WHERE len(list_filter({_WORDS.format("concat_ws(' ', title, summary, domain)")}, lambda x: x = 'prompt')) > 0 AND len(list_filter({_WORDS.format("concat_ws(' ', title, summary, domain)")}, lambda x: x = 'router')) > 0""",
    "e",
)
def episode_search(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes that hold all words of the query; marks in it separate words and raise no error."""
    e = episodes(spark, sf, "title", "summary", "domain")
    return e.where(lexical.all_terms(F.concat_ws(" ", "title", "summary", "domain"), "prompt? -router")).select("episode_id")


@Q.add("SELECT episode_id, start_ts, created_at FROM e ORDER BY start_ts NULLS FIRST, created_at NULLS FIRST, episode_id LIMIT 100", "e")
def episodes_listed(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf, "start_ts").select("episode_id", "start_ts", "created_at")
    return e.orderBy(F.asc_nulls_first("start_ts"), F.asc_nulls_first("created_at"), "episode_id").limit(100)


@Q.add("SELECT id, confidence, created_at FROM t ORDER BY confidence DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 100", "t")
def triples_listed(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "confidence").select("id", "confidence", "created_at")
    return t.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("created_at"), "id").limit(100)


@Q.add("SELECT id, action, ts FROM a ORDER BY id DESC NULLS LAST LIMIT 100", "a")
def audit_listed(spark: SparkSession, sf: str) -> DataFrame:
    return audit(spark, sf, "action").select("id", "action", "ts").orderBy(F.desc_nulls_last("id")).limit(100)


@Q.add(
    """SELECT (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM g WHERE kind = 'wikilink') AS edge_count, (SELECT count(DISTINCT domain) FROM n) AS domains, (SELECT max(importance) FROM n) AS max_importance""",
    "ng",
)
def export_meta(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "domain", "importance").agg(F.count(F.lit(1)).alias("node_count"), F.countDistinct("domain").alias("domains"), F.max("importance").alias("max_importance"))
    g = edges(spark, sf, "kind").where("kind = 'wikilink'").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.crossJoin(F.broadcast(g)).select("node_count", "edge_count", "domains", "max_importance")


@Q.add(
    """, d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE NOT ok) / count(*) AS bad FROM a WHERE ts IS NOT NULL GROUP BY 1),
s AS (SELECT date_trunc('month', day) AS m, CASE WHEN bad > 0.2 THEN 2 WHEN bad > 0.05 THEN 1 ELSE 0 END AS level FROM d)
SELECT strftime(m, '%Y-%m') AS month, CASE max(level) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'OK' END AS status, count(*) AS days FROM s GROUP BY m""",
    "a",
)
def health_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The worst status of each month's days: FAIL before WARN before OK."""
    a = audit(spark, sf, "ok").where("ts IS NOT NULL")
    bad = a.groupBy(F.to_date("ts").alias("day")).agg((F.count(F.when(~F.col("ok"), 1)) / F.count(F.lit(1))).alias("bad"))
    level = F.when(F.col("bad") > 0.2, 2).when(F.col("bad") > 0.05, 1).otherwise(0)
    worst = bad.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.max(level).alias("level"), F.count(F.lit(1)).alias("days"))
    return worst.select("month", F.element_at(F.array(F.lit("OK"), F.lit("WARN"), F.lit("FAIL")), F.col("level") + 1).alias("status"), "days")


@Q.add("SELECT note_id, left(sha256(coalesce(title, '') || chr(10) || coalesce(body_preview, '')), 16) AS content_id FROM n", "n")
def note_content_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "title", "body_preview")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body_preview", F.lit("")))
    return n.select("note_id", F.substring(F.sha2(text, 256), 1, 16).alias("content_id"))


@Q.add(
    """SELECT episode_id, regexp_extract(summary, '(?i).{0,80}prompt router.{0,120}') AS snippet FROM e WHERE contains(lower(summary), 'prompt router')""", "e"
)
def entity_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The first mention of an entity with what stands around it on its line."""
    e = episodes(spark, sf, "summary").where(F.contains(F.lower("summary"), F.lit("prompt router")))
    return e.select("episode_id", F.regexp_extract("summary", r"(?i).{0,80}\Qprompt router\E.{0,120}", 0).alias("snippet"))


@Q.add(
    """, k AS (SELECT note_id, title, lower(trim(title)) AS folded FROM n WHERE coalesce(trim(title), '') <> '' AND lower(trim(title)) NOT IN ('index', 'readme', 'untitled', 'home'))
SELECT folded, min(note_id) AS note_id, count(*) AS notes FROM k GROUP BY folded""",
    "n",
)
def titles_folded(spark: SparkSession, sf: str) -> DataFrame:
    """One note for each title, letter case aside, without titles that name nothing."""
    folded = F.lower(F.trim("title"))
    n = notes(spark, sf, "title").where((F.coalesce(folded, F.lit("")) != "") & ~folded.isin("index", "readme", "untitled", "home"))
    return n.groupBy(folded.alias("folded")).agg(F.min("note_id").alias("note_id"), F.count(F.lit(1)).alias("notes"))


@Q.add(
    """, gone AS (SELECT DISTINCT trim(detail) AS k FROM a WHERE action = 'delete_note' AND ok AND detail IS NOT NULL)
SELECT kind, count(*) AS links FROM g WHERE source_id IS NOT NULL AND trim(source_id) NOT IN (SELECT k FROM gone) GROUP BY kind""",
    "ga",
)
def links_after_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """The links left when those of removed notes are deleted."""
    gone = audit(spark, sf, "action", "ok", "detail").where("action = 'delete_note' AND ok").select(F.trim("detail").alias("key"))
    g = edges(spark, sf, "source_id", "kind").where("source_id IS NOT NULL").select(F.trim("source_id").alias("source_id"), "kind")
    left = changes.forget({"links": (g, "source_id")}, gone)["links"]
    return left.groupBy("kind").agg(F.count(F.lit(1)).alias("links"))


@Q.add(
    """SELECT n.note_id, CASE WHEN x.note_id IS NULL THEN 0 ELSE x.links END AS links FROM n LEFT JOIN (SELECT trim(source_id) AS note_id, count(*) AS links FROM g WHERE kind = 'wikilink' GROUP BY 1) x ON x.note_id = n.note_id""",
    "ng",
)
def notes_with_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every note with the number of its links, none among them."""
    links = edges(spark, sf, "source_id", "kind").where("kind = 'wikilink'").groupBy(F.trim("source_id").alias("note_id")).agg(F.count(F.lit(1)).alias("links"))
    return notes(spark, sf).select("note_id").join(links, "note_id", "left").select("note_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


@Q.add(
    """, w AS (SELECT DISTINCT trim(source_id) AS s, trim(target_id) AS o FROM g WHERE kind = 'wikilink' AND source_id IS NOT NULL AND target_id IS NOT NULL AND trim(source_id) <> trim(target_id)),
seeds AS (SELECT note_id AS seed FROM n WHERE note_type = 'moc'),
x AS (SELECT seed, o AS node, 'outgoing' AS way FROM seeds JOIN w ON s = seed UNION ALL SELECT seed, s, 'incoming' FROM seeds JOIN w ON o = seed),
b AS (SELECT seed, node, max(way) AS way FROM x GROUP BY ALL)
SELECT seed, way, count(*) AS nodes FROM b GROUP BY ALL""",
    "ng",
)
def connected_by_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of each index note by direction; a note linked both ways counts as outgoing, as it is met first."""
    from lodestrata.operators.graph import directed_neighbours

    g = edges(spark, sf, "source_id", "target_id", "kind").where("kind = 'wikilink'")
    links = g.select(F.trim("source_id").alias("source_id"), F.trim("target_id").alias("target_id"))
    seeds = notes(spark, sf, "note_type").where("note_type = 'moc'").select(F.col("note_id").alias("node"))
    return directed_neighbours(seeds, links).groupBy("seed", "way").agg(F.count(F.lit(1)).alias("nodes"))



@Q.add()
def recall_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by the stems of content, title and tags, the fifty best; checked against a full-text engine in the tests."""
    f = facts(spark, sf, "content", "title", "tags")
    hits = lexical.bm25_stemmed(f, "id", ["content", "title", "tags"], "prompts routing sessions")
    return hits.select(F.col("doc").alias("id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@Q.add()
def notes_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "title", "tags", "body_preview")
    hits = lexical.bm25_stemmed(n, "note_id", ["title", "tags", "body_preview"], "retention windows")
    return hits.select(F.col("doc").alias("note_id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "note_id").limit(50)
