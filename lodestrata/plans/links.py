"""Queries over statements, notes' links and the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import link_contexts
from lodestrata.operators import changes
from lodestrata.operators.graph import active, both_ways, dead_links, induced, note_links, reached, shortest_paths, strongest
from lodestrata.plans.base import Queries, edges, notes, triples

Q = Queries()

# fixed values: colours of domains and shapes of note types in exports
COLOURS = {
    "Infrastructure": "#1DCF8E", "Finance": "#FFB800", "Workflows": "#7C4DFF", "People": "#FF6B6B", "Knowledge": "#4FC3F7",
    "Products-Research": "#FF9800", "Projects": "#9CCC65",
}
DEFAULT_COLOUR = "#888888"
SHAPES = {"permanent": "circle", "literature": "square", "moc": "diamond", "index": "triangle", "log": "triangle"}

_EDGE_SQL = "(SELECT trim(source_id) AS s, trim(target_id) AS o, kind, weight FROM g WHERE kind = 'wikilink' AND target_id IS NOT NULL AND source_id IS NOT NULL)"


def _wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    g = edges(spark, sf, "source_id", "target_id", "kind", "weight").where("kind = 'wikilink' AND target_id IS NOT NULL AND source_id IS NOT NULL")
    return g.select(F.trim("source_id").alias("source_id"), F.trim("target_id").alias("target_id"), "weight")


@Q.add("SELECT coalesce(source, '') AS source, count(*) AS n, count(DISTINCT subject) AS subjects, round(avg(confidence), 6) AS avg_confidence FROM t GROUP BY 1", "t")
def triple_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "subject", "source", "confidence")
    return t.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


@Q.add(
    """SELECT subject, predicate, count(DISTINCT object) AS n_objects, string_agg(DISTINCT object, '; ' ORDER BY object) AS objects FROM t
WHERE valid_until IS NULL OR valid_until = '' GROUP BY subject, predicate HAVING count(DISTINCT object) > 1 ORDER BY 3 DESC, subject, predicate LIMIT 50""",
    "t",
)
def triple_inconsistencies(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "subject", "predicate", "object", "valid_until").where(active(F.col("valid_until")))
    # distinct objects first: the group that is listed holds one row per object
    objects = t.select("subject", "predicate", "object").distinct()
    conflicts = objects.groupBy("subject", "predicate").agg(F.count("object").alias("n_objects")).where("n_objects > 1")
    top = conflicts.orderBy(F.desc("n_objects"), "subject", "predicate").limit(50)
    listed = objects.join(F.broadcast(top), ["subject", "predicate"]).groupBy("subject", "predicate", "n_objects").agg(F.array_sort(F.collect_list("object")).alias("o"))
    return listed.select("subject", "predicate", "n_objects", F.array_join("o", "; ").alias("objects"))


@Q.add(
    """SELECT id, subject, predicate, object, confidence FROM t QUALIFY row_number() OVER (PARTITION BY lower(subject), lower(predicate), lower(object) ORDER BY confidence DESC NULLS LAST, id) = 1""",
    "t",
)
def triple_backfill_dedup(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "subject", "predicate", "object", "confidence")
    key = [F.lower(c).alias(f"_{c}") for c in ("subject", "predicate", "object")]
    # an aggregate instead of a window: partial results before the shuffle, no hot group in one task
    best = F.min_by(F.struct("id", "subject", "predicate", "object", "confidence"), F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "id"))
    return t.groupBy(*key).agg(best.alias("r")).select("r.*")


@Q.add(
    """, b AS (SELECT subject AS entity, object AS other, predicate, confidence FROM t WHERE valid_until IS NULL OR valid_until = '' UNION ALL SELECT object, subject, predicate, confidence FROM t WHERE valid_until IS NULL OR valid_until = '')
SELECT entity, other, predicate, confidence FROM b WHERE entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY confidence DESC NULLS LAST, other, predicate) <= 3""",
    "t",
)
def triple_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "subject", "predicate", "object", "valid_until", "confidence").where(active(F.col("valid_until")))
    b = both_ways(t, "subject", "object", "predicate", "confidence").where("node IS NOT NULL")
    best = strongest(b, "node", [F.desc_nulls_last("confidence"), F.asc("other"), F.asc("predicate")], 3)
    return best.select(F.col("node").alias("entity"), "other", "predicate", "confidence")


@Q.add("SELECT DISTINCT subject AS source_id, object AS target_id, 'triple:' || predicate AS kind, 1 AS weight FROM t", "t")
def triple_mirror_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "subject", "predicate", "object")
    return t.select(F.col("subject").alias("source_id"), F.col("object").alias("target_id"), F.concat(F.lit("triple:"), "predicate").alias("kind")).distinct().withColumn("weight", F.lit(1))


@Q.add(
    """, o AS (SELECT * FROM t WHERE coalesce(source, '') <> 'import' QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY id DESC) = 1),
w AS (SELECT * FROM t WHERE source = 'import' QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY id DESC) = 1)
SELECT coalesce(w.subject, o.subject) AS subject, coalesce(w.predicate, o.predicate) AS predicate, coalesce(w.object, o.object) AS object,
coalesce(w.valid_from, o.valid_from) AS valid_from, CASE WHEN w.id IS NOT NULL THEN w.valid_until ELSE o.valid_until END AS valid_until,
CASE WHEN w.id IS NOT NULL THEN w.source ELSE o.source END AS source, CASE WHEN w.id IS NOT NULL THEN w.confidence ELSE o.confidence END AS confidence
FROM o FULL OUTER JOIN w ON w.subject = o.subject AND w.predicate = o.predicate AND w.object = o.object""",
    "t",
)
def triple_upsert(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("subject", "predicate", "object", "valid_from", "valid_until", "source", "confidence")
    t = triples(spark, sf, *cols).select("id", *cols)
    keys = ["subject", "predicate", "object"]
    once = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct("valid_from", "valid_until", "source", "confidence"), "id").alias("r")).select(*keys, "r.*")
    imported = F.coalesce(F.col("source") == "import", F.lit(False))
    return changes.upsert_statements(once(t.where(~imported)), once(t.where(imported)))


@Q.add(
    """, titles AS (SELECT regexp_replace(trim(title), '^Moc ', '') AS title, max(note_id) AS target_id FROM n WHERE title IS NOT NULL GROUP BY 1),
l AS (SELECT note_id AS source_id, trim(unnest(regexp_extract_all(body_preview, '\\[\\[([^\\]|]+)', 1))) AS title FROM n)
SELECT source_id, target_id, count(*) AS weight FROM l JOIN titles USING (title) WHERE source_id <> target_id GROUP BY ALL""",
    "n",
)
def edge_build(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "title", "body_preview")
    return note_links(n.withColumn("title", F.regexp_replace(F.trim("title"), "^Moc ", "")))


@Q.add(
    """, names AS (SELECT title AS k FROM n WHERE title IS NOT NULL UNION SELECT note_id FROM n)
SELECT DISTINCT note_id, link FROM (SELECT note_id, trim(unnest(regexp_extract_all(body_preview, '\\[\\[([^\\]|]+)', 1))) AS link FROM n) WHERE link NOT IN (SELECT k FROM names)""",
    "n",
)
def dead_link_report(spark: SparkSession, sf: str) -> DataFrame:
    return dead_links(notes(spark, sf, "title", "body_preview"))


@Q.add(
    f""", w AS (SELECT s, o, CAST(sum(weight) AS BIGINT) AS weight FROM {_EDGE_SQL} GROUP BY ALL)
SELECT o AS note_id, s AS source_id, weight FROM w QUALIFY row_number() OVER (PARTITION BY o ORDER BY weight DESC NULLS LAST, s) <= 5""",
    "g",
)
def backlinks_topk(spark: SparkSession, sf: str) -> DataFrame:
    w = _wikilinks(spark, sf).groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))
    # the best five of each salted part first, so the hot target's sources meet in small numbers only
    order = [F.desc_nulls_last("weight"), F.asc("source_id")]
    parts = w.withColumn("salt", F.pmod(F.xxhash64("source_id"), F.lit(16)))
    parts = parts.withColumn("_n", F.row_number().over(W.partitionBy("target_id", "salt").orderBy(*order))).where("_n <= 5").drop("_n", "salt")
    return strongest(parts, "target_id", order, 5).select(F.col("target_id").alias("note_id"), "source_id", "weight")


@Q.add(
    f"""SELECT n1.domain AS from_domain, n2.domain AS to_domain, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM {_EDGE_SQL} x JOIN n n1 ON n1.note_id = x.s JOIN n n2 ON n2.note_id = x.o GROUP BY ALL""",
    "gn",
)
def edges_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    w = _wikilinks(spark, sf)
    # aggregate per target before its domain is looked up: the hot target is a few rows by then
    n = notes(spark, sf, "domain").select("note_id", "domain")
    per = w.join(n.select(F.col("note_id").alias("source_id"), F.col("domain").alias("from_domain")), "source_id")
    per = per.groupBy("from_domain", "target_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    per = per.join(n.select(F.col("note_id").alias("target_id"), F.col("domain").alias("to_domain")), "target_id")
    return per.groupBy("from_domain", "to_domain").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


@Q.add("SELECT kind, count(*) AS links, count(DISTINCT trim(source_id)) AS sources, count(DISTINCT trim(target_id)) AS targets FROM g GROUP BY kind", "g")
def link_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = edges(spark, sf, "kind", "source_id", "target_id")
    return g.groupBy("kind").agg(F.count(F.lit(1)).alias("links"), F.countDistinct(F.trim("source_id")).alias("sources"), F.countDistinct(F.trim("target_id")).alias("targets"))


def _top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf, "title", "domain", "note_type", "importance").orderBy(F.desc_nulls_last("importance"), "note_id").limit(500)


_NODES_SQL = "nodes AS (SELECT * FROM n ORDER BY importance DESC NULLS LAST, note_id LIMIT 500)"


@Q.add(
    f""", {_NODES_SQL} SELECT note_id, title, domain, importance, CASE {" ".join(f"WHEN domain = '{d}' THEN '{c}'" for d, c in COLOURS.items())} ELSE '{DEFAULT_COLOUR}' END AS color,
CASE {" ".join(f"WHEN note_type = '{d}' THEN '{c}'" for d, c in SHAPES.items())} ELSE 'circle' END AS shape FROM nodes""",
    "n",
)
def graph_export_nodes(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda col, table, default: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(F.col(col), F.lit(""))), F.lit(default))
    return _top_nodes(spark, sf).select("note_id", "title", "domain", "importance", pick("domain", COLOURS, DEFAULT_COLOUR).alias("color"), pick("note_type", SHAPES, "circle").alias("shape"))


@Q.add(
    f""", {_NODES_SQL} SELECT s AS source_id, o AS target_id, CAST(sum(weight) AS BIGINT) AS weight FROM {_EDGE_SQL} WHERE s IN (SELECT note_id FROM nodes) AND o IN (SELECT note_id FROM nodes) GROUP BY ALL""",
    "ng",
)
def graph_export_edges(spark: SparkSession, sf: str) -> DataFrame:
    kept = induced(_top_nodes(spark, sf), _wikilinks(spark, sf))
    return kept.groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))


@Q.add(
    f""", {_NODES_SQL} SELECT '"' || s || '" -> "' || o || '" [penwidth=' || printf('%.1f', 0.5 + 0.5 * sum(weight)) || '];' AS line FROM {_EDGE_SQL} WHERE s IN (SELECT note_id FROM nodes) AND o IN (SELECT note_id FROM nodes) GROUP BY s, o""",
    "ng",
)
def dot_lines(spark: SparkSession, sf: str) -> DataFrame:
    kept = induced(_top_nodes(spark, sf), _wikilinks(spark, sf)).groupBy("source_id", "target_id").agg(F.sum("weight").alias("w"))
    return kept.select(F.format_string('"%s" -> "%s" [penwidth=%.1f];', "source_id", "target_id", F.lit(0.5) + F.col("w") * 0.5).alias("line"))


@Q.add(
    """, c AS (SELECT note_id, row_number() OVER (ORDER BY importance DESC NULLS LAST, note_id) - 1 AS i FROM (SELECT * FROM n ORDER BY importance DESC NULLS LAST, note_id LIMIT 100))
SELECT note_id, CAST(i % 5 * 400 AS BIGINT) AS x, CAST(i // 5 * 400 AS BIGINT) AS y FROM c""",
    "n",
)
def canvas_layout(spark: SparkSession, sf: str) -> DataFrame:
    top = notes(spark, sf, "importance").orderBy(F.desc_nulls_last("importance"), "note_id").limit(100)
    # a hundred rows by now
    i = F.row_number().over(W.orderBy(F.desc_nulls_last("importance"), "note_id")) - 1
    return top.withColumn("i", i).select("note_id", (F.col("i") % 5 * 400).cast("bigint").alias("x"), (F.floor(F.col("i") / 5) * 400).cast("bigint").alias("y"))


@Q.add(
    f""", seeds AS (SELECT note_id FROM n WHERE note_type = 'moc'), b AS (SELECT DISTINCT s, o FROM {_EDGE_SQL} WHERE s <> o), b2 AS (SELECT s AS node, o AS other FROM b UNION SELECT o, s FROM b),
h1 AS (SELECT DISTINCT note_id AS seed, other AS node FROM seeds JOIN b2 ON b2.node = note_id WHERE other <> note_id),
h2 AS (SELECT DISTINCT seed, other AS node FROM h1 JOIN b2 USING (node) WHERE other <> seed AND (seed, other) NOT IN (SELECT seed, node FROM h1))
SELECT seed, hops, count(*) AS nodes FROM (SELECT seed, 1 AS hops FROM h1 UNION ALL SELECT seed, 2 FROM h2) GROUP BY ALL""",
    "ng",
)
def wikilink_hops(spark: SparkSession, sf: str) -> DataFrame:
    seeds = notes(spark, sf, "note_type").where("note_type = 'moc'").select(F.col("note_id").alias("node"))
    near = reached(seeds, both_ways(_wikilinks(spark, sf), "source_id", "target_id"), 2)
    return near.where("hops > 0").groupBy("seed", "hops").agg(F.count(F.lit(1)).alias("nodes"))


@Q.add(
    """, b AS (SELECT subject AS node, object AS other FROM t WHERE subject <> object UNION SELECT object, subject FROM t WHERE subject <> object),
start AS (SELECT min(object) AS seed FROM t),
r AS (SELECT seed, seed AS node, 0 AS hops FROM start UNION SELECT seed, other, hops + 1 FROM r JOIN b USING (node) WHERE hops < 2)
SELECT node, min(hops) AS hops FROM r GROUP BY node""",
    "t",
)
def triple_reach(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf, "subject", "object")
    seed = t.agg(F.min("object").alias("node"))
    return shortest_paths(seed, both_ways(t, "subject", "object"), 2).select("node", "hops")


@Q.add()
def triple_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(seed, node, hops, path) within four steps of the subjects of statements whose id is divisible by 50."""
    t = triples(spark, sf, "subject", "object")
    seeds = t.where("id % 50 = 0 AND subject IS NOT NULL").select(F.col("subject").alias("node"))
    return shortest_paths(seeds, both_ways(t, "subject", "object"))


@Q.add(
    """, l AS (SELECT domain, note_id, title, importance, row_number() OVER (PARTITION BY domain ORDER BY importance DESC NULLS LAST, note_id) AS pos FROM n)
SELECT domain, pos, '- [[' || coalesce(title, note_id) || ']]' AS line FROM l""",
    "n",
)
def map_of_content(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "domain", "title", "importance")
    pos = F.row_number().over(W.partitionBy("domain").orderBy(F.desc_nulls_last("importance"), "note_id")).cast("bigint")
    return n.select("domain", pos.alias("pos"), F.concat(F.lit("- [["), F.coalesce("title", "note_id"), F.lit("]]")).alias("line"))


@Q.add()
def store_links(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "title", "body_preview")
    links = n.select(F.col("note_id").alias("source_id"), F.posexplode(link_contexts(F.col("body_preview"))).alias("pos", "x")).select("source_id", "pos", "x.*")
    return links.groupBy("source_id", "target").agg(F.min_by("context", "pos").alias("context"))
