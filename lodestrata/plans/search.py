"""Retrieval queries: full text, vectors, fusion, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.operators import embed, lexical, retrieval, scoring
from lodestrata.operators import vectors as vec
from lodestrata.operators.graph import both_ways
from lodestrata.plans.base import AS_OF, Queries, edges, facts, notes, triples, vectors
from lodestrata.sources.tables import table

Q = Queries()

#: The words the single-query searches ask for.
TERMS = ["prompt", "router", "session"]

BM25_SQL = """, d AS (SELECT id, CAST(len(w) AS DOUBLE) AS dl, {tf} FROM (SELECT id, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM f WHERE content IS NOT NULL)),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM d),
b AS (SELECT id, {score} AS score FROM d, st WHERE {hit})""".format(
    tf=", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(TERMS)),
    df=", ".join(f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(TERMS))),
    score=" + ".join(
        f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"
        for i in range(len(TERMS))
    ),
    hit=" OR ".join(f"tf{i} > 0" for i in range(len(TERMS))),
)


@Q.add(BM25_SQL + " SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 50", "f")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical.bm25(facts(spark, sf, "content").where("content IS NOT NULL"), "id", F.col("content"), TERMS)
    return hits.select(F.col("doc").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@Q.add(
    BM25_SQL
    + f""", c AS (SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 40),
r AS (SELECT c.id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END
 * coalesce(exp(-ln(2) / 30 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_accessed), 0) / 86400000000.0), 1.0) * (1 + 0.1 * least(coalesce(access_count, 0), 10)) AS s FROM c JOIN f USING (id))
SELECT id, round(s, 6) AS score FROM r WHERE round(s, 6) >= 0.05 ORDER BY round(s, 6) DESC, id LIMIT 20""",
    "f",
)
def recall_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: BM25, twice the wanted number, normalised, decayed, reinforced, cut at a threshold, the best twenty."""
    f = facts(spark, sf, "content", "last_accessed", "access_count")
    hits = lexical.bm25(f.where("content IS NOT NULL"), "id", F.col("content"), TERMS)
    top = hits.select(F.col("doc").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(40)
    # forty rows: their extremes and their facts are looked up by broadcast
    scored = f.select("id", "last_accessed", "access_count").join(F.broadcast(top), "id")
    score = scoring.normalised(F.col("score"), []) * scoring.decay(F.col("last_accessed"), AS_OF) * scoring.reinforcement(F.col("access_count"))
    return scored.select("id", F.round(score, 6).alias("score")).where("score >= 0.05").orderBy(F.desc("score"), "id").limit(20)


@Q.add(
    """, q AS (SELECT id AS query, subject FROM t WHERE id % 50 = 0),
p AS (SELECT id, CAST(len(w) AS DOUBLE) AS dl, unnest(w) AS term FROM (SELECT id, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM f WHERE content IS NOT NULL)),
tf AS (SELECT id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM p GROUP BY ALL), df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS avgdl FROM f WHERE content IS NOT NULL),
qt AS (SELECT DISTINCT query, unnest(list_filter(string_split_regex(lower(subject), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM q),
s AS (SELECT query, id AS doc, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY query, id)
SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 10""",
    "ft",
)
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    # stated query set: every statement whose id is divisible by 50 asks for its subject
    asked = triples(spark, sf, "subject").where("id % 50 = 0")
    f = facts(spark, sf, "content").where("content IS NOT NULL")
    return lexical.bm25_batch(f, "id", F.col("content"), asked, "id", F.col("subject"), 10)


@Q.add(
    """SELECT id FROM f WHERE contains(' ' || array_to_string(list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' '), ' recall thresh')""", "f"
)
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "content").where(lexical.phrase(F.col("content"), ["recall", "thresh"])).select("id")


@Q.add(
    """, w AS (SELECT note_id, list_filter(string_split_regex(lower(concat_ws(' ', title, tags, body_preview)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM n)
SELECT note_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'retent') OR starts_with(x, 'prompt'))) > 0""",
    "n",
)
def fts_any(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "title", "tags", "body_preview")
    return n.where(lexical.any_term(F.concat_ws(" ", "title", "tags", "body_preview"), ["retent", "prompt"])).select("note_id")


@Q.add("SELECT id FROM f WHERE contains(lower(coalesce(content, '')), 'router over')", "f")
def recall_fallback(spark: SparkSession, sf: str) -> DataFrame:
    # no fact has the word, so the substring search answers
    f = facts(spark, sf, "content")
    hits = f.where(lexical.any_term(F.col("content"), ["qwertzuiop"], prefix=False)).select("id")
    return lexical.with_fallback(hits, f.where(lexical.like_any([F.col("content")], "router over")).select("id"))


@Q.add(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10"""
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    return vec.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 10)


_CENTRE = """vv AS (SELECT fid, CAST(vector AS DOUBLE[]) AS e FROM v WHERE len(vector) > 0),
u AS (SELECT generate_subscripts(e, 1) AS i, unnest(e) AS x FROM vv JOIN f ON f.id = vv.fid WHERE f.domain = 'Finance'),
c AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(x) AS m FROM u GROUP BY i))"""


def _centre(v: DataFrame, f: DataFrame, domain: str) -> DataFrame:
    """One row: the mean vector of a domain's facts."""
    own = v.join(f.where(F.col("domain") == domain), v["fact_id"] == f["id"])
    means = own.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q"))


@Q.add(f", {_CENTRE} SELECT fid AS id, round(list_cosine_similarity(e, q), 5) AS score FROM vv, c ORDER BY round(list_cosine_similarity(e, q), 5) DESC, fid LIMIT 50", "fv")
def vector_centre(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf, "vector").where("size(vector) > 0").select("fact_id", "vector")
    centre = _centre(v, facts(spark, sf, "domain").select("id", "domain"), "Finance")
    near = v.crossJoin(F.broadcast(centre)).select(F.col("fact_id").alias("id"), F.round(vec.cosine(F.col("vector"), F.col("q")), 5).alias("score"))
    return near.orderBy(F.desc("score"), "id").limit(50)


@Q.add(
    BM25_SQL
    + f""", {_CENTRE}, l AS (SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 100),
s AS (SELECT fid AS id, round(list_cosine_similarity(e, q), 5) AS score FROM vv, c ORDER BY round(list_cosine_similarity(e, q), 5) DESC, fid LIMIT 100)
SELECT coalesce(l.id, s.id) AS id, round(coalesce(l.score / (SELECT max(score) FROM l), 0.0) * 0.6 + coalesce(s.score / (SELECT max(score) FROM s), 0.0) * 0.4, 4) AS score FROM l FULL OUTER JOIN s ON s.id = l.id""",
    "fv",
)
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content", "domain")
    hits = lexical.bm25(f.where("content IS NOT NULL"), "id", F.col("content"), TERMS)
    words = hits.select(F.col("doc").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(100)
    v = vectors(spark, sf, "vector").where("size(vector) > 0").select("fact_id", "vector")
    near = v.crossJoin(F.broadcast(_centre(v, f.select("id", "domain"), "Finance")))
    near = near.select(F.col("fact_id").alias("id"), F.round(vec.cosine(F.col("vector"), F.col("q")), 5).alias("score")).orderBy(F.desc("score"), "id").limit(100)
    return scoring.fused(words, near, "id").select("id", F.round("score", 4).alias("score"))


@Q.add(
    """, w AS (SELECT id, domain, content, coalesce(sum(length(content)) OVER (PARTITION BY domain ORDER BY importance DESC NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f WHERE content <> '')
SELECT id, domain, CASE WHEN used + length(content) <= 1500 THEN content ELSE left(content, CAST(1500 - used AS INTEGER)) END AS content FROM w WHERE used + length(content) <= 1500 OR (1500 - used >= 100 AND used <= 1500)""",
    "f",
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain", "content", "importance").where("content IS NOT NULL")
    kept = scoring.budgeted(f, ["domain"], [F.desc_nulls_last("importance"), F.asc("id")], "content", 1500)
    return kept.select("id", "domain", "content")


@Q.add(
    """, w AS (SELECT domain, id, importance, row_number() OVER (PARTITION BY domain ORDER BY importance DESC NULLS LAST, id) AS rn, max(importance) OVER (PARTITION BY domain) AS top FROM f)
SELECT domain, id, importance FROM w WHERE rn <= CASE WHEN top >= 0.7 THEN 2 WHEN top >= 0.4 THEN 3 ELSE 5 END""",
    "f",
)
def progressive_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "domain", "importance")
    return scoring.disclosed(f, ["domain"], "importance", [F.desc_nulls_last("importance"), F.asc("id")]).select("domain", "id", "importance")


@Q.add(
    f"""SELECT id, round(coalesce(exp(-ln(2) / 30 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_accessed), 0) / 86400000000.0), 1.0), 6) AS decay, round(CAST(1 + 0.1 * least(coalesce(access_count, 0), 10) AS DOUBLE), 6) AS boost FROM f""", "f"
)
def decay_boost(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "last_accessed", "access_count")
    return f.select("id", F.round(scoring.decay(F.col("last_accessed"), AS_OF), 6).alias("decay"), F.round(scoring.reinforcement(F.col("access_count")), 6).alias("boost"))


@Q.add(
    """, w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM f WHERE content IS NOT NULL),
u AS (SELECT unnest(w) AS term FROM w) SELECT term, count(*) AS docs, CAST(row_number() OVER (ORDER BY count(*) DESC, term) AS INTEGER) AS rank FROM u GROUP BY term QUALIFY row_number() OVER (ORDER BY count(*) DESC, term) <= 100""",
    "f",
)
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content").where("content IS NOT NULL").select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    top = f.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "term").limit(100)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("docs"), "term")))


@Q.add(
    BM25_SQL
    + f""", {_CENTRE}, l AS (SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 40)
SELECT l.id, round(coalesce(list_cosine_similarity(e, q), 0.0), 5) AS score, CAST(row_number() OVER (ORDER BY round(coalesce(list_cosine_similarity(e, q), 0.0), 5) DESC, l.id) AS INTEGER) AS rank FROM l CROSS JOIN c LEFT JOIN vv ON vv.fid = l.id""",
    "fv",
)
def semantic_rerank(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content", "domain")
    hits = lexical.bm25(f.where("content IS NOT NULL"), "id", F.col("content"), TERMS)
    top = hits.select(F.col("doc").alias("id"), F.round("score", 6).alias("s")).orderBy(F.desc("s"), "id").limit(40)
    v = vectors(spark, sf, "vector").where("size(vector) > 0").select("fact_id", "vector")
    centre = _centre(v, f.select("id", "domain"), "Finance")
    own = v.join(F.broadcast(top.select("id")), F.col("fact_id") == F.col("id")).crossJoin(F.broadcast(centre))
    own = own.select("id", F.round(vec.cosine(F.col("vector"), F.col("q")), 5).alias("score"))
    ranked = top.select("id").join(own, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    # forty rows
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


@Q.add()
def composed_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Notes by their words, expanded along links, with a snippet."""
    n = notes(spark, sf, "title", "tags", "body_preview")
    hits = lexical.bm25(n, "note_id", F.concat_ws(" ", "title", "tags", "body_preview"), ["retention", "window"])
    hits = hits.select(F.col("doc").alias("id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(40)
    g = edges(spark, sf, "source_id", "target_id", "kind", "weight").where("kind = 'wikilink' AND source_id IS NOT NULL AND target_id IS NOT NULL")
    links = both_ways(g.select(F.trim("source_id").alias("s"), F.trim("target_id").alias("t"), "weight"), "s", "t", "weight")
    found = retrieval.expanded(hits, links).orderBy(F.desc("score"), "id").limit(20)
    shown = retrieval.snippet(F.coalesce("body_preview", F.lit("")), "retention")
    return n.join(F.broadcast(found), n["note_id"] == found["id"]).select("id", "score", "via", shown.alias("snippet"))


@Q.add()
def embedding_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Every fact embedded anew by the stand-in embedder, and the share that has a vector then."""
    f = facts(spark, sf, "content")
    return embed.coverage(f, "id", embed.embedded(f, "id", "content"))
