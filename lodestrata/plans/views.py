"""Queries of merging, personal-data spans, dictionaries, changed notes, filtered views and the composed prefetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import notes as nt
from lodestrata.functions.privacy import PERSONAL, checked, personal_spans, prefetch_view, tier
from lodestrata.operators import changes, dictionary, graph, lexical, retrieval, scoring
from lodestrata.plans.base import AS_OF, Queries, audit, edges, episodes, facts, notes, triples
from lodestrata.plans.search import BM25_SQL, TERMS
from lodestrata.sources.sinks import keep_last
from lodestrata.sources.tables import first_per
from lodestrata.streaming import jobs

Q = Queries()

_OVERLAP = "count(*) / (a.n + b.n - count(*))"


@Q.add(
    f""", s AS (SELECT id, coalesce(source, '') = 'conversation' AS fresh, list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '')) AS w FROM f WHERE content IS NOT NULL),
x AS (SELECT id, fresh, len(w) AS n, unnest(w) AS word FROM s),
p AS (SELECT a.id, b.id AS old, round({_OVERLAP}, 6) AS score FROM x a JOIN x b ON a.word = b.word AND a.fresh AND NOT b.fresh AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
      GROUP BY a.id, b.id, a.n, b.n HAVING {_OVERLAP} >= 0.8 - 1e-9),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, old) = 1)
SELECT s.id, coalesce(m.old, s.id) AS kept_id, CASE WHEN m.old IS NULL THEN 'insert' ELSE 'merge' END AS how FROM s LEFT JOIN m USING (id) WHERE fresh""",
    "f",
)
def merged_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts of conversations as if they came to a store of all others."""
    f = facts(spark, sf, "content", "source").where("content IS NOT NULL")
    new = F.coalesce(F.col("source") == "conversation", F.lit(False))
    return changes.merged(f.where(~new), f.where(new))


def _spans_sql() -> str:
    """One relation of matches for each pattern; those that touch an earlier one's are left out."""
    out, taken = [], "SELECT * FROM s0"
    for i, (kind, pattern, confidence) in enumerate(PERSONAL):
        out.append(
            f"m{i} AS (SELECT id, string_split_regex(content, '{pattern}') AS ps, regexp_extract_all(content, '{pattern}') AS ms FROM f WHERE regexp_matches(content, '{pattern}')), "
            f"u{i} AS (SELECT id, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM m{i}), "
            f"s{i} AS (SELECT id, '{kind}' AS type, ms[i] AS match, {confidence}::DOUBLE AS confidence, "
            f"CAST(list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS INTEGER) AS a, CAST(a + len(ms[i]) AS INTEGER) AS b FROM u{i})"
        )
        if i:
            out.append(f"t{i} AS ({taken} UNION ALL SELECT * FROM s{i} WHERE NOT EXISTS (SELECT 1 FROM ({taken}) t WHERE t.id = s{i}.id AND ((t.a <= s{i}.a AND s{i}.a < t.b) OR (t.a < s{i}.b AND s{i}.b <= t.b))))")
            taken = f"SELECT * FROM t{i}"
    return ", " + ", ".join(out)


_SPANS = _spans_sql()


@Q.add(_SPANS + f' SELECT id, type, a AS "start", b AS "end", match, confidence FROM t{len(PERSONAL) - 1}', "f")
def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of personal data with its place; of two that overlap the first type's stays."""
    f = facts(spark, sf, "content")
    return f.select("id", F.explode(personal_spans(F.col("content"))).alias("x")).select("id", "x.*")


@Q.add(
    _SPANS
    + f""", z AS (SELECT *, NOT EXISTS (SELECT 1 FROM t{len(PERSONAL) - 1} o WHERE o.id = x.id AND o.a <= x.a AND x.b <= o.b AND o.b - o.a > x.b - x.a) AS outermost FROM t{len(PERSONAL) - 1} x),
l AS (SELECT id, list(struct_pack(a, b) ORDER BY a) FILTER (WHERE outermost) AS l, count(*) FILTER (WHERE outermost) AS n, count(*) AS pieces FROM z GROUP BY id)
SELECT f.id, pieces AS n, array_to_string(list_transform(range(0, n + 1), lambda i: substring(content, CASE WHEN i = 0 THEN 1 ELSE l[i].b + 1 END, CASE WHEN i = n THEN length(content) ELSE l[i + 1].a - CASE WHEN i = 0 THEN 0 ELSE l[i].b END END)), '[REDACTED]') AS text FROM f JOIN l USING (id)""",
    "f",
)
def pii_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with personal data: how many pieces, and the text with each marked."""
    f = facts(spark, sf, "content").select("id", checked(F.col("content"), "redact").alias("x"))
    return f.where("x.has_pii").select("id", F.size("x.findings").cast("bigint").alias("n"), "x.text")


@Q.add(
    """, c AS (SELECT lower(trim(x)) AS alias, trim(x) AS name, count(*) AS n FROM (SELECT unnest([subject, object]) AS x FROM t) WHERE trim(x) <> '' GROUP BY ALL)
SELECT alias, arg_min(name, struct_pack(m := -n, name)) AS name, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS mentions FROM c GROUP BY alias""",
    "t",
)
def canonical_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity under the spelling that statements use most."""
    t = triples(spark, sf, "subject", "object").select(F.explode(F.array("subject", "object")).alias("name"))
    return dictionary.canonical(t, "name")


@Q.add(
    """, k AS (SELECT trim(title) AS name, note_id, path FROM n WHERE trim(title) <> '' UNION ALL SELECT trim(entropic_id), note_id, path FROM n WHERE trim(entropic_id) <> '')
SELECT name, arg_max(note_id, struct_pack(path, note_id)) AS note_id, count(*) AS notes FROM k GROUP BY name""",
    "n",
)
def title_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """What a link may name: titles and record ids as aliases; of several notes with one name the last path wins."""
    n = notes(spark, sf, "title", "path", "entropic_id")
    return dictionary.names_of(n, "note_id", "path", F.array("title", "entropic_id"))


_ACTIVE_SQL = "coalesce(valid_until, '') = ''"


@Q.add(
    f""", c AS (SELECT lower(trim(x)) AS alias, trim(x) AS name, count(*) AS n FROM (SELECT unnest([subject, object]) AS x FROM t) WHERE trim(x) <> '' GROUP BY ALL),
d AS (SELECT alias, arg_min(name, struct_pack(m := -n, name)) AS name FROM c GROUP BY alias)
SELECT DISTINCT a.name AS subject, predicate, b.name AS object FROM t JOIN d a ON a.alias = lower(trim(subject)) JOIN d b ON b.alias = lower(trim(object)) WHERE {_ACTIVE_SQL} AND confidence >= 0.5""",
    "t",
)
def canonical_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Open statements between entities under their canonical names, each once."""
    t = triples(spark, sf, "subject", "predicate", "object", "valid_until", "confidence")
    names = dictionary.canonical(t.select(F.explode(F.array("subject", "object")).alias("name")), "name")
    kept = t.where(graph.all_of(graph.active(F.col("valid_until")), F.col("confidence") >= 0.5, None))
    for end in ("subject", "object"):
        kept = dictionary.renamed(kept, end, names)
    return kept.select("subject", "predicate", "object").distinct()


@Q.add(
    """, kept AS (SELECT note_id FROM n WHERE domain = 'Infrastructure' AND coalesce(importance, 0) >= 0.4 AND contains(lower(coalesce(tags, '')), 'i') AND contains(lower(coalesce(tags, '')), 'n')),
x AS (SELECT trim(source_id) AS s, trim(target_id) AS o, weight FROM g WHERE kind = 'wikilink')
SELECT s AS source_id, o AS target_id, CAST(sum(weight) AS BIGINT) AS weight FROM x WHERE s IN (SELECT note_id FROM kept) AND o IN (SELECT note_id FROM kept) GROUP BY ALL""",
    "ng",
)
def graph_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The links among the notes that a viewer's filters leave: domain, least importance, all terms in the tags."""
    n = notes(spark, sf, "domain", "importance", "tags")
    kept = n.where(graph.shown(domain="Infrastructure", least=0.4, terms="i N"))
    g = edges(spark, sf, "source_id", "target_id", "kind", "weight").where("kind = 'wikilink'")
    links = graph.induced(kept, g.select(F.trim("source_id").alias("source_id"), F.trim("target_id").alias("target_id"), "weight"))
    return links.groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"))


@Q.add(
    """, x AS (SELECT note_id, body_preview AS b, strpos(body_preview, 'See [[') AS p, (length(body_preview) - length(replace(body_preview, 'the ', ''))) // 4 AS n FROM n WHERE body_preview IS NOT NULL)
SELECT note_id, CASE WHEN p > 0 THEN left(b, p + 5) || chr(10) || 'checked' || substring(b, p + 6) ELSE b || chr(10) || 'checked' END AS appended, CASE WHEN n = 1 THEN replace(b, 'the ', 'that ') ELSE b END AS patched, n,
CASE WHEN strpos(b, 'the ') > 0 THEN left(b, strpos(b, 'the ') - 1) || 'that ' || substring(b, strpos(b, 'the ') + 4) ELSE b END AS first_patched FROM x""",
    "n",
)
def notes_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Every note with a line put behind an anchor, with a text replaced if it stands there once, and with the first
    such text replaced."""
    n, b = notes(spark, sf, "body_preview").where("body_preview IS NOT NULL"), F.col("body_preview")
    return n.select(
        "note_id", nt.appended(b, "checked", "See [[").alias("appended"), nt.patched(b, "the ", "that ").alias("patched"),
        nt.occurrences(b, "the ").cast("bigint").alias("n"), nt.first_patched(b, "the ", "that ").alias("first_patched"),
    )


@Q.add(
    f"""SELECT note_id, {" OR ".join(f"contains(lower(coalesce(title, '') || ' ' || coalesce(body_preview, '')), '{w}')" for w in nt.SENSITIVE_WORDS)} AS sensitive FROM n""", "n"
)
def notes_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "title", "body_preview")
    return n.select("note_id", nt.sensitive(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body_preview", F.lit("")))).alias("sensitive"))


@Q.add("SELECT session_id, id, created_at FROM f WHERE session_id <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS LAST, id) = 1", "f")
def first_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The first fact of each session."""
    f = facts(spark, sf, "session_id", "created_at").where("session_id <> ''").select("session_id", "id", "created_at")
    return first_per(f, ["session_id"], [F.asc_nulls_last("created_at"), F.asc("id")])


@Q.add("SELECT kind, id, created_at FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY created_at DESC NULLS LAST, id DESC) <= 7", "g")
def newest_links(spark: SparkSession, sf: str) -> DataFrame:
    """The newest seven links of each kind, as a retention rule keeps snapshots."""
    return keep_last(edges(spark, sf, "kind").select("kind", "id", "created_at"), "kind", "created_at", tie="id")


@Q.add(
    """, w AS (SELECT episode_id, domain, list_filter(string_split_regex(lower(concat_ws(' ', title, summary, domain)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM e)
SELECT domain, count(*) AS episodes, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(len(list_distinct(w))) AS BIGINT) AS postings FROM w WHERE len(w) > 0 GROUP BY domain""",
    "e",
)
def episodes_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The full-text index of the episodes, built anew, by its sizes."""
    e = episodes(spark, sf, "title", "summary", "domain")
    posts = lexical.postings(e, "episode_id", F.concat_ws(" ", "title", "summary", "domain"))
    each = posts.groupBy("doc").agg(F.sum("tf").alias("words"), F.count(F.lit(1)).alias("n"))
    own = e.select(F.col("episode_id").alias("doc"), "domain").join(each, "doc")
    return own.groupBy("domain").agg(F.count(F.lit(1)).alias("episodes"), F.sum("words").cast("bigint").alias("words"), F.sum("n").alias("postings"))


@Q.add(
    """, l AS (SELECT trim(target_id) AS note_id, count(*) AS backlinks FROM g WHERE kind = 'wikilink' AND trim(source_id) <> trim(target_id) GROUP BY 1)
SELECT n.note_id, n.domain, '- [[' || coalesce(title, n.note_id) || '](' || coalesce(backlinks, 0) || ')' AS line FROM n LEFT JOIN l ON l.note_id = n.note_id""",
    "ng",
)
def map_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line of each domain's map for every note, with the number of links that lead to it."""
    g = edges(spark, sf, "source_id", "target_id", "kind").where("kind = 'wikilink' AND trim(source_id) <> trim(target_id)")
    back = g.groupBy(F.trim("target_id").alias("note_id")).agg(F.count(F.lit(1)).alias("backlinks"))
    line = F.concat(F.lit("- [["), F.coalesce("title", "note_id"), F.lit("]("), F.coalesce("backlinks", F.lit(0)).cast("string"), F.lit(")"))
    return notes(spark, sf, "domain", "title").join(back, "note_id", "left").select("note_id", "domain", line.alias("line"))


def _blocks(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    f = facts(spark, sf, "content", "importance", "last_accessed", "access_count", "sensitivity", "domain")
    scored = f.join(F.broadcast(hits), "id")
    score = scoring.normalised(F.col("raw"), []) * scoring.decay(F.col("last_accessed"), AS_OF) * scoring.reinforcement(F.col("access_count"))
    return scored.withColumn("score", F.round(score, 6))


@Q.add(
    BM25_SQL
    + f""", c AS (SELECT id, round(score, 6) AS raw FROM b ORDER BY round(score, 6) DESC, id LIMIT 40),
r AS (SELECT f.*, round(CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 1.0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END
 * coalesce(exp(-ln(2) / 30 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_accessed), 0) / 86400000000.0), 1.0) * (1 + 0.1 * least(coalesce(access_count, 0), 10)), 6) AS score FROM c JOIN f USING (id)),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn, max(score) OVER () AS top FROM r WHERE score >= 0.05),
few AS (SELECT * FROM k WHERE rn <= CASE WHEN top >= 0.7 THEN 2 WHEN top >= 0.4 THEN 3 ELSE 5 END)
SELECT id, score, '- [' || id || '] ' || left(content, 300) || CASE WHEN length(content) > 300 THEN '...' ELSE '' END || printf(' [score:%.2f]', score) AS line FROM
(SELECT * REPLACE (CASE WHEN t IN ('sensitive', 'secret') THEN '[sensitive] ' || CASE WHEN length(h) > 160 THEN left(h, 157) || '...' ELSE h END ELSE content END AS content) FROM (SELECT *, split_part(regexp_replace(content, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), chr(10), 1) AS h,
 CASE WHEN lower(trim(sensitivity)) IN ('public', 'internal', 'sensitive', 'secret') THEN lower(trim(sensitivity)) WHEN domain IN ('Finance', 'People', 'Wedding') THEN 'sensitive' WHEN domain = 'Test' THEN 'public' ELSE 'internal' END AS t FROM few))""",
    "f",
)
def prefetch_block(spark: SparkSession, sf: str) -> DataFrame:
    """The lines shown before a turn: candidates, scores, fewer of them the better they are, a budget, what may be shown."""
    f = facts(spark, sf, "content").where("content IS NOT NULL")
    hits = lexical.bm25(f, "id", F.col("content"), TERMS).select(F.col("doc").alias("id"), F.round("score", 6).alias("raw"))
    # forty candidates: their facts are looked up by broadcast
    best = _blocks(spark, sf, hits.orderBy(F.desc("raw"), "id").limit(40)).where("score >= 0.05").withColumn("part", F.lit(0))
    few = scoring.disclosed(best, ["part"], "score", [F.desc("score"), F.asc("id")])
    fit = scoring.budgeted(few, ["part"], [F.desc_nulls_last("importance"), F.asc("id")], "content", 1500)
    shown = prefetch_view(F.col("content"), tier(F.col("sensitivity"), F.col("domain")))
    return fit.select("id", "score", retrieval.rendered(F.col("id"), shown, F.col("score")).alias("line"))


@Q.add("SELECT CAST(ts AS DATE) AS day, count(*) AS n, CASE WHEN bool_and(ok) THEN 'OK' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT id, ts, ok FROM audit_log) WHERE ts IS NOT NULL GROUP BY 1")
def stream_gate_log(spark: SparkSession, sf: str) -> DataFrame:
    """One line a day of the gate's log, however often the day's rows come."""
    stream = jobs.follow(spark, sf, "audit_log", "id", "ts", "ok").where("ts IS NOT NULL")
    return jobs.run_available(jobs.gate_log(jobs.once(stream, "ts")), "complete")


@Q.add(
    """, m AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE ok) AS good FROM a WHERE ts IS NOT NULL GROUP BY 1)
SELECT month, month || ': ' || good || '/' || n || printf(' (%.1f%%)', 100.0 * good / n) AS line, good = n OR good / n >= 0.95 AS reliable FROM m""",
    "a",
)
def monthly_report(spark: SparkSession, sf: str) -> DataFrame:
    """A line of text a month: how many of the store's actions went well."""
    a = audit(spark, sf, "ok").where("ts IS NOT NULL")
    m = a.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("good"))
    line = F.format_string("%s: %d/%d (%.1f%%)", "month", "good", "n", F.lit(100.0) * F.col("good") / F.col("n"))
    return m.select("month", line.alias("line"), (F.col("good") / F.col("n") >= 0.95).alias("reliable"))
