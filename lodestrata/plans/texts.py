"""Queries of text functions over facts, notes and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import phrases, privacy
from lodestrata.functions import text as tx
from lodestrata.operators import extract, messages
from lodestrata.plans.base import AS_OF, Queries, audit, facts, notes, triples
from lodestrata.sources.tables import table

Q = Queries()

_TIER_SQL = """CASE WHEN lower(trim(sensitivity)) IN ('public', 'internal', 'sensitive', 'secret') THEN lower(trim(sensitivity)) WHEN domain IN ('Finance', 'People', 'Wedding') THEN 'sensitive' WHEN domain = 'Test' THEN 'public' ELSE 'internal' END"""


def _replaced_sql(column: str, *steps: tuple[str, str]) -> str:
    """The column with every pattern's matches replaced, one pattern after the other."""
    for pattern, to in steps:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text", "doc_kind")


@Q.add(
    """SELECT id, CASE WHEN lower(trim(sensitivity)) IN ('public', 'internal', 'sensitive', 'secret') THEN lower(trim(sensitivity)) WHEN domain IN ('Finance', 'People', 'Wedding') THEN 'sensitive' WHEN domain = 'Test' THEN 'public' ELSE 'internal' END AS tier FROM f""",
    "f",
)
def sensitivity_tier(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "sensitivity", "domain")
    return f.select("id", privacy.tier(F.col("sensitivity"), F.col("domain")).alias("tier"))


@Q.add(
    """, x AS (SELECT *, CASE WHEN lower(trim(sensitivity)) IN ('public', 'internal', 'sensitive', 'secret') THEN lower(trim(sensitivity)) WHEN domain IN ('Finance', 'People', 'Wedding') THEN 'sensitive' WHEN domain = 'Test' THEN 'public' ELSE 'internal' END AS tier,
regexp_matches(coalesce(content, ''), '(?i)\\b(sk|pk)[_-][A-Za-z0-9_-]{10,}\\b|\\b(api[_-]?key|access[_-]?token|secret[_-]?key)\\s*[=:]\\s*\\S+|\\b(password|passwd|pwd)\\s*[=:]\\s*\\S+|-----BEGIN (RSA |OPENSSH |EC )?PRIVATE KEY-----|\\b(aws_secret_access_key|xox[baprs]-)\\S+|\\bsk_live_[A-Za-z0-9]+\\b') AS secret FROM f)
SELECT domain, source, CASE WHEN tier = 'secret' OR secret THEN 'block' WHEN source IN ('auto_extracted', 'auto_extract') THEN 'quarantine' WHEN source IN ('promoted', 'pending_promoted') THEN 'allow' WHEN domain IN ('Finance', 'People') AND source = 'conversation' THEN 'quarantine' ELSE 'allow' END AS action, count(*) AS n FROM x GROUP BY ALL""",
    "f",
)
def write_policy(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content", "sensitivity", "domain", "source")
    action = privacy.write_action(F.col("content"), F.col("sensitivity"), F.col("domain"), F.col("source"))
    return f.groupBy("domain", "source", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@Q.add(
    f""", p AS (SELECT id, content, {_TIER_SQL} AS tier, split_part({_replaced_sql("content", (r"^[ \t\r\n]+|[ \t\r\n]+$", ""))}, chr(10), 1) AS head FROM f)
SELECT id, CASE WHEN tier IN ('sensitive', 'secret') THEN '[sensitive] ' || CASE WHEN length(head) > 160 THEN left(head, 157) || '...' ELSE head END ELSE content END AS shown FROM p""",
    "f",
)
def prefetch_view(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content", "sensitivity", "domain")
    level = privacy.tier(F.col("sensitivity"), F.col("domain"))
    return f.select("id", privacy.prefetch_view(F.col("content"), level).alias("shown"))


@Q.add(f"SELECT id, {_replaced_sql('content', *[(p, '[REDACTED]') for _, p, _ in privacy.PERSONAL])} AS content FROM f", "f")
def pattern_redacted(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content")
    return f.select("id", privacy.pattern_redacted(F.col("content")).alias("content"))


@Q.add(
    f"""SELECT id, {_replaced_sql("content", *[(m, "") for m in tx.MARKERS], (r"\n{3,}", "\n\n"), (r"^[ \t\r\n]+|[ \t\r\n]+$", ""))} AS content FROM f""", "f"
)
def sanitized_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "content").select("id", tx.sanitized(F.col("content")).alias("content"))


@Q.add()
def derived_titles(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content")
    return f.select("id", tx.derived_title(F.col("content")).alias("title"), tx.file_stub(tx.derived_title(F.col("content"))).alias("stub"))


@Q.add(
    """SELECT note_id, round(least(0.3 + least(len(list_filter(string_split_regex(coalesce(tags, ''), '[,;| \\n]+'), lambda x: x <> '')) * 0.05, 0.2) + least(len(regexp_extract_all(body_preview, '\\[\\[(.+?)\\]\\]', 1)) * 0.03, 0.3)
+ least(len(list_filter(string_split_regex(body_preview, '\\s+'), lambda x: x <> '')) / 500.0 * 0.1, 0.2), 1.0), 2) AS score FROM n WHERE body_preview IS NOT NULL""",
    "n",
)
def note_importance(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf, "tags", "body_preview").where("body_preview IS NOT NULL")
    n_tags = F.size(F.filter(F.split(F.coalesce("tags", F.lit("")), r"[,;| \n]+"), lambda x: x != ""))
    return n.select("note_id", tx.note_importance(n_tags, F.col("body_preview")).alias("score"))


@Q.add(
    """SELECT doc_id, len(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', ' ', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL AND doc_kind = 'clip'"""
)
def html_words(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("text IS NOT NULL AND doc_kind = 'clip'")
    return d.select("doc_id", F.size(tx.tokens(tx.html_text(F.col("text")))).cast("bigint").alias("words"))


# fixed values: first words that begin no name
NO_NAME = ["The", "This", "That", "These", "Those", "There", "When", "Where", "What", "Which", "While", "With", "From", "Into", "After", "Before", "Note", "Section", "And", "But"]


def _entities_sql(stop: list[str]) -> str:
    """Sorted distinct runs of up to four capitalised words in a document."""
    words = ", ".join(f"'{w}'" for w in stop)
    # a word with a letter beyond a to z is no run's part: there is no border within it
    plain = r"regexp_replace(text, '[\p{L}\p{N}_]*[\x{C0}-\x{24F}\x{370}-\x{1FFF}\x{3040}-\x{D7FF}\x{FB00}-\x{FFDC}][\p{L}\p{N}_]*', '#', 'g')"
    found = rf"regexp_extract_all({plain}, '\b([A-Z][a-zA-Z]+([ \t\r\n]+[A-Z][a-zA-Z]+){{0,3}})\b', 1)"
    return f"list_sort(list_distinct(list_filter({found}, lambda e: length(e) > 3 AND regexp_extract(e, '^[A-Za-z]+') NOT IN ({words}))))"


@Q.add(f"SELECT doc_id, unnest({_entities_sql(NO_NAME)}[1:15]) AS entity FROM documents WHERE text IS NOT NULL")
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("text IS NOT NULL")
    return d.select("doc_id", F.explode(tx.capitalised_entities(F.col("text"), NO_NAME)).alias("entity"))


@Q.add(
    f"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS point FROM (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_replaced_sql("x", (r"^[ \t\r]+|[ \t\r]+$", ""))}), lambda x: length(x) > 20)[1:15], lambda x: left(x, 200)) AS l FROM documents WHERE text IS NOT NULL)"""
)
def key_points(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(tx.key_points(F.col("text"))).alias("pos", "point"))


@Q.add()
def key_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(tx.key_sentences(F.col("text"))).alias("pos", "sentence"))


@Q.add(
    """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, left(trim(line), 200) AS line FROM l WHERE contains(lower(line), 'prompt template')""".lstrip(", ").replace("l AS", "WITH l AS", 1)
)
def line_search(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("text IS NOT NULL")
    return d.select("doc_id", F.explode(tx.line_hits(F.col("text"), "prompt template")).alias("x")).select("doc_id", "x.line_no", "x.line")


@Q.add()
def frontmatter_fields(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("text IS NOT NULL")
    return d.select("doc_id", F.explode(tx.frontmatter(F.col("text"))).alias("key", "value"))


@Q.add(
    """SELECT link, count(*) AS n FROM (SELECT trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|]+)(\\|[^\\]]+)?\\]\\]', 1))) AS link FROM documents) GROUP BY link"""
)
def document_links(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("text IS NOT NULL").select(F.explode(tx.wikilinks(F.col("text"))).alias("link"))
    return d.groupBy("link").agg(F.count(F.lit(1)).alias("n"))


_TODAY = f"DATE '{AS_OF[:10]}'"
_SPANS_SQL = ", ".join(
    f"('{phrase}', {a}, {b})"
    for phrase, a, b in (
        ("yesterday", f"{_TODAY} - 1", f"{_TODAY} - 1"), ("today", _TODAY, _TODAY),
        ("last week", f"CAST(date_trunc('week', {_TODAY}) AS DATE) - 7", f"CAST(date_trunc('week', {_TODAY}) AS DATE) - 1"),
        ("this week", f"CAST(date_trunc('week', {_TODAY}) AS DATE)", f"CAST(date_trunc('week', {_TODAY}) AS DATE) + 6"),
        ("last month", f"CAST(date_trunc('month', {_TODAY}) - INTERVAL 1 MONTH AS DATE)", f"CAST(date_trunc('month', {_TODAY}) AS DATE) - 1"),
        ("this month", f"CAST(date_trunc('month', {_TODAY}) AS DATE)", _TODAY),
        ("last year", f"CAST(date_trunc('year', {_TODAY}) - INTERVAL 1 YEAR AS DATE)", f"CAST(date_trunc('year', {_TODAY}) AS DATE) - 1"),
        ("3 days ago", f"{_TODAY} - 3", f"{_TODAY} - 3"), ("2 weeks ago", f"{_TODAY} - 14", f"{_TODAY} - 14"), ("1 month ago", f"{_TODAY} - 30", f"{_TODAY} - 30"),
        ("2 years ago", f"{_TODAY} - 730", f"{_TODAY} - 730"), ("in 2025", "DATE '2025-01-01'", "DATE '2025-12-31'"), ("plain", "NULL", "NULL"),
    )
)


@Q.add(
    f""", fixed(phrase, from_date, to_date) AS (VALUES {_SPANS_SQL}), d AS (SELECT DISTINCT action, CAST(ts AS DATE) AS day FROM a WHERE ts IS NOT NULL),
p AS (SELECT action, phrase, from_date, to_date FROM (SELECT DISTINCT action FROM d), fixed
  UNION SELECT action, 'in ' || lower(monthname(day)), make_date(CASE WHEN month(day) > month({_TODAY}) THEN 2025 ELSE 2026 END, month(day), 1), last_day(make_date(CASE WHEN month(day) > month({_TODAY}) THEN 2025 ELSE 2026 END, month(day), 1)) FROM d
  UNION SELECT action, 'last ' || lower(dayname(day)), {_TODAY} - CAST((isodow({_TODAY}) - isodow(day) + 6) % 7 + 1 AS INTEGER), {_TODAY} - CAST((isodow({_TODAY}) - isodow(day) + 6) % 7 + 1 AS INTEGER) FROM d)
SELECT action || ' ' || phrase AS query, from_date, to_date, CASE WHEN phrase = 'plain' THEN action || ' plain' ELSE action END AS cleaned FROM p""",
    "a",
)
def date_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Every action of the log asked for with a phrase of each family, months and weekdays as the log has them."""
    a = audit(spark, sf, "action").where("ts IS NOT NULL")
    phrase = ["yesterday", "today", "last week", "this week", "last month", "this month", "last year", "3 days ago", "2 weeks ago", "1 month ago", "2 years ago", "in 2025", "plain"]
    phrase = F.array(*[F.lit(x) for x in phrase], F.concat(F.lit("in "), F.lower(F.date_format("ts", "MMMM"))), F.concat(F.lit("last "), F.lower(F.date_format("ts", "EEEE"))))
    q = a.select("action", F.explode(phrase).alias("phrase")).distinct().select(F.concat_ws(" ", "action", "phrase").alias("query"))
    span = phrases.date_range(F.col("query"), F.to_date(F.lit(AS_OF[:10])))
    return q.select("query", span.alias("x"), phrases.without_phrases(F.col("query")).alias("cleaned")).select("query", "x.from_date", "x.to_date", "cleaned")


@Q.add()
def extracted_facts(spark: SparkSession, sf: str) -> DataFrame:
    # the dictionary of subject areas, a short fixed table
    areas = [r.label for r in table(spark, sf, "subjects", "label").where("label IS NOT NULL").distinct().collect()]
    own = (extract.area_patterns(areas, "Knowledge", 0.6, "area"),) if areas else ()
    found = extract.facts_in(_docs(spark, sf).where("text IS NOT NULL"), "doc_id", F.col("text"), own=own)
    return extract.unknown(found, table(spark, sf, "facts", "id"))


@Q.add()
def extracted_preferences(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf, "content").where("content IS NOT NULL")
    return extract.unknown(extract.preferences_in(f, "id", F.col("content")), table(spark, sf, "facts", "id"))


@Q.add()
def extracted_statements(spark: SparkSession, sf: str) -> DataFrame:
    # the dictionary: all entities that statements name, without the number of their edition
    t = triples(spark, sf, "subject", "object").select(F.explode(F.array("subject", "object")).alias("name")).where("length(name) >= 3")
    name = F.regexp_replace(F.lower(F.trim("name")), r"\s+(one|two|north|south|east|west|[0-9]+)$", "")
    entities = t.select(name.alias("name")).distinct()
    f = facts(spark, sf, "content").where("content IS NOT NULL")
    return extract.statements_in(f, "id", F.col("content"), entities)


@Q.add(
    """WITH l AS (SELECT doc_id AS session, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS turn FROM documents WHERE text IS NOT NULL),
m AS (SELECT session, turn, regexp_extract(line, '^(user|assistant): ?', 1) AS role, regexp_replace(line, '^(user|assistant): ?', '') AS content FROM l),
g AS (SELECT session, count(*) FILTER (WHERE role <> '') AS n, arg_min(content, turn) FILTER (WHERE role = 'user') AS fu FROM m GROUP BY session)
SELECT session, left(trim(fu), 90) AS title, n FROM g WHERE fu IS NOT NULL AND trim(fu) <> '' AND NOT starts_with(trim(fu), '[')"""
)
def episode_distill(spark: SparkSession, sf: str) -> DataFrame:
    m = messages.messages(_docs(spark, sf).where("text IS NOT NULL"))
    return messages.distilled(m).where("title NOT LIKE '[%'").select("session", "title", "n")


@Q.add()
def episode_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return messages.distilled(messages.messages(_docs(spark, sf).where("text IS NOT NULL"))).select("session", "summary")


@Q.add()
def context_queries(spark: SparkSession, sf: str) -> DataFrame:
    m = messages.messages(_docs(spark, sf).where("text IS NOT NULL"))
    return messages.context_query(m, F.lit("what is open")).join(messages.conversation_key(m), "session")


@Q.add("SELECT id, sha256(regexp_replace(lower(content), '[^\\p{L}\\p{N}]', '', 'g')) AS key FROM f WHERE content IS NOT NULL", "f")
def parity_keys(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf, "content").where("content IS NOT NULL").select("id", tx.parity_key(F.col("content")).alias("key"))


@Q.add(
    f""", x AS (SELECT DISTINCT doc_id, unnest({_entities_sql(["The", "This", "That"])}) AS entity FROM documents WHERE text IS NOT NULL)
SELECT entity, count(*) AS docs FROM x WHERE entity NOT IN (SELECT regexp_replace(title, ' [0-9]+$', '') FROM n WHERE title IS NOT NULL) GROUP BY entity""",
    "n",
)
def unknown_entities(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, docs): capitalised names in documents that no note has as its title."""
    d = _docs(spark, sf).where("text IS NOT NULL")
    found = d.select("doc_id", F.explode(tx.capitalised_entities(F.col("text"), ["The", "This", "That"], None)).alias("entity"))
    titles = notes(spark, sf, "title").select(F.regexp_replace("title", " [0-9]+$", "").alias("entity")).where("entity IS NOT NULL").distinct()
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("docs")).join(titles, "entity", "left_anti")
