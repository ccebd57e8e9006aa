"""Personal data patterns, secrets, tiers and write decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import let

# fixed values: sensitivity tiers, lowest first, and the tier a domain has by default
TIERS = ("public", "internal", "sensitive", "secret")
DOMAIN_TIER = {"Finance": "sensitive", "People": "sensitive", "Wedding": "sensitive", "Test": "public"}
DEFAULT_TIER = "internal"

# fixed values: type, pattern and confidence of personal data, in order of precedence
PERSONAL = (
    ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95),
    ("phone", r"\b(\+?27|0)[6-8][0-9]{8}\b", 0.85),
    ("phone_intl", r"\b\+?[1-9][0-9]{1,2}[-. ]?\(?[0-9]{1,4}\)?[-. ]?[0-9]{3,4}[-. ]?[0-9]{3,4}\b", 0.7),
    ("id_number", r"\b[0-9]{13}\b", 0.6),
    ("api_key", r"(?i)\b(sk|pk|api|key|token)[_-][A-Za-z0-9]{20,}\b", 0.9),
    ("password", r"(?i)(password|passwd|pwd|secret)\s*[=:]\s*\S+", 0.85),
    ("ip_address", r"\b([0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.5),
    ("credit_card", r"\b([0-9][ -]*){13,16}\b", 0.6),
)

# fixed values: credentials that must never be stored
SECRETS = (
    r"(?i)\b(sk|pk)[_-][A-Za-z0-9_-]{10,}\b",
    r"(?i)\b(api[_-]?key|access[_-]?token|secret[_-]?key)\s*[=:]\s*\S+",
    r"(?i)-----BEGIN (RSA |OPENSSH |EC )?PRIVATE KEY-----",
    r"(?i)\b(password|passwd|pwd)\s*[=:]\s*\S+",
    r"(?i)\b(aws_secret_access_key|xox[baprs]-)\S+",
    r"(?i)\bsk_live_[A-Za-z0-9]+\b",
)


def personal_types(text: Column) -> Column:
    """Types of personal data in the text, in order of precedence."""
    flags = [F.when(text.rlike(pattern), F.lit(kind)) for kind, pattern, _ in PERSONAL]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def pattern_redacted(text: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every pattern's matches replaced, in order of precedence."""
    for _, pattern, _ in PERSONAL:
        text = F.regexp_replace(text, pattern, mark)
    return text


_SPAN = "struct<type: string, start: int, end: int, match: string, confidence: double>"


def _spans_of(text: Column, kind: str, pattern: str, confidence: float) -> Column:
    """One pattern's spans: the text is what stands between its matches and the matches in turn."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.zip_with(F.split(text, pattern, -1), matches, lambda before, m: F.struct(before.alias("before"), m.alias("m")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("type"), start.alias("start"), end.alias("end"), x["m"].alias("match"), F.lit(confidence).alias("confidence"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(F.filter(pieces, lambda x: x["m"].isNotNull()), none, step)["spans"]


def personal_spans(text: Column) -> Column:
    """ARRAY<STRUCT<type, start, end, match, confidence>> in order of place, places counted from 0, ends excluded.

    A match with its start or end in a span of a type that goes before isn't taken. Null texts have none.
    """
    empty = F.array().cast(f"array<{_SPAN}>")
    # most texts hold nothing: one test each keeps them from the rest
    parts = [F.when(text.rlike(pattern), _spans_of(text, kind, pattern, confidence)).otherwise(empty) for kind, pattern, confidence in PERSONAL]
    inside = lambda t, s: ((t["start"] <= s["start"]) & (s["start"] < t["end"])) | ((t["start"] < s["end"]) & (s["end"] <= t["end"]))
    taken = F.aggregate(F.concat(*parts), empty, lambda acc, s: F.when(F.exists(acc, lambda t: inside(t, s)), acc).otherwise(F.concat(acc, F.array(s))))
    by_start = F.array_sort(F.transform(taken, lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))
    return F.coalesce(F.transform(by_start, lambda x: x["s"]), empty)


def checked(text: Column, mode: str = "warn", mark: str = "[REDACTED]") -> Column:
    """STRUCT<has_pii, findings, text, blocked>: `warn` leaves the text, `redact` marks its spans, `block` refuses it.

    A span within a wider one of a later type gets no mark of its own.
    """
    if mode not in ("warn", "redact", "block"):
        raise ValueError(f"no such mode: {mode}")

    def judged(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        cut = F.aggregate(
            spans, start,
            lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
                F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))
            ),
        )
        marked = let(cut, lambda c: F.concat(c["out"], F.substring(text, c["at"] + 1, F.length(text))))
        found = F.size(spans) > 0
        return F.struct(
            found.alias("has_pii"), F.transform(spans, lambda s: s["type"]).alias("findings"), (F.when(found, marked).otherwise(text) if mode == "redact" else text).alias("text"),
            (found if mode == "block" else F.lit(False)).alias("blocked"),
        )

    return let(personal_spans(text), judged)


def has_secret(text: Column) -> Column:
    found = F.lit(False)
    for pattern in SECRETS:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def tier(sensitivity: Column, domain: Column) -> Column:
    """The stated tier if it is one, else the domain's, else the default."""
    stated = F.lower(F.trim(sensitivity))
    by_domain = F.lit(DEFAULT_TIER)
    for name, level in DOMAIN_TIER.items():
        by_domain = F.when(domain == name, level).otherwise(by_domain)
    return F.when(stated.isin(*TIERS), stated).otherwise(by_domain)


def write_action(content: Column, sensitivity: Column, domain: Column, source: Column) -> Column:
    """block, quarantine or allow."""
    return (
        F.when((tier(sensitivity, domain) == "secret") | has_secret(content), "block")
        .when(source.isin("auto_extracted", "auto_extract"), "quarantine")
        .when(source.isin("promoted", "pending_promoted"), "allow")
        .when(domain.isin("Finance", "People") & (source == "conversation"), "quarantine")
        .otherwise("allow")
    )


def prefetch_view(content: Column, tier_: Column) -> Column:
    """What may be shown unasked: of sensitive records the first line, at most 160 characters."""
    first = F.substring_index(F.regexp_replace(content, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), "\n", 1)
    first = F.when(F.length(first) > 160, F.concat(F.substring(first, 1, 157), F.lit("..."))).otherwise(first)
    return F.when(tier_.isin("sensitive", "secret"), F.concat(F.lit("[sensitive] "), first)).otherwise(content)
