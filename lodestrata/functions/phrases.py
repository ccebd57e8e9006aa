"""Date phrases in queries, read relative to a given day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: months and weekdays in order
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# fixed values: what is removed from a query once its date phrase is read
PHRASES = (
    rf"(?i)\blast\s+({'|'.join(WEEKDAYS)})\b",
    r"(?i)\blast\s+(week|month|year)\b",
    r"(?i)\bthis\s+(week|month)\b",
    r"(?i)\byesterday\b",
    r"(?i)\btoday\b",
    r"(?i)\b[0-9]+\s+(day|week|month|year)s?\s+ago\b",
    rf"(?i)\bin\s+({'|'.join(MONTHS)})\b",
    r"(?i)\bin\s+20[0-9]{2}\b",
)


def date_range(text: Column, today: Column) -> Column:
    """STRUCT<from_date DATE, to_date DATE> of the first phrase that applies, null if none does.

    In order: yesterday, today, last and this week, month and year, N units ago (30 days a month, 365 a year), last
    weekday, in a month (the last one that has begun), in a year of this century.
    """
    t = F.lower(text)
    monday = F.date_sub(today, F.weekday(today))
    month = F.trunc(today, "month")
    year = F.trunc(today, "year")

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.cast("date").alias("from_date"), b.cast("date").alias("to_date"))

    def has(phrase: str) -> Column:
        return F.contains(t, F.lit(phrase))

    ago = r"([0-9]+)\s+(day|week|month|year)s?\s+ago"
    days = F.regexp_extract(t, ago, 1).try_cast("int") * F.when(F.regexp_extract(t, ago, 2) == "week", 7).when(
        F.regexp_extract(t, ago, 2) == "month", 30
    ).when(F.regexp_extract(t, ago, 2) == "year", 365).otherwise(1)
    out = (
        F.when(has("yesterday"), span(F.date_sub(today, 1), F.date_sub(today, 1)))
        .when(has("today"), span(today, today))
        .when(has("last week"), span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(has("this week"), span(monday, F.date_add(monday, 6)))
        .when(has("last month"), span(F.add_months(month, -1), F.date_sub(month, 1)))
        .when(has("this month"), span(month, today))
        .when(has("last year"), span(F.add_months(year, -12), F.date_sub(year, 1)))
        .when(t.rlike(ago), span(F.date_sub(today, days), F.date_sub(today, days)))
    )
    for i, name in enumerate(WEEKDAYS):
        back = F.pmod(F.weekday(today) - i - 1, F.lit(7)) + 1
        out = out.when(has(f"last {name}"), span(F.date_sub(today, back), F.date_sub(today, back)))
    for i, name in enumerate(MONTHS):
        first = F.add_months(year, i)
        first = F.when(F.month(today) < i + 1, F.add_months(first, -12)).otherwise(first)
        out = out.when(t.rlike(rf"\bin {name}\b"), span(first, F.last_day(first)))
    stated = F.make_date(F.regexp_extract(t, r"\bin\s+(20[0-9]{2})\b", 1).try_cast("int"), F.lit(1), F.lit(1))
    return out.when(t.rlike(r"\bin\s+20[0-9]{2}\b"), span(stated, F.date_sub(F.add_months(stated, 12), 1)))


def without_phrases(text: Column) -> Column:
    """The query without its date phrases, blanks collapsed."""
    for phrase in PHRASES:
        text = F.regexp_replace(text, phrase, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))
