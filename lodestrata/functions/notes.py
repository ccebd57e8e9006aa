"""Changes of a note's text and tests of what it may hold, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that mark a text as one not to be taken over
SENSITIVE_WORDS = (
    "token", "api_key", "apikey", "password", "secret", "bearer ", "client_id", "client_secret", "sk-", "pk-", "ghp_", "nvapi-", "pat", "master password", "app password",
)


def sensitive(text: Column) -> Column:
    """Whether one of the words stands anywhere in the text, letter case aside; null texts hold none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in SENSITIVE_WORDS])


def occurrences(text: Column, part: str) -> Column:
    """How often the part, not empty, stands in the text, overlaps aside."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def appended(text: Column, line: str, anchor: str | None = None) -> Column:
    """The line behind the first anchor, or at the end where there is none."""
    end = F.concat(text, F.lit(f"\n{line}"))
    if not anchor:
        return end
    at = F.instr(text, anchor)
    stop = at + len(anchor) - 1
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), stop), F.lit(f"\n{line}"), F.substring(text, stop + 1, F.length(text)))).otherwise(end)


def patched(text: Column, old: str, new: str, everywhere: bool = False) -> Column:
    """`old` replaced by `new`; unless `everywhere`, only if it stands there exactly once, else the text is as it was."""
    changed = F.replace(text, F.lit(old), F.lit(new))
    return changed if everywhere else F.when(occurrences(text, old) == 1, changed).otherwise(text)


def first_patched(text: Column, old: str, new: str = "") -> Column:
    """The first `old` replaced; with nothing to put in its place it goes with the line end behind it."""
    part = old if new else f"{old}\n"
    at = F.instr(text, part)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(part), F.length(text)))).otherwise(text)
