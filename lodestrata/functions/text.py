"""Scalar text functions on columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """`then(value)` with the value computed once, however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Blanks of any kind, the zero-width ones among them.
BLANKS = " \t\n\x0b\x0c\r\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def strip_blanks(text: Column) -> Column:
    """The text without blanks of any kind (space, tab, line end, no-break space and so on) around it."""
    return F.btrim(text, F.lit(BLANKS))


def record_id(content: Column) -> Column:
    """First 16 hex digits of the content's sha256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def parity_key(text: Column) -> Column:
    """Digest of the text's letters and digits, letter case aside."""
    return F.sha2(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", ""), 256)


# fixed values: markers of injected instructions
MARKERS = (
    r"</?\s*memory-context\s*>",
    r"(?im)^\s*ignore (all |any )?(previous|prior|above) instructions\s*:?\s*",
    r"(?im)^\s*system\s*:\s*",
    r"(?im)^\s*developer\s*:\s*",
)


def sanitized(text: Column) -> Column:
    """Without injected instruction markers, blank lines collapsed, trimmed."""
    for marker in MARKERS:
        text = F.regexp_replace(text, marker, "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def derived_title(text: Column, max_len: int = 60) -> Column:
    """First sentence without markup and symbols, cut at a word border; '' when nothing is left."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[#*`>_~]", " ")
    t = F.regexp_replace(t, "[\\p{So}\\p{Sk}\ufe0f\n]", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "Fact - |Fact: ", ""), r"\s+", " "))

    def first_sentence(t: Column) -> Column:
        ends = [F.when((F.instr(t, mark) > 1) & (F.instr(t, mark) <= max_len + 1), F.instr(t, mark)) for mark in (". ", "! ", "? ", " — ", ": ")]
        return F.concat(F.regexp_replace(F.substring(t, F.lit(1), F.coalesce(*ends, F.length(t))), r"[.!?: ]+$", ""), F.lit("."))

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, max_len)
        border = _border(head, " \\-—")
        short = F.when(border > 20, F.concat(F.regexp_replace(F.substring(t, F.lit(1), border), r"[ .]+$", ""), F.lit("…")))
        return F.when(t == ".", "").when(F.length(t) > max_len, F.coalesce(short, F.concat(F.rtrim(head), F.lit("…")))).otherwise(t)

    return let(let(t, first_sentence), cut)


def _border(head: Column, chars: str) -> Column:
    """Characters before the last of `chars`, -1 where there is none."""
    return F.when(head.rlike(f"[{chars}]"), F.length(F.regexp_extract(head, rf"^(.*)[{chars}]", 1))).otherwise(-1)


def file_stub(name: Column) -> Column:
    """A safe, readable file name stub of at most 90 characters; 'untitled' when nothing is left."""
    s = F.trim(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_ \-—–.,()&'#+]", " "), r"\s+", " "))

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, 90)
        border = _border(head, " \\-—–")
        short = F.when(border > 40, F.rtrim(F.substring(s, F.lit(1), border))).otherwise(F.regexp_replace(head, r"[ \-—–]+$", ""))
        return F.when(F.length(s) > 90, short).otherwise(s)

    return F.coalesce(F.nullif(F.regexp_replace(let(s, cut), r"[ .\-—–]+$", ""), F.lit("")), F.lit("untitled"))


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|alias]]."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(\|[^\]]+)?\]\]"), 1), F.trim)


def link_contexts(text: Column, radius: int = 40) -> Column:
    """(target, context) of each link in order: the link with up to `radius` characters on each side, on one line, trimmed."""
    link = r"\[\[[^\]|]+?(?:\|[^\]]+)?\]\]"
    links = F.regexp_extract_all(text, F.lit(link), 0)
    # what stands between the links and the links by turns: link i is piece 2i
    pieces = F.flatten(F.zip_with(F.split(text, link), F.concat(links, F.array(F.lit(""))), lambda p, q: F.array(p, q)))

    def around(pieces: Column) -> Column:
        def one(i: Column) -> Column:
            before = F.array_join(F.slice(pieces, F.lit(1), 2 * i - 1), "")
            after = F.array_join(F.slice(pieces, 2 * i + 1, F.size(pieces)), "")
            whole = F.concat(F.substring(before, -radius, radius), F.element_at(pieces, 2 * i), F.substring(after, 1, radius))
            target = F.regexp_extract(F.element_at(pieces, 2 * i), r"^\[\[([^\]|]+)", 1)
            return F.struct(target.alias("target"), strip_blanks(F.replace(whole, F.lit("\n"), F.lit(" "))).alias("context"))

        n = (F.size(pieces) / 2).cast("int") - 1
        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n), one)

    return let(pieces, around)


def html_text(html: Column) -> Column:
    """Text of a page: no scripts and styles, tags as blanks, blank runs collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\n\s*\n", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(t, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def key_points(text: Column, most: int = 15, width: int = 200) -> Column:
    """The first lines of more than 20 characters, trimmed and cut."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: F.length(x) > 20)
    return F.slice(F.transform(lines, lambda x: F.substring(x, 1, width)), 1, most)


def key_sentences(text: Column, most: int = 5) -> Column:
    """The first sentences of 21 to 699 characters."""
    # a mark keeps the sentence's own end without look-behind
    parts = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")
    return F.slice(F.filter(parts, lambda s: (F.length(s) > 20) & (F.length(s) < 700)), 1, most)


def capitalised_entities(text: Column, stop_words: list[str], most: int | None = 15) -> Column:
    """Distinct runs of up to four capitalised words, sorted, without those that begin with a stop word."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z]+([ \t\r\n]+[A-Z][a-zA-Z]+){0,3})\b"), 1)
    keep = F.filter(found, lambda e: (F.length(e) > 3) & ~F.regexp_extract(e, "^[A-Za-z]+", 0).isin(stop_words))
    names = F.array_sort(F.array_distinct(keep))
    return names if most is None else F.slice(names, 1, most)


def line_hits(text: Column, pattern: str) -> Column:
    """(line_no, line) of the lines that contain the pattern anywhere, letter case aside; what is shown is cut at 200 characters."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), x.alias("line")))
    hits = F.filter(lines, lambda x: F.contains(F.lower(x["line"]), F.lit(pattern.lower())))
    return F.transform(hits, lambda x: F.struct(x["line_no"].alias("line_no"), F.substring(F.trim(x["line"]), 1, 200).alias("line")))


def note_importance(n_tags: Column, text: Column) -> Column:
    """0.3 and shares for tags, links and words, at most 1, two decimals."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    links = F.size(F.regexp_extract_all(text, F.lit(r"\[\[(.+?)\]\]"), 1))
    score = (
        F.lit(0.3)
        + F.least(n_tags * F.lit(0.05), F.lit(0.2))
        + F.least(links * F.lit(0.03), F.lit(0.3))
        + F.least(words / F.lit(500.0) * F.lit(0.1), F.lit(0.2))
    )
    return F.round(F.least(score, F.lit(1.0)), 2)


def session_title(text: Column, width: int = 90) -> Column:
    """First message as a title: no system prefix, one line, cut."""
    t = F.regexp_replace(F.trim(text), "\n", " ")
    noisy = t.startswith("[System:") | t.startswith("[IMPORTANT:") | t.startswith("[CONTEXT")
    rest = F.when(F.instr(t, "] ") > 0, F.substring(t, F.instr(t, "] ") + 2, F.length(t))).otherwise(
        F.regexp_replace(F.regexp_replace(t, r"^\[(System:|IMPORTANT:|CONTEXT)", ""), r"^[ \]]+", "")
    )
    return F.substring(F.when(noisy, rest).otherwise(t), 1, width)


def frontmatter(text: Column) -> Column:
    """MAP<STRING, STRING> of the lines between the first two '---', empty where there are none."""
    block = F.regexp_extract(text, r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:]+:"))
    return F.map_from_entries(
        F.filter(
            F.transform(
                lines,
                lambda x, i: F.struct(
                    F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"),
                    F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"),
                ),
            ),
            lambda kv: kv["key"] != "",
        )
    )


def body(text: Column) -> Column:
    """The text behind the frontmatter."""
    return F.regexp_replace(text, r"(?s)^---[ \t]*\r?\n.*?\r?\n---[ \t]*\r?\n?", "")


def flattened(pairs: Column) -> Column:
    """'k: v; k: v' of a map, keys sorted, nulls left out."""
    entries = F.filter(F.array_sort(F.map_entries(pairs)), lambda e: e["value"].isNotNull())
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def linkified(text: Column, titles: list[str]) -> Column:
    """Every whole-word mention of a title as [[title]], the longest first, those already linked left alone.

    One pass over the text by one alternation; the titles are a bounded list.
    """
    names = "|".join("\\Q" + t + "\\E" for t in sorted(titles, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}\[|])({names})(?![\p{{L}}\p{{N}}\]|])", "[[$1]]") if titles else text


def stored_title(title: Column, content: Column) -> Column:
    """The given title, else the derived one of 80 characters, else 'fact'."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(derived_title(content, 80), F.lit("")), F.lit("fact"))


def id_list(json: Column, keys: tuple[str, ...], most: int = 20) -> Column:
    """ARRAY<STRING> under the first of the keys that a JSON object has, at most `most` ids."""
    found = F.coalesce(*[F.from_json(F.get_json_object(json, f"$.{k}"), "array<string>") for k in keys], F.array().cast("array<string>"))
    return F.slice(found, 1, most)
