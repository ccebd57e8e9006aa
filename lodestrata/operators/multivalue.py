"""Several values packed in one field: one row per value, with its position.

Dictionary-guided segmentation. The dictionary holds whole values that the data itself delimits beyond doubt: quoted
spans, and fields without any delimiter. A multi-pattern automaton finds all known values in a text, and dynamic
programming picks the cheapest cover of the text by quoted spans, known values, delimiters and unknown runs. A known
value that contains a delimiter stays whole unless its parts are known values too. The dictionary meets the texts in
blocks of bounded size, one automaton each; more blocks mean more copies of the texts, no lost values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ensure_checkpoint_dir

#: Fixed: what separates two values. A blank before '#' does so too.
DELIMITERS = ",;|\n\r\t\u3001\uff0c\uff1b"
_QUOTED = re.compile(r'"((?:[^"\\]|""|\\.)*)"|\'((?:[^\'\\]|\'\'|\\.)*)\'(?!\w)', re.S)
_LIST_MARK = re.compile(r"[-*\u2022\u2013]\s+")
_HASH = re.compile(r"\s+(?=#)")
_BLANK = " \u00a0\u2009\u200b\ufeff"
#: Cost of covering a part: a known whole of k parts beats k parts that aren't all known, not k known ones.
_COST_KNOWN, _COST_UNKNOWN = 1.0, 2.5
#: Least size of the texts that one task splits.
SHARD_BYTES = 500_000


def _enclosed(text: str) -> tuple[int, int]:
    """The text within blanks and one pair of brackets around all of it."""
    a, b = 0, len(text)
    while a < b and (text[a] in _BLANK or text[a] in DELIMITERS):
        a += 1
    while b > a and (text[b - 1] in _BLANK or text[b - 1] in DELIMITERS):
        b -= 1
    if b - a >= 2 and text[a] + text[b - 1] in ("[]", "{}", "()"):
        return a + 1, b - 1
    return a, b


def _unquote(body: str, mark: str) -> str:
    return re.sub(r"\\(.)", r"\1", body.replace(mark * 2, mark)) if mark in body or "\\" in body else body


def segments(text: str | None, hits: list[tuple[int, int]]) -> list[str]:
    """The values of one text in order. hits: (start, end) of known values that contain a delimiter or not."""
    if not text:
        return []
    a, b = _enclosed(text)
    n = b - a
    text = text[a:b]
    # 1. fixed pieces: quoted spans that start a value, and the delimiters outside them
    quoted, skips, border, i, fresh = {}, {}, [False] * (n + 1), 0, True
    border[0] = border[n] = True
    while i < n:
        if fresh:
            mark = _LIST_MARK.match(text, i) if i == 0 or text[i - 1] in "\n\r" else None
            if mark:
                skips[i] = i = mark.end()
                border[i] = True
                continue
            if text[i] in _BLANK:
                i += 1
                continue
            lead = i + (text[i] == "#")
            m = _QUOTED.match(text, lead) if lead < n and text[lead] in "\"'" else None
            if m and re.match(rf"[{_BLANK}]*(?:$|[{DELIMITERS}]|#)", text[m.end() :]):
                quoted[i] = (m.end(), _unquote(m[1], '"') if m[1] is not None else _unquote(m[2], "'"))
                i = m.end()
                border[i] = True
                fresh = False
                continue
        inner = _QUOTED.match(text, i) if text[i] == '"' else None
        if inner:
            i = inner.end()
            fresh = False
            continue
        if text[i] in DELIMITERS:
            border[i] = border[i + 1] = True
            fresh = True
        elif _HASH.match(text, i):
            border[i] = True
            i = _HASH.match(text, i).end()
            border[i] = True
            fresh = True
            continue
        else:
            fresh = False
        i += 1
    # 2. candidates from each border: a quoted span, the plain run to the next border, known values between borders
    known = {(s - a, e - a) for s, e in hits if s >= a and e <= b}
    trimmed = {}
    for s, e in known:
        s0, e0 = s, e
        while s0 > 0 and text[s0 - 1] in _BLANK + "#" and not border[s0]:
            s0 -= 1
        while e0 < n and text[e0] in _BLANK and not border[e0]:
            e0 += 1
        if border[s0] and border[e0]:
            trimmed.setdefault(s0, []).append((e0, text[s:e]))
    best: list = [None] * (n + 1)
    best[0] = (0.0, 0, None)
    for i in range(n):
        if best[i] is None:
            continue
        cost = best[i][0]
        steps = []
        if i in skips:
            steps.append((skips[i], 0.0, None))
        elif i in quoted:
            steps.append((quoted[i][0], _COST_KNOWN, quoted[i][1]))
        else:
            e = i
            if text[i] in DELIMITERS or (text[i] in _BLANK and not border[i + 1] and i + 1 in quoted):
                steps.append((i + 1, 0.0, None))
            else:
                e = i + 1
                while e < n and not border[e] and e not in quoted:
                    e += 1
                value = text[i:e]
                bare = value.strip(_BLANK)
                if e in quoted and not bare:
                    steps.append((e, 0.0, None))
                else:
                    whole = any(x[0] == e for x in trimmed.get(i, ()))
                    steps.append((e, 0.0 if not bare else _COST_KNOWN if whole else _COST_UNKNOWN, value))
            for e, value in trimmed.get(i, ()):
                parts = sum(c in DELIMITERS for c in value)
                steps.append((e, _COST_KNOWN * (1 + parts) + 0.01 * parts, text[i:e]))
        for e, c, value in steps:
            # on equal cost the finer cover stays: parts that are known values are values of their own
            if best[e] is None or cost + c < best[e][0] - 1e-9:
                best[e] = (cost + c, i, value)
    out, e = [], n
    while e > 0:
        _, s, value = best[e]
        if value is not None:
            value = value if s in quoted else value.strip(_BLANK + "\n\r\t")
            value = value[1:].strip(_BLANK) if value.startswith("#") else value.strip(_BLANK)
            if value:
                out.append(value)
        e = s
    return out[::-1]


def known_values(texts: DataFrame, column: str, min_count: int = 3) -> DataFrame:
    """(value, n): whole values that the texts delimit beyond doubt, in at least `min_count` of the places."""
    quotes = F.concat(
        F.regexp_extract_all(column, F.lit(r'(?:^|[,;|\n\t\[ ])"((?:[^"\\]|""|\\.)+)"'), 1),
        F.regexp_extract_all(column, F.lit(r"(?:^|[,;|\n\t\[ ])'((?:[^'\\])+)'(?=$|[,;|\n\r\t\] ])"), 1),
    )
    quotes = F.transform(quotes, lambda q: F.regexp_replace(F.regexp_replace(q, r'""', '"'), r"\\(.)", "$1"))
    alone = F.when(~F.col(column).rlike(f"[{DELIMITERS}\"\\[\\]{{}}#]"), F.array(F.trim(column))).otherwise(F.array().cast("array<string>"))
    found = texts.select(F.explode(F.concat(F.coalesce(quotes, F.array().cast("array<string>")), F.coalesce(alone, F.array().cast("array<string>")))).alias("value"))
    return found.where("trim(value) <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def split_values(df: DataFrame, keys: list[str], column: str, min_count: int = 3, max_block_bytes: int = 8_000_000) -> DataFrame:
    """One row per value (keys..., pos, tag): pos counts from 1 in the order written.

    Repeated values stay; empty ones take no position. Null and empty fields give no rows, as does an empty table.
    A delimiter in quotation marks belongs to the value, as does a quotation mark doubled or escaped in them.
    Enclosing brackets, list marks, a leading # and outer blanks don't belong to it. Other columns are ignored.

    Each distinct text is split once. Blocks of the dictionary, `max_block_bytes` each, meet shards of the texts, at
    least four times as large as a block and so larger than what is copied for them, in tasks of their own.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(column).alias("text")).where("text <> ''")
    ensure_checkpoint_dir(df.sparkSession)
    # read for its size and again in the search
    known = known_values(rows, "text", min_count).select("value").checkpoint()
    texts = rows.select("text").distinct()
    size = lambda d, c: d.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias("n"))
    bytes_known, bytes_texts = (size(d, c).first().n for d, c in ((known, "value"), (rows, "text")))
    blocks = -(-bytes_known // max_block_bytes) or 1
    shards = -(-bytes_texts // max(SHARD_BYTES, 4 * bytes_known // blocks)) or 1

    def part(name: str, by: str, n: int) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(n).cast("bigint")).alias(name)

    def each(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)

    left = texts.select("text", part("shard", "text", shards)).select("*", each("block", blocks)).groupBy("block", "shard")
    right = known.select("value", part("block", "value", blocks)).select("*", each("shard", shards)).groupBy("block", "shard")
    if blocks == 1:
        split = left.cogroup(right).applyInPandas(_split, "text string, tags array<string>")
    else:
        found = left.cogroup(right).applyInPandas(_find, "text string, hits array<int>")
        split = found.groupBy("text").agg(F.flatten(F.collect_list("hits")).alias("hits")).mapInPandas(_cover, "text string, tags array<string>")
    # one row a text on this side: where a text is hot, its rows are parted among tasks
    out = rows.join(split, "text").select(*names, F.posexplode("tags").alias("pos", "tag"))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], (F.col("pos") + 1).cast("bigint").alias("pos"), "tag")


def _hits(texts: pd.Series, words: pd.Series) -> list[list[int]]:
    """Starts and ends of the known values in each text."""
    import ahocorasick

    if words.empty:
        return [[] for _ in texts]
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, len(w))
    automaton.make_automaton()
    return [[x for end, k in automaton.iter(text) for x in (end + 1 - k, end + 1)] for text in texts]


def _values(text: str, hits: list[int]) -> list[str]:
    return segments(text, sorted(zip(hits[::2], hits[1::2]), key=lambda h: (h[1], h[0])))


def _find(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"text": texts["text"], "hits": pd.Series(_hits(texts["text"], words["value"]), texts.index, object)})


def _split(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    values = [_values(t, h) for t, h in zip(texts["text"], _hits(texts["text"], words["value"]))]
    return pd.DataFrame({"text": texts["text"], "tags": pd.Series(values, texts.index, object)})


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"text": pdf["text"], "tags": pd.Series([_values(t, h) for t, h in zip(pdf["text"], pdf["hits"])], pdf.index, object)})
