"""Full-text search: postings, BM25 for one query or many, phrases, fallbacks."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.stem import folded, stems
from lodestrata.functions.text import record_id, tokens
from lodestrata.session import ensure_checkpoint_dir

#: Fixed: parameters of BM25, and the least weight of a term that most documents have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: From so many queries, or documents, on, a word of a query is looked up together with the queries that share it. Any
#: values give the same rows.
SHARED, FREQUENT = 16, 4096


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, term, tf, dl): term counts and document lengths; documents without a term have no row."""
    words = docs.select(F.col(id_col).alias("doc"), tokens(text).alias("words"))
    return (
        words.select("doc", F.size("words").cast("double").alias("dl"), F.explode("words").alias("term"))
        .groupBy("doc", "term", "dl")
        .agg(F.count(F.lit(1)).cast("double").alias("tf"))
    )


def _weight(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def _begins(term: str) -> Callable[[Column], Column]:
    return lambda w: w.startswith(term)


def bm25(docs: DataFrame, id_col: str, text: Column, terms: list[str]) -> DataFrame:
    """(doc, score) of one query, larger is better. One pass: no postings table, the terms are counted in place."""
    words = docs.select(F.col(id_col).alias("doc"), tokens(text).alias("words"))
    counts = [F.size(F.filter("words", _equals(t))).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = words.select("doc", F.size("words").cast("double").alias("dl"), *counts)
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("dl").alias("avgdl"),
        *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).cast("double").alias(f"df{i}") for i in range(len(terms))],
    )
    hit = F.lit(False)
    score = F.lit(0.0)
    for i in range(len(terms)):
        hit = hit | (F.col(f"tf{i}") > 0)
        score = score + _weight(F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))
    # the statistics are one row
    return counted.where(hit).crossJoin(F.broadcast(stats)).select("doc", score.alias("score"))


def bm25_stemmed(docs: DataFrame, id_col: str, columns: list[str], query: str) -> DataFrame:
    """(doc, score) over several columns by stems: a document answers if a stem of any column begins with that of a word.

    Each word in each column counts as a phrase of its own, with its own document frequency; a document's length is
    that of all columns. Null columns are empty. Stems are made in Arrow batches, once for each document.
    """
    words = folded(query)
    stemmed = docs.select(F.col(id_col).alias("doc"), F.array(*[stems(F.col(c)) for c in columns]).alias("s"))
    counts = {
        f"tf{i}": F.size(F.filter(F.element_at("s", c + 1), _begins(w))).cast("double")
        for i, (w, c) in enumerate((w, c) for w in words for c in range(len(columns)))
    }
    counted = stemmed.select("doc", F.size(F.flatten("s")).cast("double").alias("dl"), *[v.alias(k) for k, v in counts.items()])
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(k) > 0, 1)).cast("double").alias(f"d{k}") for k in counts]
    )
    hit, score = F.lit(False), F.lit(0.0)
    for k in counts:
        hit = hit | (F.col(k) > 0)
        score = score + _weight(F.col("n"), F.col(f"d{k}"), F.col(k), F.col("dl"), F.col("avgdl"))
    # the statistics are one row
    return counted.where(hit).crossJoin(F.broadcast(stats)).select("doc", score.alias("score"))


def bm25_batch(docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_id: str, query_text: Column, k: int) -> DataFrame:
    """(query, doc, score, rank): the best `k` documents of each query, ties by document id.

    Each distinct set of words is answered once. Its words are parted in shared ones (`SHARED` sets or more ask for
    them, or `FREQUENT` documents have them) and the rest. As no word lowers a score, only two kinds of documents can
    be among the best: those with a word of the rest, and the best `k` by the shared words alone, which are found once
    for all sets with the same shared words. These candidates get their whole scores. So postings meet the distinct
    sets of shared words, not the queries, and a posting of the rest meets fewer than `SHARED` sets.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    posts = postings(docs, id_col, text)
    # from the same words as the postings; documents without a term count too
    stats = docs.select(F.size(tokens(text)).alias("dl")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    words = queries.select(F.col(query_id).alias("query"), F.explode(tokens(query_text)).alias("term")).groupBy("query").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    # words hold no blanks
    asked = words.select("query", "terms", F.array_join("terms", " ").alias("set"))
    sets = asked.select("set", "terms").distinct()
    terms = sets.select("set", F.explode("terms").alias("term"))
    frequency = posts.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    known = (
        terms.groupBy("term").agg(F.count(F.lit(1)).alias("sets")).join(frequency, "term")
        .select("term", "df", ((F.col("sets") >= SHARED) | (F.col("df") >= FREQUENT)).alias("shared"))
    )
    # read for the shared words, for the rest and for the scores
    held = (
        posts.join(known, "term").crossJoin(F.broadcast(stats))
        .select("doc", "term", "shared", _weight(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("part"))
        .groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "part", "shared"))).alias("parts"))
        .checkpoint()
    )
    parted = terms.join(known, "term").groupBy("set").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("shared"), F.col("term")))), " ").alias("base"))
    salts = 4
    bases = parted.select("base").where("base <> ''").distinct().select("base", F.explode(F.split("base", " ")).alias("term"))
    near = (
        held.select("doc", F.inline(F.filter("parts", lambda p: p["shared"]))).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
        .join(bases.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["term", "salt"])
        .groupBy("base", "doc").agg(F.round(F.sum("part"), 6).alias("score"))
        .withColumn("n", F.row_number().over(W.partitionBy("base").orderBy(F.desc("score"), "doc"))).where(F.col("n") <= k)
    )
    rare = held.select("doc", F.inline(F.filter("parts", lambda p: ~p["shared"]))).join(terms, "term").select("set", "doc")
    candidates = rare.unionByName(near.join(parted, "base").select("set", "doc")).distinct()
    parts = F.filter("parts", lambda p: F.array_contains("terms", p["term"]))
    scored = (
        candidates.alias("c").join(held.alias("h"), F.col("c.doc").eqNullSafe(F.col("h.doc"))).select("set", "c.doc", "parts").join(sets, "set")
        .select("set", "doc", F.round(F.aggregate(parts, F.lit(0.0), lambda x, p: x + p["part"]), 6).alias("score"))
    )
    order = W.partitionBy("set").orderBy(F.desc("score"), "doc")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("query", "set").join(best, "set").select("query", "doc", "score", "rank")


def any_term(text: Column, terms: list[str], prefix: bool = True) -> Column:
    """Whether a word of the text is, or begins with, one of the terms."""
    found = F.lit(False)
    for t in terms:
        found = found | F.exists(tokens(text), _begins(t) if prefix else _equals(t))
    return found


def all_terms(text: Column, query: str) -> Column:
    """Whether the text has every word of the query; marks in the query only separate words."""
    found = F.lit(True)
    for t in re.findall(r"[^\W_]+", query.lower()):
        found = found & F.exists(tokens(text), _equals(t))
    return F.coalesce(found, F.lit(False))


def recalled(facts: DataFrame, query: str, from_date: date | None = None, to_date: date | None = None) -> DataFrame:
    """The facts that answer the query, with `exact`: exact hits first, then by importance, ties by id.

    A fact is exact if its content is the query or its id the query's. Others answer if a word of content, title or
    tags begins like a word of the query; where no fact does, those that contain the query. Only facts created from
    `from_date` to `to_date` count if they are given. Which of the two ways answers is one row, joined by broadcast.
    """
    if from_date is not None:
        facts = facts.where((F.col("created_at") >= F.lit(from_date).cast("timestamp_ntz")) & (F.col("created_at") < F.date_add(F.lit(to_date), 1).cast("timestamp_ntz")))
    columns = [F.col(c) for c in ("content", "title", "tags")]
    word = F.lit(False)
    for c in columns:
        word = word | F.coalesce(any_term(c, query.lower().split()), F.lit(False))
    exact = F.coalesce(F.col("content") == query, F.lit(False)) | F.coalesce(F.col("id") == record_id(F.lit(query)), F.lit(False))
    rows = facts.withColumns({"exact": exact, "_word": word, "_like": like_any(columns, query)})
    any_word = rows.agg(F.coalesce(F.max("_word"), F.lit(False)).alias("_any"))
    hits = rows.crossJoin(F.broadcast(any_word)).where(F.col("exact") | F.when(F.col("_any"), F.col("_word")).otherwise(F.col("_like")))
    return hits.drop("_word", "_like", "_any").orderBy(F.desc("exact"), F.desc_nulls_last("importance"), "id")


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words stand in the text in a row, the last one as a prefix."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(text), " "))
    return F.contains(joined, F.lit(" " + " ".join(words)))


def like_any(columns: list[Column], part: str) -> Column:
    """Substring in any of the columns, letter case aside; % and _ are ordinary characters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(part.lower()))
    return found


def with_fallback(hits: DataFrame, fallback: DataFrame) -> DataFrame:
    """`hits`, or `fallback` if there are none: decided by a join on presence, not on the driver."""
    present = hits.limit(1).select(F.lit(1).alias("_one"))
    return hits.unionByName(fallback.withColumn("_one", F.lit(1)).join(F.broadcast(present), "_one", "left_anti").drop("_one"))
