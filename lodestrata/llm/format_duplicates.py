"""Duplicates hidden by formatting: one record per fact, with the number of its copies.

Each distinct content is canonicalised once, by built-in expressions: to its words in order and, if it consists of
fields with values, to its set of (field, value) pairs. Word sequences and pairs are dictionary-encoded as integers,
a content becomes the sorted tuple of its integers, and the compact tuples are grouped. Contents of one word sequence
belong together even where only one spelling of them shows its fields. Texts are shuffled once, to find the distinct
ones; from there on 128-bit digests and integers stand for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import let
from lodestrata.llm.skew import integer_ids, join_hot_aside
from lodestrata.session import ensure_checkpoint_dir

_FIELD = r"[\"'“«]?\p{L}[\p{L}\p{N}_   ‑\t-]{0,30}[\"'”»]?\s*[:=]"
#: Separators between fields, tried in this order; a separator counts only before the next field's name.
_SEPARATORS = (";", r"\|", r"\r?\n", ",")


def words(text: Column) -> Column:
    """Words joined by blanks: runs of letters and digits of any script, letter case aside."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))  # its upper case is SS
    return F.array_join(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), 0), " ")


def fields(text: Column) -> Column:
    """Sorted 'field=value' texts if the content consists of two fields or more, else null."""

    def whole(parts: Column) -> Column:
        return F.when((F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(rf"(?s)^{_FIELD}.*[\p{{L}}\p{{N}}]")), parts)

    def split(body: Column) -> Column:
        return F.coalesce(*[let(F.split(body, rf"[\s  ​]*{sep}[\s  ​]*(?={_FIELD})"), whole) for sep in _SEPARATORS])

    body = F.regexp_replace(text, r"^[\s  ​>{\[(*•“«-]+|[\s  ​}\]);,.!?…]+$", "")
    pair = lambda p: F.concat(words(F.regexp_extract(p, r"(?s)^([^:=]*)[:=]", 1)), F.lit("="), words(F.regexp_extract(p, r"(?s)^[^:=]*[:=](.*)$", 1)))
    # two marks at least, or there is nothing to split
    return F.when(text.rlike(r"(?s)[:=].*[:=]"), F.array_sort(F.transform(let(body, split), pair)))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def canonical_tuples(canon: DataFrame, n_rows: int) -> DataFrame:
    """(h, seq, tuple) for rows (h, w, f): integer of the word sequence, sorted integers of the fields or null.

    h, w: digests of a content and of its word sequence; f: those of its fields.
    """
    items = canon.select(
        "h",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(True).alias("is_seq"), F.col("w").alias("item"))),
                F.coalesce(F.transform("f", lambda x: F.struct(F.lit(False).alias("is_seq"), x.alias("item"))), F.array().cast("array<struct<is_seq:boolean,item:binary>>")),
            )
        ).alias("x"),
    ).select("h", "x.is_seq", "x.item")
    dictionary = integer_ids(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item", n_rows * 4)
    coded = join_hot_aside(items, dictionary, "item", n_rows * 4)
    return coded.groupBy("h").agg(
        F.max(F.when(F.col("is_seq"), F.col("code"))).alias("seq"),
        F.sort_array(F.collect_list(F.when(~F.col("is_seq"), F.col("code")))).alias("fields"),
    ).select("h", "seq", F.when(F.size("fields") > 0, F.concat_ws(",", F.transform("fields", lambda c: c.cast("string")))).alias("tuple"))


def _classes(tuples: DataFrame) -> DataFrame:
    """(seq, class, n): word sequences linked through shared field tuples fall into one class; n contents have each."""
    # a sequence whose fields show in one spelling only takes that label
    first = tuples.groupBy("seq").agg(
        F.coalesce(F.min("tuple"), F.concat(F.lit("s"), F.col("seq").cast("string"))).alias("class"), F.max("tuple").alias("other"), F.count(F.lit(1)).alias("n")
    )
    ambiguous = first.where("other <> class").select("seq")
    if ambiguous.isEmpty():
        return first.drop("other")
    # sequences read as several field sets link these: among them the smaller label spreads until nothing changes
    links = tuples.where("tuple IS NOT NULL").join(ambiguous, "seq", "left_semi").select("seq", F.col("tuple").alias("label")).distinct()
    state = links.withColumn("class", F.col("label")).checkpoint()
    while True:
        step = state.join(state.groupBy("seq").agg(F.min("class").alias("c1")), "seq")
        step = step.join(step.groupBy("label").agg(F.min("c1").alias("c2")), "label")
        step = step.select("seq", "label", F.least("class", "c1", "c2").alias("class"), (F.least("c1", "c2") < F.col("class")).alias("moved")).checkpoint()
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    renamed = state.groupBy("label").agg(F.min("class").alias("to"))
    return first.join(renamed, F.col("class") == F.col("label"), "left").select("seq", F.coalesce("to", "class").alias("class"), "n")


def format_duplicates(records: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """One row per record (id, keep_id, copies): keep_id is the smallest id of its class, copies the class's size.

    Records delivered again count once, an id with several contents with one of them, always the same; null ids and
    contents are left out; contents without any word form one class. An empty table gives no rows. Other columns are
    ignored.
    """
    ensure_checkpoint_dir(records.sparkSession)
    pairs = records.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).where("id IS NOT NULL AND content IS NOT NULL")
    members = pairs.groupBy("id").agg(F.min(_digest(F.col("content"))).alias("h"))
    content = F.col("content")
    canon = (
        pairs.select("content").distinct()
        .select(_digest(content).alias("h"), _digest(words(content)).alias("w"), F.transform(fields(content), _digest).alias("f"))
        .checkpoint()
    )
    n_values = canon.count()
    tuples = canonical_tuples(canon, n_values).checkpoint()
    placed = join_hot_aside(tuples.select("h", "seq"), _classes(tuples), "seq", n_values).select("h", "class")
    held = placed.join(members.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "h")
    groups = held.groupBy("class").agg(F.min("first").alias("keep_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("m"))
    kept = join_hot_aside(held.select("h", "class", "n"), groups, "class", n_values, count="m")
    return join_hot_aside(members, kept.select("h", "keep_id", "copies", "n"), "h", records.count()).select("id", "keep_id", "copies")
