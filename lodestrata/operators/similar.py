"""Near-identical texts by Jaccard similarity of their words, exactly, by prefix and position filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import ensure_checkpoint_dir


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words of two arrays of distinct words; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _sets(df: DataFrame, id_col: str, text: Column, *more: str) -> DataFrame:
    """(id, words, more...): the sorted distinct words of each text that has any."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")))
    return df.select(F.col(id_col).alias("id"), words.alias("words"), *more).where("size(words) > 0")


def _ordered(classes: DataFrame) -> DataFrame:
    """(class_id, len, words, more...) of classes (class_id, words, more...): of `len` words those that other classes
    have too, from the rarest on. Classes that share no word have no row.
    """
    more = [c for c in classes.columns if c not in ("class_id", "words")]
    rarity = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # word counts meet the words in one shuffle, the set is put together again
    return (
        classes.select("class_id", *more, F.size("words").alias("len"), F.explode("words").alias("word"))
        .join(rarity, "word")
        .groupBy("class_id", *more, "len")
        .agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
        .select("class_id", *more, "len", F.transform("w", lambda x: x["word"]).alias("words"))
    )


def _pairs(ordered: DataFrame, threshold: float, wanted: Column) -> DataFrame:
    """(x, y, score) of sets at least `threshold` similar for which `wanted`, over a.* and b.*, holds; each pair once.

    ordered: as `_ordered` gives it; each column more comes as x_ and y_. Two sets that similar share a word among
    their rarest n - ceil(threshold * n) + 1; words that no other set has are the rarest, and as they can't be shared
    only their number counts. These prefixes are joined. From the place of a shared word on, both sets must hold
    enough words still, and bits of the words' hashes tell most of the pairs that share too few. What is left is
    compared where it meets, at the first word that the prefixes share: pairs are not shuffled.
    """
    more = [c for c in ordered.columns if c not in ("class_id", "len", "words")]
    alone = F.col("len") - F.size("words")
    prefix = F.slice("words", F.lit(1), F.greatest(F.col("len") - F.ceil(F.col("len") * F.lit(threshold) - 1e-9) + 1 - alone, F.lit(0)).cast("int"))

    def bits(seed: int) -> Column:
        # 63 bits: shifting by 63 would give the sign
        return F.aggregate("words", F.lit(0).cast("bigint"), lambda x, w: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.lit(seed), w), F.lit(63)).cast("int"))))

    heads = ordered.select("*", prefix.alias("head"), bits(0).alias("b0"), bits(1).alias("b1")).select("*", F.posexplode("head").alias("pos", "word"))
    needed = F.ceil((F.col("a.len") + F.col("b.len")) * F.lit(threshold / (1 + threshold)) - 1e-9)

    def most(x: str, y: str) -> Column:
        """As many words can be shared."""
        lacking = [F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.bitwise_not(f"{y}.{c}"))) for c in ("b0", "b1")]
        return F.size(f"{x}.words") - F.greatest(*lacking)

    shared = F.size(F.array_intersect("a.words", "b.words")).cast("double")
    return (
        heads.alias("a").join(heads.alias("b"), (F.col("a.word") == F.col("b.word")) & wanted)
        .where((F.col("a.len") >= F.col("b.len") * threshold - 1e-9) & (F.col("b.len") >= F.col("a.len") * threshold - 1e-9))
        .where(F.least(F.size("a.words") - F.col("a.pos"), F.size("b.words") - F.col("b.pos")) >= needed)
        .where((most("a", "b") >= needed) & (most("b", "a") >= needed))
        .where(F.element_at(F.array_intersect("a.head", "b.head"), 1) == F.col("a.word"))
        .select(
            F.col("a.class_id").alias("x"), F.col("b.class_id").alias("y"), (shared / (F.col("a.len") + F.col("b.len") - shared)).alias("score"),
            *[F.col(f"{s}.{c}").alias(f"{t}_{c}") for s, t in (("a", "x"), ("b", "y")) for c in more],
        )
        .where(F.col("score") >= threshold - 1e-9)
    )


def near_duplicates(df: DataFrame, id_col: str, text: Column, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, links): texts with one word set fall into a class named by its smallest id; `links` is the
    number of other classes at least `threshold` similar. Null and blank texts have no row.

    Classes that differ in nothing but words of their own (numbers, names) are of one kind: they are as similar to
    each other and to any other class. Kinds are compared and classes counted, so many near-duplicates of one
    pattern, each similar to all the others, are one row.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sets = _sets(df, id_col, text)
    # numbered: short keys for what is shuffled word by word; the numbers must stay, hence the checkpoint
    classes = sets.groupBy("words").agg(F.min("id").alias("first")).select(F.monotonically_increasing_id().alias("class_id"), "first", "words").checkpoint()
    ordered = _ordered(classes.select("class_id", "words"))
    kinds = ordered.groupBy("len", "words").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("many"))
    pairs = _pairs(kinds, threshold, F.col("a.class_id") < F.col("b.class_id"))
    others = pairs.select(F.inline(F.array(F.struct(F.col("x").alias("class_id"), F.col("y_many").alias("n")), F.struct(F.col("y").alias("class_id"), F.col("x_many").alias("n")))))
    size = F.size("words").cast("double")
    own = kinds.where((F.col("many") > 1) & (size / (F.col("len") + F.col("len") - size) >= threshold - 1e-9)).select("class_id", (F.col("many") - 1).alias("n"))
    counted = others.unionByName(own).groupBy("class_id").agg(F.sum("n").alias("links"))
    links = ordered.join(kinds.join(counted, "class_id").select("len", "words", "links"), ["len", "words"]).select("class_id", "links")
    named = classes.join(links, "class_id", "left").select("words", F.col("first").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return sets.join(named, "words").select("id", "class_id", "links")


def most_similar(new: DataFrame, old: DataFrame, id_col: str, text: Column, threshold: float = 0.8) -> DataFrame:
    """(id, match_id, score): for each new text the most similar old one, `threshold` at least; ties by the smallest id.

    Texts with one word set are compared once, however many there are. Null and blank texts and texts without a match
    have no row.
    """
    fresh = _sets(new, id_col, text).withColumn("fresh", F.lit(True))
    known = _sets(old, id_col, text).withColumn("fresh", F.lit(False))
    classes = fresh.unionByName(known).groupBy("words").agg(
        F.min("id").alias("class_id"), F.bool_or("fresh").alias("asks"), F.bool_or(~F.col("fresh")).alias("answers"), F.min(F.when(~F.col("fresh"), F.col("id"))).alias("first_old")
    )
    # a class may hold new and old texts: the old ones are similar to the new ones of their own class by 1
    pairs = _pairs(_ordered(classes.select("class_id", "words", "asks", "answers")), threshold, F.col("a.asks") & F.col("b.answers") & (F.col("a.class_id") != F.col("b.class_id"))).select("x", "y", "score")
    own = classes.where("asks AND answers").select(F.col("class_id").alias("x"), F.col("class_id").alias("y"), F.lit(1.0).alias("score"))
    named = pairs.unionByName(own).join(classes.select(F.col("class_id").alias("y"), "first_old"), "y")
    best = named.groupBy(F.col("x").alias("class_id")).agg(F.min_by(F.struct("first_old", "score"), F.struct((-F.round("score", 6)).alias("s"), "first_old")).alias("r"))
    found = best.join(classes.select("class_id", "words"), "class_id").select("words", F.col("r.first_old").alias("match_id"), F.round("r.score", 6).alias("score"))
    return fresh.join(found, "words").select("id", "match_id", "score")
