"""Format duplicates, personal information, token ids, leakage and subjects: brute force, round trips, held-out cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import leakage, personal, subjects, tokenize
from lodestrata.llm.format_duplicates import fields, format_duplicates, words
from lodestrata.llm.skew import integer_ids, join_hot_aside


def test_format_duplicates(spark):
    data = [
        ("a1", "Ref: 7; owner team: core; mood: calm"), ("a2", '{MOOD = "Calm";  owner_team = core; ref = 7}'), ("a3", "ref 7 owner team core mood calm"),
        ("a4", "- ref=7 | mood=calm | owner team=core."), ("b1", "Ref: 7; owner team: calm; mood: core"), ("c1", "The  cat, sat!"), ("c2", "the CAT sat"), ("c3", "the cat sat on"),
        ("d1", "cat the sat"), ("e1", "Straße 5"), ("e2", "STRASSE 5"), ("f1", ""), ("f2", "--"), ("g1", None), (None, "x"), ("a1", "Ref: 7; owner team: core; mood: calm"),
        ("h1", "word " * 5000), ("h2", "WORD\n" * 5000),
    ]
    got = {r.id: (r.keep_id, r.copies) for r in format_duplicates(spark.createDataFrame(data, "id string, content string")).collect()}
    assert got == {
        "a1": ("a1", 4), "a2": ("a1", 4), "a3": ("a1", 4), "a4": ("a1", 4), "b1": ("b1", 1), "c1": ("c1", 2), "c2": ("c1", 2), "c3": ("c3", 1), "d1": ("d1", 1),
        "e1": ("e1", 2), "e2": ("e1", 2), "f1": ("f1", 2), "f2": ("f1", 2), "h1": ("h1", 2), "h2": ("h1", 2),
    }
    assert format_duplicates(spark.createDataFrame([], "id string, content string")).count() == 0


def test_one_sequence_with_two_readings_links_its_classes(spark):
    data = [("1", "a b: c; d: e"), ("2", "a: b c; d: e"), ("3", "d = e; a = b c"), ("4", "d=e;a b=c")]
    assert {r.keep_id for r in format_duplicates(spark.createDataFrame(data, "id string, content string")).collect()} == {"1"}


def test_fields_and_words(spark):
    df = spark.createDataFrame([("Note 5: call a, b",), ("x: 1, y: 2, z",), ("k: a; k: b",)], "t string")
    assert [r[0] for r in df.select(fields(F.col("t"))).collect()] == [None, ["x=1", "y=2 z"], ["k=a", "k=b"]]
    assert df.select(words(F.lit("Ä_b-C 1٢"))).first()[0] == "ä b c 1٢"


def test_hot_join_equals_plain_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(1000)], "key string, v int")
    lookup = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    got = join_hot_aside(rows, lookup, "key", 4000)
    assert got.count() == 4000 and got.where("key = 'hot'").select("s").distinct().count() == 1
    ids = integer_ids(lookup, "key", 4000, per_range=50)
    assert ids.select("code").distinct().count() == 1001


def encode(enc, text):
    parts, a = [], 0
    for b in tokenize.chunk_bounds(text):
        parts.append(tokenize.encode_chunk(enc, text[a:b]))
        a = b
    return tokenize.join_chunks(enc, parts, {})


@pytest.fixture(scope="module")
def enc():
    pytest.importorskip("public_tokenizers")
    return tokenize.encoder(tokenize.default_path())


def test_chunks_agree_with_whole_text(enc):
    rng = random.Random(4)
    for alphabet in ("ab 1'\n\t  é日.,s", "the cat's  don't\r\n ", "<|endoftext|> x", "\U0001f600a "):
        for _ in range(300):
            text = "".join(rng.choices(alphabet, k=rng.randrange(0, 600)))
            assert encode(enc, text) == enc.encode_ordinary(text)
    for text in ("x" * 9000, " " * 9000, "word " * 3000, "日本" * 4000):
        assert encode(enc, text) == enc.encode_ordinary(text)


def test_token_ids(spark, enc):
    texts = [None, "", " ", "same text here", "same text here", "long " * 5000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "same text here", "y")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in tokenize.token_ids(df).collect()]
    assert sorted(got) == [(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)]
    assert tokenize.token_ids(df.limit(0)).count() == 0


def brute_leaks(docs, items, k):
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for a in range(len(w) - k + 1):
            grams.setdefault(tuple(w[a : a + k]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t or "")] for a in range(len(w) - k + 1) for i in grams.get(tuple(w[a : a + k]), ())}


@pytest.mark.parametrize("shard, block", [(50, 10), (10**6, 10**6)])
def test_leaks_equal_brute_force(spark, shard, block):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(["a", "b", "c", "D", "e-f"], k=n))
    items = [(i, text(12)) for i in range(8)] + [(98, None), (99, "short")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)] + [(500, items[0][1].upper() + "! " + items[1][1]), (501, None), (502, items[2][1]), (502, items[2][1])]
    got = leakage.leaked_items(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 5, shard_words=shard, block_words=block
    )
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(brute_leaks(docs, items, 5))
    assert got.where("doc_id = 500 AND item_id = 0").first().n_words >= 12


def test_clean_corpus(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b", "y"), (None, "a b c d e", "z")], "doc_id bigint, text string, item_id string")
    leaks = leakage.leaked_items(docs, spark.createDataFrame([(7, "a b c d e")], "item_id bigint, text string"), 5)
    left = leakage.without_leaks(docs, leaks)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["a b", "a b c d e"]


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaked_items(docs, items).count() == 0


def test_suffix_order():
    import numpy as np

    rng = np.random.default_rng(0)
    codes = rng.integers(0, 3, 300)
    order = leakage.suffix_ranks(codes, 64)
    assert [tuple(codes[i : i + 64]) for i in order] == sorted(tuple(codes[i : i + 64]) for i in range(300))


FIRST, LAST = ["Anna", "Bruno", "Carla", "Dieter", "Elsa", "Farid"], ["Kestermoor", "Bellhaven", "Drosswick", "Ortegrave"]


def personal_corpus(seed, n, held_out=False):
    """Invented texts with the types each one holds; held_out: in sentences that no other text has."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        first = rng.choice(FIRST)
        name = rng.choice([f"{first} {rng.choice(LAST)}", first])
        phone = rng.choice(["+44 7700 900{:03}", "(303) 555 0{:03}", "030 23125 {:03}"]).format(rng.randrange(1000))
        mail = f"{rng.choice([first, rng.choice(LAST)]).lower()}_{rng.randrange(99)}@{rng.choice(['post', 'mail', 'web'])}.example.net"
        ssn = f"SSN 9{rng.randrange(10)}{rng.randrange(10)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        known = [
            ("person_name", f"then {name} signed off the plan {rng.randrange(99)}"), ("person_name", f"keys were handed to {name}."), ("person_name", f"the box of {name} is here"),
            ("phone", f"please text {phone} after six"), ("phone", f"tel. {phone} for the plan"), ("id_number", f"the form shows {ssn}"), ("email", f"write to {mail} now"),
            ("street_address", f"lives at {rng.randrange(1, 99)} Alder Street, Ashmere"), (None, f"The {first} release of the box shipped as tag {rng.randrange(10**7, 10**8)}"),
            (None, f"Project {first} reuses the tool"), (None, f"Clone git@forge.example:vault/x-{rng.randrange(99)}.git first"), (None, f"Block {rng.randrange(100, 999)} 854 5057 of the chest is full"),
            (None, "The Copper Lane edition is stable"), (None, f"Part 447-76-{rng.randrange(1000, 9999)} fits the box"),
        ]
        new = [
            ("person_name", f"a bench was built by {name} in spring"), ("person_name", f"we owe {name} a coffee"), ("person_name", f"nobody saw {name} leave"),
            ("phone", f"the hotline {phone} rings twice"), ("id_number", f"his papers, {ssn}, were lost"), ("email", f"forwarded by {mail} at noon"),
            ("street_address", f"a crate waits in {rng.randrange(1, 99)} Birch Road"), (None, f"the {first} build broke at dawn"), (None, f"Barcode {rng.randrange(10**12, 10**13)} was scanned"),
        ]
        kind, text = rng.choice(new if held_out else known)
        out.append((text, kind))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return personal.fit_personal(spark.createDataFrame([(t,) for t, _ in personal_corpus(1, 1500)], "text string"))


def test_personal_information_on_held_out_texts(model):
    for held, least in ((personal_corpus(2, 600), 0.97), (personal_corpus(3, 600, held_out=True), 0.9)):
        right = [{k for _, _, k in model.decode(t)} == ({kind} if kind else set()) for t, kind in held]
        assert sum(right) / len(held) > least, [h for h, ok in zip(held, right) if not ok][:20]


def test_name_words_come_from_all_texts(spark):
    rng = random.Random(9)
    names = [f"{''.join(rng.choices('bdgklmnprstvz', k=2)).title()}{rng.choice('aiou')}{rng.choice('bdgkpt')} {rng.choice('AIOU')}{''.join(rng.choices('bdgkpt', k=3))}" for _ in range(40)]
    texts = [t for t, _ in personal_corpus(5, 600)] + [f"mail {n.split()[0].lower()}@{h}.example.org" for n in names for h in "ab"]
    texts += [f"keys were handed to {n}." for n in names for _ in range(3)]
    texts += ["The plain box is full. " * 120 + "keys were handed to Zarb Ukkt." for _ in range(2)] + ["zarb@a.example.org, zarb@b.example.org"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sample = {r.text for r in personal.sample_texts(df).collect()}
    assert sum(f"keys were handed to {n}." in sample for n in names) < 20  # few wordings are enough for the weights
    words, _ = personal.lexicon(df)
    assert {w for n in [*names, "Zarb Ukkt"] for w in n.lower().split()} <= set(words) and "release" not in words and "keys" not in words


def test_redaction(spark):
    corpus = [(i, t, "x") for i, (t, _) in enumerate(personal_corpus(3, 800))]
    corpus += [(9000, None, "x"), (9001, "", "x"), (9002, "call +44 7700 900123 after six; cc anna_1@post.example.net", "x"), (9003, "plain " * 3000, "x"), (9004, "call me", "x")]
    got = {r.i: r for r in personal.find_personal(spark.createDataFrame(corpus, "i int, text string, found string")).where("i >= 9000").collect()}
    assert got[9000].redacted is None and got[9001].redacted == "" and got[9003].redacted == "plain " * 3000
    assert got[9002].redacted == "call [PHONE] after six; cc [EMAIL]" and [f.type for f in got[9002].found] == ["phone", "email"]
    assert personal.find_personal(spark.createDataFrame([], "i int, text string")).count() == 0


def test_long_words_take_linear_time(model):
    import time

    began = time.time()
    for text in ("x" * 60_000, "1" * 60_000, "1 " * 30_000, "a.b+" * 15_000, "Ab " * 4_000):
        model.decode(text)
    assert time.time() - began < 30


def test_sentences():
    text = "---\ntitle: X\ndomain: Law\n---\n# Head\n\nOne here. Two here?\n- Three here!\n1. Four here.\n<p>Five here.</p><h1>Six</h1>\nuser: Seven here.\n\n   \nshort head"
    assert subjects.sentences(text) == ["One here.", "Two here?", "Three here!", "Four here.", "Five here.", "Seven here."]


def test_subject_model_reads_every_document(spark, monkeypatch):
    # bounds of this kind, if there are any, don't narrow what is counted
    for bound in ("SAMPLE_DOCS", "SAMPLE_LABELS"):
        monkeypatch.setattr(subjects, bound, 30, raising=False)
    rng = random.Random(3)
    words = {n: [n + x for x in "abcdefghijklmnop"] for n in ("north", "south")}
    docs = [(i, " ".join(rng.choices(words["north" if i % 2 else "south"], k=12)) + (" zanzibar." if i % 30 == 1 else "."), "north" if i % 2 else "south") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    subjects.ensure_checkpoint_dir(spark)
    model = subjects.fit_subjects(df.select("doc_id", "text"), df.select("doc_id", "subject"), ["north", "south"])
    assert "zanzibar" in model.index and {w for x in words.values() for w in x} <= set(model.index)


def test_subjects_on_held_out_labels(spark):
    rng = random.Random(8)
    topics = {"law": "court judge lease verdict clause witness notary appeal deed statute damages hearing".split(), "food": "bread oven dough butter yeast garlic broth stew pan spice marinade glaze".split(), "sport": "match coach league medal sprint relay goal team referee striker podium tournament".split()}

    def doc(names):
        sents = [f"The {rng.choice(topics[n])} and the {rng.choice(topics[n])} came up {rng.randrange(99)} times." for n in names for _ in range(5)]
        return " ".join(rng.sample(sents, len(sents)) + ["That is all for now."])

    truth = [tuple(rng.sample(list(topics), rng.choice([1, 1, 2]))) for _ in range(400)]
    docs = [(i, doc(t), "x") for i, t in enumerate(truth)] + [(900, None, "x"), (901, "", "x"), (902, "Nothing of note happened here today.", "x")]
    labels = [(i, t[0].title()) for i, t in enumerate(truth[:120])] + [(5, None), (6, "unknown")]
    found = subjects.assign_subjects(
        spark.createDataFrame(docs, "doc_id bigint, text string, subject string"), spark.createDataFrame(labels, "doc_id bigint, subject string"),
        spark.createDataFrame([(n, n) for n in topics], "subject string, label string"),
    ).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == set(t) for i, t in enumerate(truth) if i >= 120)
    assert right / 280 > 0.95 and not {900, 901, 902} & set(got)


def test_queries_run_on_the_smallest_tables(spark):
    from lodestrata.llm.registry import queries

    for name in ("p4_found", "p5_found", "p6_ids", "p7_found"):
        df = queries()[name](spark, "/root/testdata/sf0.001")
        assert df.count() > 0, name
    assert re.fullmatch(r"p8_found", [n for n in queries() if n.startswith("p8")][0])
