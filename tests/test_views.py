"""Merging, personal-data spans, dictionaries, changed notes, filters, files: against brute force and by hand."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import notes as nt
from lodestrata.functions import privacy
from lodestrata.functions import text as tx
from lodestrata.operators import changes, dictionary, graph, retrieval, similar, vectors
from lodestrata.sources import sinks, vault


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"{i:03d}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(n)]
    return [*rows, ("x1", None), ("x2", ""), ("x3", "  "), ("x4", rows[0][1]), ("x5", rows[0][1].upper())]


def words_of(text):
    return set((text or "").lower().split())


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_most_similar_equals_brute_force(spark, threshold):
    new, old = texts(1, 60), [(f"o{i}", t) for i, t in texts(2, 80)] + [("o999", texts(1, 60)[3][1])]
    frame = lambda rows: spark.createDataFrame(rows, "id string, content string")
    got = {r.id: (r.match_id, r.score) for r in similar.most_similar(frame(new), frame(old), "id", F.col("content"), threshold).collect()}
    want = {}
    for i, t in new:
        a = words_of(t)
        scored = [(-round(len(a & b) / len(a | b), 6), j) for j, o in old if a and (b := words_of(o)) and len(a & b) / len(a | b) >= threshold - 1e-9]
        if scored:
            s, j = min(scored)
            want[i] = (j, -s)
    assert got == want and want


def test_merged(spark):
    long = "the hot cache was moved to the token broker on monday"
    old = spark.createDataFrame([("a", long), ("b", "other words here"), ("n", None)], "id string, content string")
    new = spark.createDataFrame(
        [("a", "same id, new words"), ("z", long.upper()), ("y", long + " noon"), ("q", "nothing like it"), ("e", ""), ("m", None), ("q", "nothing like it")], "id string, content string"
    )
    got = {r.id: (r.kept_id, r.how) for r in changes.merged(old, new).collect()}
    assert got == {"a": ("a", "update"), "z": ("a", "merge"), "y": ("a", "merge"), "q": ("q", "insert"), "e": ("e", "insert"), "m": ("m", "insert")}
    assert changes.merged(old.limit(0), new).where("how <> 'insert'").count() == 0
    assert changes.merged(old, new.limit(0)).count() == 0


PII = [
    "mail a.b@c.example and 0821234567", "key sk_abcdefghij0123456789ABCD or 10.1.2.3", "nothing", "", None, "password: hunter22 x", "x@y.example" * 2,
    "card 4111 1111 1111 1111 end", "8001015009087 and 8001015009087", "call +27821234567, +1 (555) 123-4567", "ünï ß a@b.example ø 192.168.0.1", "bitte +49 7700 900833 0821234567 anrufen",
]


def plain_spans(text):
    taken = []
    for kind, pattern, confidence in privacy.PERSONAL:
        for m in re.finditer(pattern, text or "", re.IGNORECASE | re.ASCII):
            if not any(s <= m.start() < e or s < m.end() <= e for _, s, e, _, _ in taken):
                taken.append((kind, m.start(), m.end(), m.group(0), confidence))
    return sorted(taken, key=lambda x: x[1])


def test_personal_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "i int, t string")
    got = {r.i: [tuple(x) for x in r.x] for r in df.select("i", privacy.personal_spans(F.col("t")).alias("x")).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(PII)}
    assert sum(map(len, got.values())) > 8


def test_modes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "i int, t string")
    by = {m: {r.i: r.x for r in df.select("i", privacy.checked(F.col("t"), m).alias("x")).collect()} for m in ("warn", "redact", "block")}
    assert by["redact"][0].text == "mail [REDACTED] and [REDACTED]" and by["warn"][0].text == PII[0]
    assert by["redact"][2].text == "nothing" and by["redact"][4].text is None and not by["redact"][4].has_pii
    assert by["block"][0].blocked and not by["block"][2].blocked and not by["warn"][0].blocked
    for i, t in enumerate(PII):
        kept = by["redact"][i].text or ""
        assert not any(m in kept for _, _, _, m, _ in plain_spans(t))
    with pytest.raises(ValueError):
        privacy.checked(F.col("t"), "hide")


def test_nearest_over_many_blocks_and_shards(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(61, 8)).round(3)
    m[40] = m[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    f32 = np.array([r[1] for r in rows[:61]], np.float32).astype(np.float64)
    u = f32 / np.linalg.norm(f32, axis=1, keepdims=True)
    got = {}
    for r in vectors.nearest(df.where("id % 5 = 0"), df, "id", "v", 4, block=3, shard=7).collect():
        got.setdefault(r.query, []).append((r.rank, r.id))
    for q in range(0, 61, 5):
        s = np.round(u @ u[q], 6)
        best = sorted((-s[i], i) for i in range(61) if i != q)[:4]
        assert sorted(got[q]) == [(n + 1, i) for n, (_, i) in enumerate(best)]
    assert len(got) == 13
    assert vectors.nearest(df.limit(0), df, "id", "v", 4).count() == 0
    assert vectors.nearest(df, df.limit(0), "id", "v", 4).count() == 0


def test_changed_notes(spark):
    df = spark.createDataFrame([("a x b x c",), ("one x only",), ("line\nmore",), ("",), (None,)], "t string")
    t = F.col("t")
    rows = df.select(
        nt.appended(t, "L", "x").alias("at"), nt.appended(t, "L").alias("end"), nt.patched(t, "x", "y").alias("once"), nt.patched(t, "x", "y", True).alias("every"),
        nt.first_patched(t, "x", "y").alias("first"), nt.first_patched(t, "line").alias("gone"), nt.occurrences(t, "x").alias("n"),
    ).collect()
    assert [r.at for r in rows] == ["a x\nL b x c", "one x\nL only", "line\nmore\nL", "\nL", None]
    assert [r.end for r in rows][:2] == ["a x b x c\nL", "one x only\nL"]
    assert [r.once for r in rows] == ["a x b x c", "one y only", "line\nmore", "", None]
    assert rows[0].every == "a y b y c" and rows[0].first == "a y b x c" and rows[2].gone == "more"
    assert [r.n for r in rows] == [2, 1, 0, 0, None]
    flags = spark.createDataFrame([("my Password here",), ("a path",), ("bee",), (None,)], "t string").select(nt.sensitive(F.col("t")).alias("x")).collect()
    assert [r.x for r in flags] == [True, True, False, False]


def test_dictionaries(spark):
    df = spark.createDataFrame([("Hot Cache",), ("hot cache ",), ("Hot Cache",), ("B",), ("b",), (None,), (" ",)], "name string")
    names = dictionary.canonical(df, "name")
    assert sorted(map(tuple, names.collect())) == [("b", "B", 2, 2), ("hot cache", "Hot Cache", 2, 3)]
    renamed = dictionary.renamed(spark.createDataFrame([("HOT CACHE", 1), ("unknown", 2), (None, 3)], "x string, n int"), "x", names)
    assert list(map(tuple, renamed.collect())) == [("Hot Cache", 1)]
    n = spark.createDataFrame([("1", "a.md", ["T", "alias"]), ("2", "b.md", ["T", None, ""]), ("3", "c.md", None)], "id string, path string, names array<string>")
    assert sorted(map(tuple, dictionary.names_of(n, "id", "path", F.col("names")).collect())) == [("T", "2", 2), ("alias", "1", 1)]
    assert dictionary.canonical(df.limit(0), "name").count() == 0


def test_shown_and_rendered(spark):
    df = spark.createDataFrame([("a", "D", 0.5, "Infra, cache"), ("b", "D", None, "infra"), ("c", "E", 0.9, None)], "id string, domain string, importance double, tags string")
    ids = lambda **f: sorted(r.id for r in df.where(graph.shown(**f)).collect())
    assert ids() == ["a", "b", "c"] and ids(domain="D") == ["a", "b"] and ids(least=0.5) == ["a", "c"] and ids(terms="INFRA,cache") == ["a"]
    lines = spark.createDataFrame([("k", "x" * 301, 0.125), ("k", None, 0.0)], "k string, c string, s double").select(retrieval.rendered(F.col("k"), F.col("c"), F.col("s")).alias("l")).collect()
    assert lines[0].l == "- [k] " + "x" * 300 + "... [score:0.13]" and lines[1].l == "- [k] "


def test_note_files_and_piles(spark, tmp_path):
    df = spark.createDataFrame([("Hot Cache", "Infra", ["a", "b"], "2026-01-01", "body"), ("Hot Cache", "Infra", None, "2026-01-02", "more")], "title string, domain string, tags array<string>, created string, body string")
    rows = sinks.note_paths(df, "domain", "title", "created").withColumn("text", sinks.note_text(F.col("title"), F.col("domain"), F.col("tags"), F.col("created"), F.col("body")))
    sinks.write_notes(rows.select("note_path", "text"), str(tmp_path / "notes"))
    back = {r.note_path: r.text for r in spark.read.json(str(tmp_path / "notes")).collect()}
    assert len(back) == 2 and all(t.startswith("---\ntitle: Hot Cache\ndomain: Infra\ntags: [") for t in back.values())
    assert any("tags: [a, b]" in t and t.endswith("# Hot Cache\n\nbody") for t in back.values())

    pile = tmp_path / "pile"
    pile.mkdir()
    (pile / "a.md").write_text("plain")
    (pile / "b.html").write_text("<script>no</script><p>yes</p>")
    (pile / "c.bin").write_text("left out")
    got = {r.path.rpartition("/")[2]: r.text for r in vault.read_pile(spark, str(pile)).collect()}
    assert set(got) == {"a.md", "b.html"} and got["a.md"] == "plain" and "yes" in got["b.html"] and "no" not in got["b.html"]


def test_runs_and_snapshots(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text("\n".join([json.dumps({"event": "run_summary", "ts": "2026-01-02T03:04:05Z", "total": 5, "parity_rate": 0.9}), json.dumps({"event": "step"}), "not json"]))
    runs = vault.read_runs(spark, str(tmp_path / "run.jsonl")).collect()
    assert [(r.total, r.parity_rate) for r in runs] == [(5, 0.9)] and runs[0]["at"] is not None
    (tmp_path / "snap.json").write_text(json.dumps([{"id": "1", "props": {"a": "x"}}, {"id": "2", "props": None}], indent=1))
    snap = vault.read_snapshot(spark, str(tmp_path / "snap.json"), "id string, props map<string, string>")
    assert sorted((r.id, r.props) for r in snap.collect()) == [("1", {"a": "x"}), ("2", None)]
    assert snap.select(tx.flattened(F.col("props")).alias("t")).where("t IS NOT NULL").count() >= 1


def test_turns_without_a_fresh_fact_repeat_two(spark, tmp_path):
    from lodestrata.plans.streams import stream_injected_turns

    rng = random.Random(4)
    rows = [(i, f"s{rng.randrange(2)}", f"f{rng.randrange(5)}", dt.datetime(2024 + i % 2, 1 + rng.randrange(12), 3)) for i in range(150)]
    spark.createDataFrame(rows, "id bigint, session_id string, fact_id string, ts timestamp_ntz").write.parquet(f"{tmp_path}/audit_log.parquet")
    want, repeated = [], 0
    for s in ("s0", "s1"):
        months, last = {}, {}
        for i, own, fact, at in sorted(rows):
            if own == s:
                months.setdefault((at.year, at.month), []).append(fact)
        for turn, m in enumerate(sorted(months), 1):
            given = list(dict.fromkeys(months[m]))
            fresh = [f for f in given if turn - last.get(f, -99) > 5]
            repeated += not fresh
            for f in fresh or sorted(given, key=last.get)[:2]:
                last[f] = turn
                want.append((s, f, turn))
    assert sorted(map(tuple, stream_injected_turns(spark, str(tmp_path)).collect())) == sorted(want) and repeated
