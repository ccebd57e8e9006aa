"""Periods, orphan references and packed values against brute force and hand-made cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from lodestrata.operators.intervals import merge_intervals, statement_periods
from lodestrata.operators.multivalue import segments, split_values
from lodestrata.operators.orphans import orphan_references

TRIPLE = "subject string, predicate string, valid_from string, valid_until string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def brute_periods(spans):
    out = []
    for a, b in sorted(x for x in spans if x[0] is not None and x[1] is not None and x[1] > x[0]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [("period", a, b) for a, b in out] + [("gap", x[1], y[0]) for x, y in zip(out, out[1:])]


@pytest.mark.parametrize("block", [10, 1000, 10**9])
def test_periods_equal_brute_force(spark, block):
    rng = random.Random(block)
    data = []
    for key in ("a", "b", None, "hot"):
        for _ in range(400 if key == "hot" else 30):
            a = rng.randrange(20_000 if key == "hot" else 2000)
            data.append((key, a, rng.choice([None, a, a - 5, a + rng.randrange(1, 60), a + 1])))
    df = spark.createDataFrame(data, "key string, a bigint, b bigint").withColumnRenamed("b", "block")
    got = merge_intervals(df, ["key"], "a", "block", block_us=block)
    expect = [(str(k), *x) for k in {d[0] for d in data} for x in brute_periods([d[1:] for d in data if d[0] == k])]
    assert sorted((str(r.key), r.kind, r.from_us, r.until_us) for r in got.collect()) == sorted(expect)


def test_statement_times(spark):
    data = [
        ("s", "p", "2025-01-01", "2025-01-02T00:00:00Z"),
        ("s", "p", "20250102T000000Z", "2025/01/03 00:00:00"),  # touches
        ("s", "p", "2025-01-05T02:00:00+02:00", None),
        ("s", "p", "2025-01-06", "9999-12-31"),
        ("s", "p", "2025-02-30", "2025-03-01"),  # no real day
        ("s", "p", "soon", None),
        ("s", "p", None, "2025-01-01"),
        ("s", "P", "2025-01-01 10:00:00.500", "2025-01-01T11:00"),
        ("s", "P", "2025-01-02", "2025-01-02"),
        ("s", "P", "2025-01-02", "tbd"),
    ]
    got = rows(statement_periods(spark.createDataFrame(data, TRIPLE)), "predicate", "kind", "from_ts", "until_ts")
    assert got == [
        ("P", "period", "2025-01-01 10:00:00", "2025-01-01 11:00:00"),
        ("p", "gap", "2025-01-03 00:00:00", "2025-01-05 00:00:00"),
        ("p", "period", "2025-01-01 00:00:00", "2025-01-03 00:00:00"),
        ("p", "period", "2025-01-05 00:00:00", ""),
    ]
    assert statement_periods(spark.createDataFrame([], TRIPLE)).count() == 0


REF, PARENT, GONE = "src string, src_key string, space string, ref_key string, created_at timestamp_ntz", "space string, ref_key string, created_at timestamp_ntz", "space string, ref_key string"


def brute_orphans(refs, parents, gone):
    known, out = {}, set()
    for s, k, at in parents:
        if k is not None:
            known.setdefault((s, k), []).append(at)
    for src, sk, s, k, at in refs:
        if k is None:
            continue
        month = at.strftime("%Y-%m") if at else ""
        if (s, k) not in known:
            out.add((src, sk, k, "deleted" if (s, k) in gone else "missing", month))
        elif at and None not in known[s, k] and min(known[s, k]) > at:
            out.add((src, sk, k, "late", month))
    return out


@pytest.mark.parametrize("per_range", [5, 10_000])
def test_orphans_equal_brute_force(spark, per_range):
    rng = random.Random(3)
    day = lambda: rng.choice([None, dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.randrange(4000))])
    key = lambda: rng.choice([None, "hot", *(f"k{i}" for i in range(60))])
    refs = [("e", str(i), rng.choice("nf"), key(), day()) for i in range(600)]
    refs += refs[:30]
    parents = [(rng.choice("nf"), key(), day()) for _ in range(60)]
    gone = {(rng.choice("nf"), f"k{i}") for i in range(0, 60, 4)}
    got = orphan_references(
        spark.createDataFrame([(*r, 1, "x") for r in refs], REF + ", salt int, reason string"), spark.createDataFrame(parents, PARENT), spark.createDataFrame(sorted(gone), GONE), keys_per_range=per_range
    )
    assert set(got.columns) == {"src", "src_key", "ref_id", "reason", "ref_month"}
    found = [tuple(r) for r in got.select("src", "src_key", "ref_id", "reason", "ref_month").collect()]
    assert len(found) == len(set(found)) and set(found) == brute_orphans(refs, parents, gone)


def test_blanks_around_keys_do_not_count(spark):
    from lodestrata.operators.orphans import store_references

    at = dt.datetime(2025, 3, 1)
    e = [(i, k, "wikilink", at) for i, k in enumerate(["n/a\n", "\tn/a", "\u00a0n/a \u2009", " \r\n", "n/b\n", "n/c c\u200b", None])]
    v = [("\nABCDEF0123456789\u00a0", at), ("abcdef0123456789\t", at)]
    refs = store_references(
        spark.createDataFrame(e, "id bigint, target_id string, kind string, created_at timestamp_ntz"), spark.createDataFrame(v, "fact_id string, created_at timestamp_ntz"),
        spark.createDataFrame([("x", '["ABCDEF0123456789"]', at)], "episode_id string, linked_fact_ids string, created_at timestamp_ntz"),
    )
    got = orphan_references(refs, spark.createDataFrame([("note", "n/a", None)], PARENT), spark.createDataFrame([("note", "n/c c")], GONE), n_keys=1)
    assert rows(got, "src", "src_key", "ref_id", "reason") == [
        ("episodes", "x", "abcdef0123456789", "missing"), ("fact_embeddings", "abcdef0123456789", "abcdef0123456789", "missing"), ("graph_edges", "4", "n/b", "missing"), ("graph_edges", "5", "n/c c", "deleted"),
    ]


def test_orphans_of_empty_tables(spark):
    empty = orphan_references(spark.createDataFrame([], REF), spark.createDataFrame([], PARENT), spark.createDataFrame([], GONE))
    assert empty.count() == 0


@pytest.mark.parametrize(
    "text, tags",
    [
        (None, []), ("", []), (" , ;", []), ("[]", []), ("a,b", ["a", "b"]), ('"a, b"; c', ["a, b", "c"]), ("'x; y',z", ["x; y", "z"]),
        ('"the ""cold"" tier"|q', ['the "cold" tier', "q"]), ('["a", "b \\"c\\""]', ["a", 'b "c"']), ("#a  #b-c", ["a", "b-c"]),
        ("- one\n- two", ["one", "two"]), ("owner's notes、x；y，z", ["owner's notes", "x", "y", "z"]), ("c#, c++ #d", ["c#", "c++", "d"]),
        ("a\r\nb\tc", ["a", "b", "c"]), ("a,a,,a", ["a", "a", "a"]), ("area/x:y z", ["area/x:y z"]), ('"open, a', ['"open', "a"]),
    ],
)
def test_segments(text, tags):
    assert segments(text, []) == tags


def test_known_values_protect_delimiters(spark):
    data = [(i, '"plan, do, check"') for i in range(3)] + [(9, "x;plan, do, check"), (10, "big|" * 2000), (11, None)]
    df = spark.createDataFrame(data, "k0 int, tag string")
    got = split_values(df, ["k0"], "tag")
    assert rows(got.where("k0 = 9"), "pos", "tag") == [(1, "x"), (2, "plan, do, check")]
    assert got.where("k0 = 10").count() == 2000
    # several blocks give the same as one
    assert rows(got, "k0", "pos", "tag") == rows(split_values(df, ["k0"], "tag", max_block_bytes=1), "k0", "pos", "tag")
    assert split_values(df.limit(0), ["k0"], "tag").count() == 0
