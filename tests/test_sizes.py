"""What is shuffled must not grow with the pairs of rows that meet."""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestrata.operators import graph, lexical, similar


def shuffled(spark, df):
    """The rows, and the bytes that were shuffled for them."""
    jsc = spark.sparkContext._jsc.sc()

    def written():
        jsc.listenerBus().waitUntilEmpty(30_000)
        return sum(jsc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(jsc.statusStore().executorList(False).size()))

    before = written()
    return df.collect(), written() - before


def test_bm25_batch_shuffles_no_pairs_of_query_and_document(spark):
    docs = [(f"d{i:04}", f"project {'red' if i % 7 else 'blue red'} {i} {'x ' * (i % 5)}") for i in range(800)]
    asked = [(q, f"Project Red {q * 3}") for q in range(500)] + [(900, "blue"), (901, "absent"), (902, ""), (902, "799 799"), (None, "5 6")]
    words = {d: t.split() for d, t in docs}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df, posts = defaultdict(int), defaultdict(list)
    for d, w in words.items():
        for t in set(w):
            df[t] += 1
            posts[t].append((d, w.count(t), len(w)))
    sets = defaultdict(set)
    for q, t in asked:
        sets[q] |= set(t.lower().split())
    expect = set()
    for q, terms in sets.items():
        scores = defaultdict(float)
        for t in terms:
            idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
            for d, tf, dl in posts[t]:
                scores[d] += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
        expect |= {(q, d, round(s, 6), i + 1) for i, (s, d) in enumerate(sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:3]) for s in [s]}
    found = lexical.bm25_batch(spark.createDataFrame(docs, "id string, t string"), "id", F.col("t"), spark.createDataFrame(asked, "q int, t string"), "q", F.col("t"), 3)
    rows, size = shuffled(spark, found)
    assert {tuple(r) for r in rows} == expect and len(rows) == len(expect)
    # 400,000 pairs
    assert size < 1_000_000


def test_near_duplicates_shuffle_no_pairs(spark):
    texts = [(f"r{i:04}", f"reminder {10_000 + i} the nightly export needs a stale review before sunday") for i in range(1500)]
    texts += [("s1", "reminder the nightly export needs a stale review before sunday"), ("s2", "reminder 10007 the nightly export needs a stale review before monday"), ("t", "something else")]
    rows, size = shuffled(spark, similar.near_duplicates(spark.createDataFrame(texts, "id string, t string"), "id", F.col("t")))
    got = {r.id: (r.class_id, r.links) for r in rows}
    sets = {i: frozenset(t.split()) for i, t in texts}
    for i in ("r0000", "r0007", "r0008", "s1", "s2", "t"):
        assert got[i] == (i, sum(len(sets[i] & o) / len(sets[i] | o) >= 0.8 - 1e-9 for j, o in sets.items() if j != i))
    assert got["r0000"][1] >= 1499 and len(rows) == len(texts)
    # 1,100,000 pairs
    assert size < 3_000_000


def test_shortest_paths_shuffle_the_graph_only(spark):
    n = 1200
    edges = spark.range(n).select(F.col("id").alias("s"), F.explode(F.array((F.col("id") * 7 + 1) % n, (F.col("id") * 11 + 3) % n, F.lit(0).cast("bigint"))).alias("t"))
    edges = edges.select(F.concat(F.lit("node "), "s").alias("s"), F.concat(F.lit("node "), "t").alias("t"))
    seeds = spark.range(300).select(F.concat(F.lit("node "), "id").alias("node")).unionByName(spark.createDataFrame([("far",)], "node string"))
    rows, size = shuffled(spark, graph.shortest_paths(seeds, graph.both_ways(edges, "s", "t"), 4))
    assert len(rows) == 300 * n + 1 and all(r.path[0] == r.seed and r.path[-1] == r.node and len(r.path) == r.hops + 1 for r in rows)
    assert [(r.node, r.hops, r.path) for r in rows if r.seed == "far"] == [("far", 0, ["far"])]
    # 360,000 rows
    assert size < 2_000_000


def test_shortest_paths_shuffle_no_copy_of_the_graph_for_each_block(spark):
    n = 1200
    edges = spark.range(n).select(F.col("id").alias("s"), F.explode(F.array((F.col("id") * 7 + 1) % n, F.lit(0).cast("bigint"))).alias("t"))
    found = graph.shortest_paths(spark.range(300).select(F.col("id").alias("node")), graph.both_ways(edges, "s", "t"), 2, block=4)
    rows, size = shuffled(spark, found)
    assert len({(r.seed, r.node) for r in rows}) == len(rows) == 300 * n
    # 75 blocks
    assert size < 50_000


def test_shortest_paths_in_batches_of_few_rows(tmp_path):
    near = [[1, 2], [0, 2, 3], [0, 1, 4], [1, 5], [2, 5], [3, 4], []]
    pq.write_table(pa.table({"rank": [i * 10 for i in range(7)], "node": list("abcdefg"), "to": [[j * 10 for j in x] or None for x in near]}), f"{tmp_path}/part.parquet")
    seeds = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64())], names=["rank"]) for x in ([0, 60], [], [30])]
    few, all_rows = ([b.to_pylist() for b in graph._walker(str(tmp_path), 4, k)(iter(seeds))] for k in (2, 100))
    assert max(map(len, few)) == 2 and sum(few, []) == sum(all_rows, []) and len(sum(few, [])) == 13
    assert {"seed": "a", "node": "f", "hops": 3, "path": list("abdf")} in sum(few, [])
