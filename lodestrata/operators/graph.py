"""Links and statements as a graph: edges, neighbours, bounded search."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.text import wikilinks
from lodestrata.session import ensure_checkpoint_dir


def note_links(notes: DataFrame, text: str = "body_preview") -> DataFrame:
    """(source_id, target_id, weight): links of the notes' texts to the notes of that title, each counted.

    Of several notes with one title the last id wins; links to itself and to unknown titles are left out.
    """
    titles = notes.where("title IS NOT NULL").groupBy(F.trim("title").alias("title")).agg(F.max("note_id").alias("target_id"))
    links = notes.select(F.col("note_id").alias("source_id"), F.explode(wikilinks(F.col(text))).alias("title"))
    return (
        links.groupBy("source_id", "title")
        .agg(F.count(F.lit(1)).alias("weight"))
        .join(titles, "title")
        .where("source_id <> target_id")
        .groupBy("source_id", "target_id")
        .agg(F.sum("weight").alias("weight"))
    )


def dead_links(notes: DataFrame, text: str = "body_preview") -> DataFrame:
    """(note_id, link): links that name neither a title nor an id."""
    names = notes.select(F.explode(F.array("title", "note_id")).alias("link")).where("link IS NOT NULL").distinct()
    links = notes.select("note_id", F.explode(wikilinks(F.col(text))).alias("link")).distinct()
    return links.join(names, "link", "left_anti").select("note_id", "link")


def both_ways(edges: DataFrame, source: str, target: str, *extra: str) -> DataFrame:
    """(node, other, extra...) of each edge in both directions."""
    there = edges.select(F.col(source).alias("node"), F.col(target).alias("other"), *extra)
    return there.unionByName(edges.select(F.col(target).alias("node"), F.col(source).alias("other"), *extra))


def strongest(edges: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first `k` edges of each node."""
    return edges.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def reached(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hops): nodes within `hops` undirected steps of each seed, with the least number of steps.

    seeds: node. edges: node, other, in both directions. One join for each step, on the frontier only.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    # each step starts from what the last one wrote: the plan doesn't grow with the steps
    pairs = edges.select("node", "other").where("node IS NOT NULL AND other IS NOT NULL AND node <> other").distinct().checkpoint()
    front = seeds.select(F.col("node").alias("seed"), "node").distinct()
    seen = front.withColumn("hops", F.lit(0))
    for step in range(1, hops + 1):
        front = (
            front.join(pairs, "node")
            .select("seed", F.col("other").alias("node"))
            .distinct()
            .join(seen, ["seed", "node"], "left_anti")
            .checkpoint()
        )
        seen = seen.unionByName(front.withColumn("hops", F.lit(step)))
    return seen


def directed_neighbours(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(seed, node, way): neighbours of each seed, `outgoing` or `incoming`; one linked both ways is outgoing.

    seeds: node. links: source_id, target_id. Links of a note to itself and nulls don't count.
    """
    pairs = links.where("source_id <> target_id").select("source_id", "target_id").distinct()
    start = seeds.select(F.col("node").alias("seed")).distinct()
    out = pairs.join(start, F.col("source_id") == F.col("seed")).select("seed", F.col("target_id").alias("node"), F.lit("outgoing").alias("way"))
    back = pairs.join(start, F.col("target_id") == F.col("seed")).select("seed", F.col("source_id").alias("node"), F.lit("incoming").alias("way"))
    return out.unionByName(back).groupBy("seed", "node").agg(F.max("way").alias("way"))


def shortest_paths(seeds: DataFrame, edges: DataFrame, most: int = 4, block: int = 64) -> DataFrame:
    """(seed, node, hops, path): one shortest path to each node within `most` steps, the smallest by node order.

    seeds: node. edges: node, other. Nodes are numbered in their order and the graph is written once, as numbers, to the
    checkpoint folder. The seeds are cut into blocks; each block has a task of its own that reads the whole graph there
    and takes `most` steps from one seed after the other. Only seeds' numbers are shuffled to the tasks: what is shuffled
    and written grows with the graph, not with seeds times nodes.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    pairs = edges.select("node", "other").where("node IS NOT NULL AND other IS NOT NULL AND node <> other").distinct().checkpoint()
    ends = pairs.select(F.explode(F.array("node", "other")).alias("node"), F.lit(False).alias("asks"))
    starts = seeds.select("node", F.lit(True).alias("asks"))
    # numbers that grow with the sorted nodes; they must stay, hence the checkpoint
    nodes = ends.unionByName(starts).groupBy("node").agg(F.max("asks").alias("asks")).orderBy("node").select(F.monotonically_increasing_id().alias("rank"), "node", "asks").checkpoint()
    others = nodes.select(F.col("node").alias("other"), F.col("rank").alias("to"))
    links = pairs.join(nodes, "node").join(others, "other").groupBy("rank").agg(F.sort_array(F.collect_list("to")).alias("to"))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graph-{uuid.uuid4().hex}"
    nodes.join(links, "rank", "left").select("rank", "node", "to").write.parquet(folder)
    asked = nodes.where("asks").select("rank")
    blocks = -(-asked.count() // block) or 1
    kind = nodes.schema["node"].dataType.simpleString()
    mine = asked.repartitionById(blocks, F.pmod(F.xxhash64("rank"), F.lit(blocks)).cast("int"))
    return mine.mapInArrow(_walker(folder, most), f"seed {kind}, node {kind}, hops int, path array<{kind}>")


def _walker(folder: str, most: int, rows: int = 1 << 16) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The paths from all seeds of a block, in batches of at most so many rows."""
        asked = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not asked:
            return
        files, at_path = fs.FileSystem.from_uri(folder)
        t = ds.dataset(at_path, filesystem=files, format="parquet").to_table().combine_chunks().sort_by("rank")
        rank, names = t["rank"].to_numpy(), t["node"].combine_chunks()
        to = t["to"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(to), 0).to_numpy()
        first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        near = np.searchsorted(rank, to.flatten().to_numpy())
        seen, at = np.zeros(len(rank), bool), np.zeros(len(rank), np.int64)
        for seed in np.searchsorted(rank, np.concatenate(asked)):
            seen[:] = False
            seen[seed] = True
            front, paths = np.array([seed]), np.array([[seed]])
            for step in range(most + 1):
                for i in range(0, len(paths), rows):
                    part = paths[i : i + rows]
                    path = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, step + 1, dtype=np.int32)), names.take(pa.array(part.ravel())))
                    own, last = (names.take(pa.array(part[:, k])) for k in (0, -1))
                    yield pa.RecordBatch.from_arrays([own, last, pa.array(np.full(len(part), step, np.int32)), path], names=["seed", "node", "hops", "path"])
                if step == most:
                    break
                n = sizes[front]
                links = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
                there, by = near[links], np.repeat(np.arange(len(front)), n)
                fresh = ~seen[there]
                there, by = there[fresh], by[fresh]
                # front and links are in order, so the first way to a node is the smallest path: of equal indexes the last assignment stays
                i = np.arange(len(there))
                at[there[::-1]] = i[::-1]
                found = at[there] == i
                front, by = there[found], by[found]
                if not len(front):
                    break
                seen[front] = True
                paths = np.column_stack([paths[by], front])

    return walk


def induced(nodes: DataFrame, edges: DataFrame, id_col: str = "note_id") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col(id_col).alias("_id")).distinct()
    return edges.join(ids, edges["source_id"] == ids["_id"], "left_semi").join(ids, edges["target_id"] == ids["_id"], "left_semi")


def shown(domain: str | None = None, least: float | None = None, terms: str = "") -> Column:
    """A viewer's filter of nodes (domain, importance, tags as one text): what isn't given doesn't filter.

    All terms, parted by blanks or commas, must stand in the tags, letter case aside. A missing importance is 0.
    """
    tags = F.lower(F.coalesce("tags", F.lit("")))
    wanted = [F.contains(tags, F.lit(t)) for t in terms.lower().replace(",", " ").split()]
    return all_of(F.col("domain") == domain if domain else None, F.coalesce("importance", F.lit(0.0)) >= least if least else None, *wanted)


def active(until: Column) -> Column:
    """Whether a statement has no end."""
    return until.isNull() | (until == "")


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))
