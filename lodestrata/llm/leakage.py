"""Evaluation texts leaking into a training corpus, found with suffix arrays over the corpus.

Each task cuts its share of the documents into shards of bounded size and sorts all word suffixes of a shard (prefix
doubling up to the length of the longest evaluation text, beyond which no match can reach). Every suffix of every
evaluation text is looked up by binary search; its neighbours in the order are its longest verbatim matches, and from
them the run of all places that share at least `min_words` words. The evaluation texts go to the tasks in blocks of
bounded size, each block being one more pass; they are never joined pairwise with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.frames import frame

_WORD = re.compile(r"[^\W_]+")
#: Words in one suffix array, and evaluation words passed to a task at once.
SHARD_WORDS, BLOCK_WORDS = 1_000_000, 200_000


def words(text: str) -> list[str]:
    """Runs of letters and digits of any script, letter case aside."""
    return _WORD.findall(text.upper().lower())


def suffix_ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of `codes` by its first `depth` symbols (prefix doubling; -1 is less than every code)."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and n:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else second[:0]
        pair = rank * (n + 1) + second + 1
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_pair[1:] != sorted_pair[:-1])])
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def _common(corpus: np.ndarray, at: int, probe: np.ndarray) -> int:
    part = corpus[at : at + len(probe)]
    differ = np.nonzero(part != probe[: len(part)])[0]
    return int(differ[0]) if len(differ) else len(part)


def longest_matches(corpus: np.ndarray, order: np.ndarray, probe: np.ndarray, min_words: int) -> Iterator[tuple[int, int]]:
    """(place, words in common) of all corpus suffixes that share at least `min_words` words with the probe."""
    low, high, target = 0, len(order), tuple(probe.tolist())
    width = len(probe)
    while low < high:
        mid = (low + high) // 2
        at = order[mid]
        if tuple(corpus[at : at + width].tolist()) < target:
            low = mid + 1
        else:
            high = mid
    for step, i in ((-1, low - 1), (1, low)):
        while 0 <= i < len(order):
            shared = _common(corpus, order[i], probe)
            if shared < min_words:
                break
            yield int(order[i]), shared
            i += step


class Probes:
    """Evaluation suffixes of one block, coded by their own vocabulary."""

    def __init__(self, items: list[tuple], min_words: int):
        self.items, self.min_words, self.vocabulary = [], min_words, {}
        for item_id, text in items:
            coded = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int64)
            if len(coded) >= min_words:
                self.items.append((item_id, coded))
        self.depth = max((len(c) for _, c in self.items), default=0)

    def search(self, shard: list[list[str]]) -> Iterator[tuple[int, object, int]]:
        """(index of the document, item, longest match in words) of one shard."""
        get, parts, owner = self.vocabulary.get, [], []
        for i, tokens in enumerate(shard):
            codes = np.array([get(w, -1) for w in tokens] + [-1], np.int64)
            # words no evaluation text has can't be part of a match: they only end one
            if np.count_nonzero(codes >= 0) >= self.min_words:
                parts.append(codes)
                owner.append(np.full(len(codes), i))
        if not parts or not self.items:
            return
        corpus, owner = np.concatenate(parts), np.concatenate(owner)
        # each border gets a code of its own, smaller than every word
        borders = np.nonzero(corpus < 0)[0]
        corpus[borders] = -1 - np.arange(len(borders))
        order = suffix_ranks(corpus, self.depth)
        # only suffixes with enough words before the next border can match
        nxt = np.append(borders, len(corpus))[np.searchsorted(borders, order)]
        order = order[nxt - order >= self.min_words]
        best: dict = {}
        for item_id, coded in self.items:
            for start in range(len(coded) - self.min_words + 1):
                for at, shared in longest_matches(corpus, order, coded[start:], self.min_words):
                    key = (int(owner[at]), item_id)
                    best[key] = max(best.get(key, 0), shared)
        for (i, item_id), shared in best.items():
            yield i, item_id, shared


def leaked_items(
    documents: DataFrame, items: DataFrame, min_words: int = 13, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, n_words): documents that share at least `min_words` words in a row with an item's text.

    documents: doc_id, text; items: item_id, text; n_words is the longest such run. Texts are compared whole, by
    words, letter case aside. Null and short texts match nothing; repeated rows come out once; empty tables give
    no rows; other columns are ignored.
    """
    docs = documents.select("doc_id", "text").where("length(text) > 0")
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int"

    def search(block: list[tuple]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            probes, ids, shard, size = Probes(block, min_words), [], [], 0

            def flush() -> pd.DataFrame:
                rows = [(ids[i], item, n) for i, item, n in probes.search(shard)]
                return frame(rows, schema)

            for pdf in batches:
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    ids.append(doc_id)
                    shard.append(words(text))
                    size += len(shard[-1])
                    if size >= shard_words:
                        yield flush()
                        ids, shard, size = [], [], 0
            if ids:
                yield flush()

        return run

    found, block, size = None, [], 0
    rows = items.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator()

    def one_pass(block: list[tuple]) -> None:
        nonlocal found
        part = docs.mapInPandas(search(block), schema)
        found = part if found is None else found.unionByName(part)

    for row in rows:
        block.append((row.item_id, row.text))
        size += len(row.text) // 4
        if size >= block_words:
            one_pass(block)
            block, size = [], 0
    if block or found is None:
        one_pass(block)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents, all their columns kept, without those that an item leaked into.

    leaks: `leaked_items`' rows. Documents with a null doc_id stay, as nothing is known to have leaked into them.
    """
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)
