"""Token ids of a corpus by a public tokenizer, with content-defined chunk reuse.

A rolling hash over the characters cuts each text into chunks, so the same passage gives the same chunks in every
document. Documents are brought together by their representative, the smallest fingerprint among their chunks' ends:
those that share passages mostly have the same one and meet in one task, which encodes each of its chunks once. Only
the texts are shuffled, and only once; a representative that very many documents have is spread by Spark's
rebalancing, each part encoding its chunks once.

Of a chunk, its middle, between the first and the last place where the tokenizer always ends a piece, becomes token
ids; head and tail stay text. Each join (one chunk's tail and the next one's head) is re-encoded as it stands in the
text, which gives exactly the ids of the whole text. A chunk without such a place is a join as a whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the tokenizer's pattern of pieces for byte_bpe_50k.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Window of the rolling hash, mean and largest chunk, in characters.
WINDOW, MEAN_CHUNK, MAX_CHUNK = 16, 64, 2048
#: Encoded chunks, and joins, that a task keeps at most; when they are more, it begins anew.
KEPT = 200_000
#: Characters hashed at once.
_SPAN = 1_000_000
#: One blank between two non-blanks: every piece ends before it and a new one starts with it.
_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken rank file, kept per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_texts(texts: list[str]) -> Iterator[tuple[list[int], int]]:
    """Of each text, the ends of its content-defined chunks and its representative.

    A chunk ends where the hash of the last WINDOW characters falls on a multiple of the mean; a text without such a
    place is its own representative. The texts are hashed together, windows across their borders left out.
    """
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size >= _SPAN:
            yield from _cut_together(batch)
            batch, size = [], 0
    yield from _cut_together(batch)


def _cut_together(texts: list[str]) -> Iterator[tuple[list[int], int]]:
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    total = int(ends[-1]) if len(texts) else 0
    places, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if total > WINDOW:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = codes * np.uint64(0x9E3779B97F4A7C15)
        rolled = np.zeros(total - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0x100000001B3) + codes[k : total - WINDOW + 1 + k]
        begins = np.nonzero((rolled >> np.uint64(40)) % np.uint64(MEAN_CHUNK) == 0)[0]
        own = np.searchsorted(ends, begins, side="right")
        inside = begins + WINDOW <= ends[own]
        places, prints = begins[inside] + WINDOW, (rolled[begins[inside]] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    first = np.searchsorted(places, ends - [len(t) for t in texts], side="right") if texts else []
    last = np.searchsorted(places, ends, side="right") if texts else []
    for i, t in enumerate(texts):
        n, at = len(t), int(ends[i]) - len(t)
        bounds, done = [], 0
        for c in [*(places[first[i] : last[i]] - at).tolist(), n]:
            while c - done > MAX_CHUNK:
                done += MAX_CHUNK
                bounds.append(done)
            if c > done:
                bounds.append(c)
                done = c
        own = prints[first[i] : last[i]]
        yield bounds, int(own.min()) if len(own) else xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63


def chunk_bounds(text: str) -> list[int]:
    """Ends of one text's chunks."""
    return next(cut_texts([text]))[0]


def encode_chunk(enc, chunk: str) -> tuple[str, list[int] | None, str]:
    """Head text, ids of the middle, tail text; (chunk, None, '') if no place to cut is safe."""
    first = _SAFE.search(chunk)
    if not first:
        return chunk, None, ""
    a = b = first.start()
    # the last safe place: blanks from the end on
    at = chunk.rfind(" ", a + 1, len(chunk) - 1)
    while at > a:
        if _SAFE.match(chunk, at):
            b = at
            break
        at = chunk.rfind(" ", a + 1, at)
    return chunk[:a], enc.encode_ordinary(chunk[a:b]), chunk[b:]


def join_chunks(enc, parts: list[tuple[str, list[int] | None, str]], memo: dict) -> list[int]:
    """Ids of the whole text from its encoded chunks in order."""
    ids: list[int] = []
    open_text = ""
    for head, middle, tail in parts:
        open_text += head
        if middle is not None:
            joined = memo.get(open_text)
            if joined is None:
                joined = memo[open_text] = enc.encode_ordinary(open_text) if open_text else []
            ids.extend(joined)
            ids.extend(middle)
            open_text = tail
    return ids + enc.encode_ordinary(open_text)


def token_ids(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of the whole text, without special tokens; the empty list for an empty or null text.

    A row delivered again comes out once; one id with two texts gives two rows. Texts of any length are encoded
    whole. Strings of special tokens in a text are ordinary text. An empty table gives no rows; other columns are
    ignored.
    """
    path = path or default_path()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = list(cut_texts(pdf["text"].tolist()))
            yield pdf.assign(bounds=[b for b, _ in found], rep=np.array([r for _, r in found], np.int64))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, chunks, joins = encoder(path), {}, {}
        for pdf in batches:
            ids = []
            for text, bounds in zip(pdf["text"], pdf["bounds"]):
                parts, a = [], 0
                for b in bounds.tolist():
                    chunk = text[a:b]
                    done = chunks.get(chunk)
                    if done is None:
                        if len(chunks) >= KEPT:
                            chunks.clear()
                        done = chunks[chunk] = encode_chunk(enc, chunk)
                    parts.append(done)
                    a = b
                if len(joins) >= KEPT:
                    joins.clear()
                ids.append(join_chunks(enc, parts, joins))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in pdf["text"]], "ids": ids})

    placed = docs.where("length(text) > 0").mapInPandas(cut, f"doc_id {id_type}, text string, bounds array<int>, rep bigint").hint("rebalance", "rep")
    whole = placed.mapInPandas(encode, f"doc_id {id_type}, digest binary, ids array<int>")
    # ids that come once need no comparison of what was encoded
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        whole = whole.dropDuplicates(["doc_id", "digest"])
    blank = docs.where("text IS NULL OR length(text) = 0").select("doc_id").distinct()
    return whole.select("doc_id", "ids").unionByName(blank.select("doc_id", F.array().cast("array<int>").alias("ids")))
