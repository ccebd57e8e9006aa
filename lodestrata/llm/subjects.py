"""Subject areas of documents by distributed latent Dirichlet topic models.

1. Topics of Spark's LDA (online variational Bayes) over all documents.
2. Each topic is mapped to subjects through its inspected top terms: how the labelled documents that hold a top term
   are spread over the subjects. Nothing else of the labels enters.
3. A term is topical if its topics are of few subjects; a sentence without topical terms is about nothing.
4. Every document is folded into the fitted topics in Arrow batches: its topic proportions, and under them the topics
   of each of its terms. A sentence belongs to the subject that its terms' topics are of, and the document's proportion
   of a subject is the share of its sentences there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.frames import frame
from lodestrata.session import ensure_checkpoint_dir

#: Documents that a term of the model occurs in at least.
MIN_DOCS = 5
#: Topics for each subject (its languages and facets get their own), passes over the documents, share of them in a step.
TOPICS_PER_SUBJECT, PASSES, BATCH_SHARE = 5, 3.0, 0.1
#: Topics whose top terms give no subject this share are fitted anew on their own terms, in so many rounds at most.
PURE, ROUNDS = 0.9, 4
#: Top terms that a topic is mapped by.
TOP_TERMS = 100
#: A term is a stop word if its surest subject is above an even share by less than this part of what that leaves.
EVEN = 0.16
#: A term is topical, and a sentence about a subject, if the subject has this share in it.
TOPICAL = 0.5
#: Steps of folding a document in, and the weight of a topic that nothing speaks for.
FOLDS, PRIOR = 8, 0.02
_FOLD_TOKENS = 40_000

_FRONTMATTER = r"(?s)^\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(\r?\n|$)"
_TERM = r"\p{L}[\p{L}\-]+"
_TERM_PY = re.compile(r"[^\W\d_][^\W\d_\-]*(?:-+[^\W\d_]+)*-*")
_HEAD_PY = re.compile(r"\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|$)", re.S)
_HEADING = re.compile(r"(?is)<h\d[^<>]*>.*?</h\d>")
_TAG = re.compile(r"<[^<>\n]{0,200}>")
_LINE = re.compile(r"[\r\n]+")
_HASHES = re.compile(r"\s*#{1,6}\s")
_SPLIT = re.compile(r"(?<=[.!?…。])[\s\"'”»)]+")
_MARKS = re.compile(r"(?:[-*•>]|\d{1,3}[.)]|user:|assistant:|system:)\s+", re.I)
_LETTER = re.compile(r"[^\W\d_]")


def terms(text: Column) -> Column:
    """Lower-case terms of the text, without frontmatter."""
    body = F.regexp_replace(text, _FRONTMATTER, "")
    return F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(body, r"<[^<>\n]{0,200}>", "\n")), F.lit(_TERM), 0), lambda w: F.length(w) > 2)


def sentences(text: str) -> list[str]:
    """Sentences of a text: no frontmatter, markup, headings or pieces without a word."""
    head = _HEAD_PY.match(text)
    if head:
        text = text[head.end() :]
    if "<" in text:
        text = _TAG.sub("\n", _HEADING.sub("\n", text))
    out = []
    for line in _LINE.split(text):
        if "#" in line and _HASHES.match(line):
            continue
        line = line.strip()
        mark = _MARKS.match(line)
        for piece in _SPLIT.split(line[mark.end() :] if mark else line):
            piece = piece.strip()
            # a heading is short and doesn't end like a sentence
            if piece and (piece[-1] in ".!?…。" or len(piece.split()) > 5) and _LETTER.search(piece):
                out.append(piece)
    return out


class SubjectModel:
    """Topics of the topical terms, and the subjects of the topics."""

    def __init__(self, names: list[str], vocabulary: list[str], weights: np.ndarray, to_subject: np.ndarray):
        """weights: (terms, topics), how much of each term each topic has taken. to_subject: see `topic_map`."""
        self.names = names
        of_topic = weights / np.maximum(weights.sum(1, keepdims=True), 1e-12)
        topical = (of_topic @ to_subject).max(1, initial=0.0) >= TOPICAL if len(names) and len(vocabulary) else np.zeros(len(vocabulary), bool)
        self.index = {w: i for i, w in enumerate(w for w, t in zip(vocabulary, topical) if t)}
        self.by_topic = (weights / np.maximum(weights.sum(0, keepdims=True), 1e-12))[topical].astype(np.float32)
        # a topic that took little of the documents needs more to be believed in
        self.prior = (PRIOR * weights.shape[1] * weights.sum(0) / max(weights.sum(), 1e-12)).astype(np.float32)
        self.to_subject = to_subject.astype(np.float32)

    def shares(self, texts: list[str]) -> Iterator[dict[str, float]]:
        """Of each text, the subjects with their shares of its sentences."""
        get, batch, size = self.index.get, [], 0
        for text in texts:
            found = [[i for w in _TERM_PY.findall(s.lower()) if (i := get(w)) is not None] for s in sentences(text)]
            batch.append(found)
            size += sum(map(len, found))
            if size >= _FOLD_TOKENS:
                yield from self._fold(batch)
                batch, size = [], 0
        yield from self._fold(batch)

    def _fold(self, batch: list[list[list[int]]]) -> Iterator[dict[str, float]]:
        """Topic proportions of the documents by expectation maximisation, then the subject of each sentence."""
        tokens = np.array([i for doc in batch for s in doc for i in s], np.int64)
        if not len(tokens):
            yield from ({} for _ in batch)
            return
        lengths = [(d, sum(map(len, doc))) for d, doc in enumerate(batch)]
        doc_of = np.repeat([d for d, n in lengths if n], [n for _, n in lengths if n])
        starts = np.concatenate([[0], np.nonzero(np.diff(doc_of))[0] + 1])
        own = np.cumsum(np.concatenate([[0], np.diff(doc_of) != 0]))
        given = self.by_topic[tokens]
        mass = given * self.prior
        mass /= np.maximum(mass.sum(1, keepdims=True), 1e-30)
        for _ in range(FOLDS):
            part = np.add.reduceat(mass, starts, axis=0) + self.prior
            mass = given * (part / part.sum(1, keepdims=True))[own]
            mass /= np.maximum(mass.sum(1, keepdims=True), 1e-30)
        of_token = mass @ self.to_subject
        counts = [len(s) for doc in batch for s in doc if s]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        of_sentence = np.add.reduceat(of_token, first, axis=0) / np.array(counts)[:, None]
        best = np.where(of_sentence.max(1) >= TOPICAL, of_sentence.argmax(1), -1).tolist()
        at = 0
        for doc in batch:
            hits: dict[str, float] = {}
            for s in doc:
                if s:
                    if best[at] >= 0:
                        name = self.names[best[at]]
                        hits[name] = hits.get(name, 0) + 1
                    at += 1
            yield {name: n / len(doc) for name, n in hits.items()}


def tidy(label: Column) -> Column:
    """One spelling of a subject's name."""
    return F.regexp_replace(F.lower(F.trim(label)), r"[^\p{L}\p{N}]+", "_")


def fit_subjects(documents: DataFrame, labels: DataFrame, names: list[str], seed: int = 11) -> SubjectModel:
    """documents: doc_id, text. labels: distinct doc_id, subject (one of `names`)."""
    k = TOPICS_PER_SUBJECT * len(names)
    corpus = documents.select(terms(F.col("text")).alias("terms")).checkpoint()
    if not names or corpus.isEmpty():
        return SubjectModel(names, [], np.zeros((0, 0)), np.zeros((0, 0)))
    counter = CountVectorizer(inputCol="terms", outputCol="features", minDF=float(MIN_DOCS), vocabSize=(1 << 31) - 1).fit(corpus)
    tied, sizes = label_ties(documents, labels, names, counter.vocabulary)
    kept = ~spread_evenly(tied, sizes)
    vocabulary, tied = [w for w, x in zip(counter.vocabulary, kept) if x], tied[kept]
    if not vocabulary:
        return SubjectModel(names, [], np.zeros((0, 0)), np.zeros((0, 0)))
    weights, to_subject = np.zeros((len(vocabulary), 0)), np.zeros((0, len(names)))
    part = np.arange(len(vocabulary))
    for n in range(1, ROUNDS + 1):
        vectors = CountVectorizerModel.from_vocabulary([vocabulary[i] for i in part], "terms", "features").transform(corpus).select("features").persist()
        lda = LDA(
            k=k, maxIter=max(1, round(PASSES / BATCH_SHARE)), subsamplingRate=BATCH_SHARE, optimizer="online", seed=seed + n,
            docConcentration=[0.2] * k, topicConcentration=0.01, learningOffset=32.0,
        ).fit(vectors)
        vectors.unpersist()
        taken = lda.topicsMatrix().toArray()
        shares = topic_map(taken, tied[part], sizes)
        # a topic that is no term's first took next to nothing
        used = np.bincount(taken.argmax(1), minlength=k) > 0
        mixed = used & (shares.sum(1) > 0) & (shares.max(1) < PURE) & (n < ROUNDS)
        kept = used & ~mixed
        wide = np.zeros((len(vocabulary), int(kept.sum())))
        wide[part] = taken[:, kept]
        weights, to_subject = np.hstack([weights, wide]), np.vstack([to_subject, shares[kept]])
        part = part[taken[:, mixed].sum(1) > 0.5 * taken.sum(1)]
        if len(part) < 2:
            break
    return SubjectModel(names, vocabulary, weights, to_subject)


def label_ties(documents: DataFrame, labels: DataFrame, names: list[str], vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled documents of each subject that hold each term, and labelled documents of each subject."""
    words = documents.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
    held = documents.join(labels, "doc_id").select("subject", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    counts = held.join(words, "term").groupBy("i", "subject").count().toPandas()
    sizes = labels.groupBy("subject").count().toPandas().set_index("subject")["count"].reindex(names).fillna(0).to_numpy(float)
    tied = np.zeros((len(vocabulary), len(names)))
    tied[counts["i"], counts["subject"].map(names.index)] = counts["count"]
    return tied, np.maximum(sizes, 1.0)


def spread_evenly(tied: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Terms that the labelled documents show to be no subject's more than another's: stop words of the model."""
    even = 1.0 / tied.shape[1]
    sure = np.maximum(tied - np.sqrt(tied), 0) / sizes
    share = sure.max(1) / np.maximum((tied / sizes).sum(1), 1e-12)
    return (share < even + EVEN * (1 - even)) & (tied.sum(1) >= 4)


def topic_map(weights: np.ndarray, tied: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(topics, subjects): the shares of the subjects among the top terms of each topic; all 0 if they tell none.

    The top terms are those that no other topic has taken more of. Each counts alike: a small language's terms in a
    large one's topic must show. A document has one label but may be about two subjects, so what a term's documents
    have of any subject up to twice an even share says nothing.
    """
    n = tied.shape[1]
    # as if every subject were labelled equally often; a term that few labelled documents hold tells little
    ties = (tied + 0.5 / n) / sizes
    ties /= ties.sum(1, keepdims=True)
    clear = np.maximum(ties - 2.0 / n, 0.0) if n > 3 else ties
    clear /= np.maximum(clear.sum(1, keepdims=True), 1e-12)
    owner = weights.argmax(1)
    out = np.zeros((weights.shape[1], n))
    for t in range(len(out)):
        own = np.nonzero(owner == t)[0]
        out[t] = clear[own[np.argsort(-weights[own, t], kind="stable")[:TOP_TERMS]]].sum(0)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12)


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share): the share of a document's sentences about each subject it touches.

    documents: doc_id, text; labels: doc_id, subject, in any spelling of a subject's name or label, null for none;
    subjects: subject, label. Labels that name no subject don't count. Null, empty and blank texts give no rows, as
    do empty tables; repeated rows of a document come out once. Other columns are ignored. The subjects' names are a
    short list and go through the driver.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    known = subjects.select("subject", F.explode(F.array(tidy(F.col("subject")), tidy(F.col("label")))).alias("name")).where("name IS NOT NULL").distinct()
    names = [r.subject for r in known.select("subject").distinct().orderBy("subject").collect()]
    named = labels.select("doc_id", tidy(F.col("subject")).alias("name")).join(F.broadcast(known), "name").select("doc_id", "subject").distinct()
    texts = documents.select("doc_id", "text").where("length(text) > 0")
    model = fit_subjects(texts, named, names)
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, subject string, share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, s, x) for d, found in zip(pdf["doc_id"], model.shares(pdf["text"].tolist())) for s, x in found.items()]
            yield frame(rows, schema)

    return texts.mapInPandas(run, schema)


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, min_share: float = 0.25) -> DataFrame:
    """(doc_id, subject) where at least `min_share` of the sentences are about the subject."""
    return subject_shares(documents, labels, subjects).where(F.col("share") >= min_share - 1e-9).select("doc_id", "subject").distinct()
