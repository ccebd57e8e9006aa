"""Personal information in free text: find it and replace it with typed placeholders.

A semi-Markov conditional random field. Candidate segments of bounded length get a score from features of the whole
span (its shape, its words, the words around it); a segment outside any entity scores 0 for each token. Dynamic
programming over the tokens chooses boundaries and types jointly.

There are no labels, so the field learns from what form and the data's own dictionary show, never from set phrases.
Name words are counted over all texts on Spark: words of e-mail addresses that texts write with a capital, and words
that mostly stand beside these. Two of them in a row, or one behind a title or an initial, are a person's name; one
beside the word project, release, build or edition is none; a number with a country code or area code in brackets, or
behind a label such as "tel", is a phone number; a number behind the name of an identity number is one. Single name
words, of which form tells nothing, are left open: the field labels them itself, by what it learnt of the words
around the others, and learns once more. Fitting runs in the tasks, on shards of a bounded sample whose weights are
averaged.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
#: Rows of the sample the weights are fitted on, passes over it, the most examples of one wording, and the shards that
#: are fitted apart. PER_WORDING keeps a frequent wording from outweighing the others; it bounds the fitting only, no
#: text is left out of the name words.
SAMPLE_ROWS, EPOCHS, PER_WORDING, SHARDS = 40_000, 4, 8, 4

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_EMAIL = re.compile(
    r"(?<![\w.+\-])[\w.+\-]*\w(?:@|\s?[\[(](?:at|a)[\])]\s?|\sat\s)\w[\w\-]*(?:(?:\.|\s?[\[(](?:dot|punkt|point)[\])]\s?|\sdot\s)\w[\w\-]*)+",
    re.I,
)
_AT = re.compile(r"@|[\[(](?:at|a)[\])]|\sat\s", re.I)
_NUMBER = re.compile(r"(?<![\w@])(?:\(?\+|\()?\d[\d().\-‑/   ]{4,}\d(?:\s*(?:ext|x)\.?\s*\d+)?|(?<!\w)pn[ \-]?\d{3}[ \-]?\d{2}[ \-]?\d{4}(?!\w)|(?<![\w@])\d{6,15}(?:\s*(?:ext|x)\.?\s*\d+)?", re.I)
_WAY = (
    r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|crescent|court|ct|place|terrace|square|boulevard|blvd|way)\b\.?"
)
_NAMED = r"[^\W\d_]+(?:[ \-][^\W\d_]+)?"
_PLACE = r"(?:,\s*(?:\d{4,5}\s+)?[A-ZÀ-Þ][^\W\d_]+(?:\s+\d{4,5})?(?!\w))?"
_STREET = re.compile(
    rf"(?:(?:flat|unit|apt\.?|apartment|suite)\s+\d+\w?(?:/|,\s*|\s+))?\d{{1,4}}\s?[a-z]?\s+{_NAMED}\s+{_WAY}(?-i:{_PLACE})"
    rf"|\d{{1,4}}\s?[a-z]?,?\s+(?:rue|avenue|boulevard|place|chemin)\s+(?:des?|du|la|le|l['’])?\s*{_NAMED}(?-i:{_PLACE})"
    rf"|(?:calle|avenida|plaza|paseo)\s+{_NAMED},?\s+\d{{1,4}}[a-z]?(?-i:{_PLACE})"
    rf"|(?<![^\W\d_])[^\W\d_]+(?:straße|strasse|weg|platz|allee|gasse)\s+\d{{1,4}}\s?[a-z]?(?!\w)(?-i:{_PLACE})",
    re.I,
)
_PARTICLES = {"van", "von", "de", "der", "den", "di", "da", "la", "el", "bin", "al"}
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "m", "sr", "sra", "señor", "señora", "monsieur", "madame"}
_LABEL = {
    "phone": re.compile(r"(?:\b(?:tel|telefon|teléfono|téléphone|phone|telephone|mobile|cell|fax|call)\b[.:=\s]*)(?:tel:)?\(?$", re.I),
    "id_number": re.compile(r"(?:\b(?:ssn|social security(?: n(?:o|umber))?|steuer-?id|tax(?:payer)? id|id(?: no| number)?|identity(?: number| no)?|personal number|citizen n(?:o|umber)|national (?:id|number)|passport(?: no| number)?|nino|dni|nif)\b[.:=#\s]*)$", re.I),
}
#: A country code, or an area code in brackets: the form of a phone number whatever stands before it.
_DIALLED = re.compile(r"\(?\+|00\d|\(\d{2,4}\)\s?\d|[\d ]+ext\b", re.I)
#: What is numbered without being a phone or a person: by TESTDATA.md parts, barcodes, trace marks, jobs, and the like.
_NUMBERED = {"part", "barcode", "trace", "mark", "job", "batch", "order", "ref", "reference", "entry", "card", "ticket", "tag", "note", "number", "code", "serial", "version", "plan", "block", "rate"}
#: What is named after people without being one, by TESTDATA.md: projects, releases, builds, editions.
_ARTEFACTS = {"project", "projects", "release", "releases", "build", "builds", "edition", "editions", "projekt", "ausgabe", "projet", "édition", "proyecto", "edición", "version", "versión"}
#: From how many places on a word, or an ending of long words, is known.
KNOWN_WORD, KNOWN_ENDING = 2, 3
#: What an open name word adds to a segment's score when the field labels it.
OPEN_BONUS = 12.0
_GROUPED, _QUAD = re.compile(r"\d[ ().\-/]+\d|\d\s*(?:ext|x)", re.I), re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")
_WORD = re.compile(r"[^\W\d_]{3,}")


class Text:
    """Tokens of one text and its candidate segments: (first token, token after the last, type, features)."""

    def __init__(self, text: str, model: Model | None):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.lower = [w.lower() for w in self.words]
        starts = {a: i for i, (a, _) in enumerate(self.spans)}
        ends = {b: i + 1 for i, (_, b) in enumerate(self.spans)}
        self.found: list[tuple[int, int, str]] = []
        digits = any(c.isdigit() for c in text)
        for kinds, pattern in ((("email",), _EMAIL), (("phone", "id_number"), _NUMBER), (("street_address",), _STREET)):
            if not (digits if pattern is not _EMAIL else _AT.search(text)):
                continue
            for m in pattern.finditer(text):
                i, j = starts.get(m.start()), ends.get(m.end())
                if i is not None and j is not None:
                    self.found += [(i, j, k) for k in kinds]
                    if kinds == ("street_address",):  # the same without the place behind it
                        self.found += [(i, c, kinds[0]) for c in range(i + 2, j) if self.words[c] == "," and c + 1 < j and self.words[c + 1][0].isupper()]
        self.found += [(i, j, "person_name") for i, j in self.names(model)]

    def names(self, model: Model | None) -> Iterator[tuple[int, int]]:
        """Runs of up to four name words, with initials, titles, particles and the order 'Last, First'."""
        n, words, lower = len(self.words), self.words, self.lower
        able = [w[0].isupper() or (w[0].isalpha() and (model is None or model.knows(low))) for w, low in zip(words, lower)]
        for i in range(n):
            # a name begins with a word that has a capital or is known, a title or a particle, and ends with one of the first
            if not (able[i] or lower[i] in _TITLES or lower[i] in _PARTICLES) or (i and words[i - 1] in "@+_/" and self.spans[i - 1][1] == self.spans[i][0]):
                continue
            j, count, capitals, comma, likely = i, 0, 0, False, model is None
            while j < n and count < 4:
                w = words[j]
                if w[0].isalpha():
                    count += 1
                    capitals += w[0].isupper()
                    # a known word, a title, an initial, or two words with a capital
                    likely = likely or capitals > 1 or model.knows(lower[j]) or (len(w) == 1 and w.isupper()) or lower[j] in _TITLES
                    j += 1
                    if j < n and words[j] == "." and (len(w) == 1 or lower[j - 1] in _TITLES):
                        j += 1
                    if likely and (words[j - 1] == "." or able[j - 1]) and lower[j - 1] not in _PARTICLES and not (j < n and words[j] in "@" and self.spans[j][0] == self.spans[j - 1][1]):
                        yield i, j
                elif w == "," and not comma and count:
                    comma = True
                    j += 1
                elif w in "-‑" and count and j + 1 < n and words[j + 1][0].isalpha() and self.spans[j][0] == self.spans[j - 1][1] and self.spans[j + 1][0] == self.spans[j][1]:
                    j += 1
                else:
                    break

    def word(self, i: int) -> str:
        return ("9" * min(len(self.words[i]), 9) if self.words[i].isdigit() else self.lower[i]) if 0 <= i < len(self.words) else "^"

    def features(self, i: int, j: int, kind: str, model: Model | None) -> list[str]:
        left, right, left2 = self.word(i - 1), self.word(j), self.word(i - 2)
        if left in ":=.\"'(<[" and i > 1:
            left, left2 = self.word(i - 2) + left, self.word(i - 3)
        if right in "'’" and j < len(self.words):
            right += self.word(j + 1)
        f = [f"{kind}|l={left}", f"{kind}|r={right}", f"{kind}|ll={left2} {left}", f"{kind}|rr={right} {self.word(j + 1)}", kind]
        inner = self.text[self.spans[i][0] : self.spans[j - 1][1]]
        if kind == "person_name":
            flags = []
            for k in range(i, j):
                w = self.words[k]
                if not w[0].isalpha():
                    flags.append(w)
                    continue
                case = "T" if w.istitle() else "U" if w.isupper() and len(w) > 1 else "i" if w.isupper() else "l"
                if self.lower[k] in _TITLES:
                    flags.append("t" + case)
                elif self.lower[k] in _PARTICLES:
                    flags.append("p")
                else:
                    known = "?" if model is None else model.level(self.lower[k])
                    flags.append(case + known)
                    f += [f"n|w={self.lower[k]}", f"n|s={self.lower[k][-4:]}"]
            f += [f"n|shape={' '.join(flags)}", f"n|first={flags[0]}", f"n|last={flags[-1]}", f"n|len={j - i}", f"n|edge={left in _TITLES}"]
            f.append(f"n|l3={self.word(i - 3)} {left2} {left}")
            f.append(f"n|made={any(self.word(k) in _ARTEFACTS for k in (i - 2, i - 1, j, j + 1))}")
            before = self.lower[i - 1] if i else "^"
            if model is not None and (model.level(before) == "3" or self.word(j) != "^" and model.level(self.word(j)) == "3"):
                f.append("n|cut")
        else:
            shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: str(len(m[0])), inner))
            near = self.text[self.spans[j - 1][1] : self.spans[j - 1][1] + 2]
            digits = sum(c.isdigit() for c in inner)
            f += [f"{kind}|shape={shape}", f"{kind}|d={digits}", f"{kind}|head={inner[:2]}", f"{kind}|lshape={left}~{shape}"]
            if kind == "email":
                f += [f"email|local={re.split('[@ ]', inner.lower())[0]}", f"email|path={bool(re.match(':[^ ]', near))}"]
            back = self.text[max(0, self.spans[i][0] - 40) : self.spans[i][0]]
            f.append(f"{kind}|intro={_LABEL[kind].search(back) is not None}" if kind in _LABEL else f"{kind}|any")
            if kind == "phone":
                f.append(f"phone|dialled={_DIALLED.match(inner) is not None}")
        return f


class Model:
    """Weights of the field, and how often each name word occurs in all texts."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.name_words: dict[str, int] = {}
        self.endings: dict[str, int] = {}

    def knows(self, word: str) -> bool:
        return self.level(word) != "0"

    def level(self, word: str) -> str:
        return "3" if self.name_words.get(word, 0) >= KNOWN_WORD else "2" if len(word) > 5 and self.endings.get(word[-3:], 0) >= KNOWN_ENDING else "0"

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def decode(self, text: str, memo: dict | None = None) -> list[tuple[int, int, str]]:
        """(start, end, type) of the best segmentation of the text."""
        t = Text(text, self)
        n = len(t.words)
        scored = []
        for i, j, kind in t.found:
            key = None
            if memo is not None and kind == "person_name":
                key = (t.words[max(0, i - 7) : i], t.words[i:j], t.words[j : j + 3])
                key = str(key)
                s = memo.get(key)
            else:
                s = None
            if s is None:
                s = self.score(t.features(i, j, kind, self))
                if key is not None:
                    memo[key] = s
            scored.append((i, j, kind, s))
        return [(t.spans[i][0], t.spans[j - 1][1], kind) for i, j, kind in best_segments(n, scored)]


def best_segments(n: int, scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The best choice of segments that don't overlap; a token outside any scores 0."""
    by_end: dict[int, list] = defaultdict(list)
    for i, j, kind, s in scored:
        if s > 0:
            by_end[j].append((i, kind, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, s in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def shown(t: Text, model: Model) -> tuple[set[tuple[int, int, str]], set[int]]:
    """(entities, open): the segments that form and dictionary show to be entities, and tokens left open: single name
    words, and numbers in groups that nothing tells from phone numbers."""
    gold, taken = set(), [False] * (len(t.words) + 1)
    text = t.text
    for i, j, kind in sorted(t.found, key=lambda x: x[0] - x[1]):
        if kind == "person_name":
            continue
        a, b = t.spans[i][0], t.spans[j - 1][1]
        before, after = text[max(0, a - 40) : a], text[b : b + 2]
        sure = {
            "email": not re.match(r":\S", after), "street_address": True,
            "id_number": _LABEL["id_number"].search(before), "phone": (_LABEL["phone"].search(before) or _DIALLED.match(text[a:b])) and not _LABEL["id_number"].search(before),
        }[kind]
        if sure and not any(taken[i:j]):
            taken[i:j] = [True] * (j - i)
            gold.add((i, j, kind))
    is_name = [w[0].isalpha() and len(w) > 2 and model.level(low) != "0" and low not in _ARTEFACTS for w, low in zip(t.words, t.lower)]
    runs: dict[int, tuple[int, int]] = {}
    for i, j, kind in t.found:
        if kind != "person_name" or any(taken[i:j]) or (i and is_name[i - 1] and text[t.spans[i - 1][1] : t.spans[i][0]] == " "):
            continue
        inner = range(i, j)
        helped = all(is_name[k] or t.lower[k] in _PARTICLES or t.lower[k] in _TITLES or t.words[k] in ".,-‑" or (len(t.words[k]) == 1 and t.words[k].isupper()) for k in inner)
        near = all(text[t.spans[k][1] : t.spans[k + 1][0]] in ("", " ") for k in range(i, j - 1))
        if "," in t.words[i:j]:  # Last, First: both known by themselves, with nothing else
            at = t.words.index(",", i)
            helped = helped and at == i + 1 and j == at + 2 and model.level(t.lower[i]) == model.level(t.lower[j - 1]) == "3"
        parts = sum(is_name[k] or t.lower[k] in _TITLES or (len(t.words[k]) == 1 and t.words[k].isupper()) for k in inner)
        headed = t.lower[i] in _TITLES and len(t.words[i]) > 1 or len(t.words[i]) == 1 and t.words[i].isupper() and j - i > 2
        strong = headed or any(is_name[k] and model.level(t.lower[k]) == "3" for k in inner)
        if helped and near and parts >= 2 and strong and t.lower[j - 1] not in _PARTICLES and (is_name[j - 1] or t.words[j - 1] == "."):
            if i not in runs or j - i > runs[i][1] - runs[i][0]:
                runs[i] = (i, j)
    for i, j in sorted(runs.values(), key=lambda x: x[0] - x[1]):
        if not any(taken[i:j]):
            taken[i:j] = [True] * (j - i)
            gold.add((i, j, "person_name"))
    beside = lambda k: any(0 <= x < len(t.words) and t.lower[x] in _ARTEFACTS for x in (k - 2, k - 1, k + 1))
    left = {k for k, n in enumerate(is_name) if n and not taken[k] and model.level(t.lower[k]) == "3" and not beside(k)}
    for i, j, kind in t.found:
        inner = text[t.spans[i][0] : t.spans[j - 1][1]]
        if kind == "phone" and not any(taken[i:j]) and (_GROUPED.search(inner) or 9 <= len(inner) <= 11) and not _QUAD.fullmatch(inner) and not _NUMBERED & set(t.lower[max(0, i - 3) : i]):
            left.add(i)
    return gold, left


def plain(word: str) -> str:
    """A lower-case word as an e-mail address spells it: without accents."""
    return word if word.isascii() else unicodedata.normalize("NFKD", word.replace("ø", "o").replace("ł", "l").replace("ß", "ss")).encode("ascii", "ignore").decode()


def address_words(texts: DataFrame) -> DataFrame:
    """(word): words of the local parts of e-mail addresses at two hosts or more, over all texts.

    A person's name turns up at several hosts, a machine's account at one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {(w, m[0].lower().rpartition("@")[2]) for text in pdf["text"] if "@" in text for m in _EMAIL.finditer(text) if "@" in m[0] for w in _WORD.findall(m[0].lower().partition("@")[0])}
            yield pd.DataFrame(sorted(found), columns=["word", "host"], dtype=object)

    hosts = texts.mapInPandas(run, "word string, host string").groupBy("word").agg(F.min("host").alias("a"), F.max("host").alias("b"))
    return hosts.where("a < b").select("word")


def lexicon(records: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Name words and endings that count as known, each with its number, over all texts of any length.

    A word is known if it is mostly written with a capital within sentences and is part of an e-mail address, or
    mostly stands beside a capitalised word of one. Only these and their counts leave the tasks.
    """
    texts = records.where("text IS NOT NULL").select("text")
    mails = {r.word for r in address_words(texts).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text in pdf["text"]:
                words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
                for k, (w, a, b) in enumerate(words):
                    low = w.lower()
                    counts = seen.setdefault(low, [0, 0, 0, 0])
                    if a and text[a - 1] in "@.+-_/" or text[b : b + 1] in ("@", "_", "/"):
                        continue
                    counts[0] += 1
                    # within a sentence: a capital at its start says nothing
                    if a > 1 and text[a - 1] == " " and text[a - 2] not in ".!?:;|>-–—":
                        counts[3] += 1
                        counts[1] += w.istitle()
                    after = words[k + 1] if k + 1 < len(words) and text[b : words[k + 1][1]] == " " else None
                    before = words[k - 1] if k and text[words[k - 1][2] : a] == " " else None
                    beside = any(x and x[0].istitle() and plain(x[0].lower()) in mails for x in (after, before))
                    counts[2] += w.istitle() and beside
            rows = [(w, *c) for w, c in seen.items() if c[2] or plain(w) in mails]
            rest = pd.DataFrame(rows, columns=["word", "n", "capital", "beside", "inside"])
            yield rest.astype({"word": object, "n": "int64", "capital": "int64", "beside": "int64", "inside": "int64"})

    counts = texts.mapInPandas(run, "word string, n bigint, capital bigint, beside bigint, inside bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "capital", "beside", "inside")])
    kept = counts.where((F.col("n") >= KNOWN_WORD) & (F.col("capital") > 0) & (F.col("capital") >= 0.6 * F.col("inside"))).collect()
    near = [r for r in kept if plain(r.word) in mails or r.beside >= 0.3 * r.n]
    words = {r.word: r.n for r in near if r.word not in _ARTEFACTS and r.word not in _TITLES and r.word not in _PARTICLES}
    endings: Counter = Counter(w[-3:] for w in words if len(w) > 5)
    return words, {e: n for e, n in endings.items() if n >= KNOWN_ENDING}


def fit(texts: list[str], epochs: int = EPOCHS, seed: int = 7, known: tuple[dict[str, int], dict[str, int]] = ({}, {})) -> Model:
    """Fits the field to a sample: maximum likelihood over each text's candidate lattice, by adaptive gradient steps.

    First on the texts without open tokens, then on all, with the entities that this model finds in the others.
    """
    model = Model()
    model.name_words, model.endings = known
    ready, waiting = [], []
    for text in texts:
        t = Text(text, model)
        gold, left = shown(t, model)
        (waiting if left else ready).append((t, gold, left))
    lattice = lambda t, gold: (len(t.words), [(i, j, t.features(i, j, k, model), (i, j, k) in gold) for i, j, k in sorted(set(t.found) | gold)])
    lattices = [lattice(t, gold) for t, gold, _ in ready]
    _climb(model, lattices, epochs, seed)
    for t, gold, left in waiting:
        inside = {k for i, j, _ in gold for k in range(i, j)}
        free = [(i, j, kind) for i, j, kind in t.found if not inside & set(range(i, j))]
        # an open name word is a name; the field says from where to where
        scored = [(i, j, kind, model.score(t.features(i, j, kind, model)) + (OPEN_BONUS * len(left & set(range(i, j))) if kind == "person_name" else 0.0)) for i, j, kind in free]
        found = set(best_segments(len(t.words), scored))
        # a text with a token that stays open teaches nothing
        if left <= {k for i, j, _ in found for k in range(i, j)}:
            lattices.append(lattice(t, gold | found))
    _climb(model, lattices, epochs, seed)
    model.weights = {f: round(x, 4) for f, x in model.weights.items() if abs(x) > 1e-3}
    return model


def _climb(model: Model, lattices: list, epochs: int, seed: int) -> None:
    """Gradient steps on the exact likelihood."""
    w, squares, order = model.weights, defaultdict(float), random.Random(seed)
    for _ in range(epochs):
        order.shuffle(lattices)
        for n, segs in lattices:
            if not segs:
                continue
            scored = [(i, j, model.score(f)) for i, j, f, _ in segs]
            ends, begins = defaultdict(list), defaultdict(list)
            for i, j, s in scored:
                ends[j].append((i, s))
                begins[i].append((j, s))
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = _logsum([alpha[j - 1], *(alpha[i] + s for i, s in ends[j])])
            for i in range(n - 1, -1, -1):
                beta[i] = _logsum([beta[i + 1], *(beta[j] + s for j, s in begins[i])])
            for (i, j, s), (_, _, feats, is_gold) in zip(scored, segs):
                g = is_gold - math.exp(alpha[i] + s + beta[j] - alpha[n])
                if abs(g) < 1e-3:
                    continue
                for f in feats:
                    squares[f] += g * g
                    w[f] = w.get(f, 0.0) * 0.9999 + 0.3 * g / (0.1 + math.sqrt(squares[f]))


def _logsum(xs: list[float]) -> float:
    if len(xs) == 1:
        return xs[0]
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def sample_texts(records: DataFrame, sample_rows: int = SAMPLE_ROWS, per_wording: int = PER_WORDING) -> DataFrame:
    """(text): at most `sample_rows` texts by hash order, at most `per_wording` of each opening wording and length."""
    texts = records.where("text IS NOT NULL").select("text").orderBy(F.xxhash64("text"), "text").limit(sample_rows)
    opening = F.regexp_replace(F.substring_index(F.lower("text"), " ", 3), "[0-9]+", "9")
    nth = F.row_number().over(W.partitionBy("opening", "size").orderBy(F.xxhash64("text"), "text"))
    return texts.withColumns({"opening": opening, "size": F.floor(F.length("text") / 40)}).withColumn("n", nth).where(F.col("n") <= per_wording).select("text")


def fit_personal(records: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The field fitted in the tasks: each shard of the sample by itself, the weights averaged over the shards."""
    model = Model()
    model.name_words, model.endings = known = lexicon(records)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [t for pdf in batches for t in pdf["text"]]
        weights = fit(texts, known=known).weights if texts else {}
        yield pd.DataFrame({"feature": list(weights), "weight": list(weights.values())}).astype({"feature": object, "weight": "float64"})

    shards = sample_texts(records, sample_rows).repartition(SHARDS, F.xxhash64("text")).mapInPandas(run, "feature string, weight double")
    # what a shard hasn't seen counts as 0 there
    mean = shards.groupBy("feature").agg((F.sum("weight") / SHARDS).alias("weight"))
    model.weights = {r.feature: r.weight for r in mean.collect()}
    return model


def find_personal(records: DataFrame, sample_rows: int = SAMPLE_ROWS, model: Model | None = None) -> DataFrame:
    """Adds `found` (start, end, type of each entity in order) and `redacted` (the text with placeholders).

    records: any columns with a STRING `text`; own columns of these two names are replaced; null texts give nulls, empty ones themselves. Texts of any length are
    read whole. An empty table stays empty. A model fitted before (`fit_personal`) may be given.
    """
    model = model or fit_personal(records, sample_rows)
    records = records.drop("found", "redacted")
    schema = records.select("*").schema.add("found", _FOUND).add("redacted", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in batches:
            if len(memo) > 300_000:
                memo.clear()
            spans = [None if t is None else model.decode(t, memo) for t in pdf["text"]]
            pdf["found"] = [None if s is None else [{"start": a, "end": b, "type": k} for a, b, k in s] for s in spans]
            pdf["redacted"] = [None if s is None else redact(t, s) for t, s in zip(pdf["text"], spans)]
            yield pdf

    return records.mapInPandas(run, schema)


def _found_type():
    from pyspark.sql import types as T

    return T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())]))


_FOUND = _found_type()


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*out, text[last:]])
