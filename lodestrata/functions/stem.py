"""English stems by Porter's algorithm (M. F. Porter, 1980), as an Arrow function over texts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings and what they become, of steps 2, 3 and 4 as published
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words of these lengths are stemmed, others stay.
SHORTEST, LONGEST = 3, 64


def _kinds(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str]) -> str:
    for n in range(7, 2, -1):
        to = table.get(word[-n:]) if len(word) > n else None
        if to is not None:
            return word[:-n] + to if _measure(word[:-n]) > 0 else word
    return word


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not SHORTEST <= len(word) <= LONGEST or not word.isascii():
        return word
    # plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # -eed, -ed, -ing
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                base = word[: -len(end)]
                if "v" in _kinds(base):
                    word = base
                    if word[-2:] in ("at", "bl", "iz"):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2), _STEP_3)
    for end in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def folded(text: str) -> list[str]:
    """Lower-case words of letters and digits without accents, as stems."""
    plain = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return [stem(w) for w in re.findall(r"[^\W_]+", plain.lower())]


def stems(text: Column) -> Column:
    """ARRAY<STRING> of the text's stems in order, in Arrow batches; none for a null text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: folded(t) if t else [])

    return run(text)
