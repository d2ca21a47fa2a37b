"""English stems by the published rules of the second Porter stemmer.

A word is lower-case a-z; words of other characters, and of one or two letters, are their own stems.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published rules: letters, irregular words, suffixes.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
REGION_STARTS = ("gener", "commun", "arsen")
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_WORD = re.compile(r"[a-z]+\Z")
#: A syllable that ends short: vowel and consonant at the word's start, or between consonants unless w, x or a consonant y ends it.
_SHORT = re.compile(rf"(?:\A[{VOWELS}][^{VOWELS}]|[^{VOWELS}][{VOWELS}][^{VOWELS}wxY])\Z")
_REGION = re.compile(rf"[{VOWELS}][^{VOWELS}]")


def _after(word: str, at: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    found = _REGION.search(word, at)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return w[: len(w) - len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if end is None or not re.search(f"[{VOWELS}]", w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT.search(w) else w


def _derived(w: str, r1: int, r2: int) -> str:
    end = _ending(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        rest = w[: -len(end)]
        if not (end == "ogi" and not rest.endswith("l")) and not (end == "li" and rest[-1:] not in tuple(BEFORE_LI)):
            w = rest + STEP_2[end]
    end = _ending(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _ending(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    return w


@lru_cache(1 << 16)
def english(word: str) -> str:
    """The stem of one word."""
    if len(word) < 3 or not _WORD.match(word):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(rf"(?<=[{VOWELS}])y|\Ay", "Y", word)
    start = next((s for s in REGION_STARTS if w.startswith(s)), None)
    r1 = len(start) if start else _after(w, 0)
    r2 = _after(w, r1)
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _derived(w, r1, r2)
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem(token) -> Column:
    """The stem of a column of words; null for null."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(english, na_action="ignore")

    return stems(token)
