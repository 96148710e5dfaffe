"""English stems by the published Porter2 rules, run over a corpus's distinct words and joined back.

R1 is what follows the first non-vowel after a vowel, R2 the same within R1. Words of two letters stay as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words with stems of their own, words that are left after the plural step, beginnings whose R1 is fixed.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
PREFIXES = ("gener", "commun", "arsen")
# Endings of the second and third steps with what takes their place, and those of the fourth that go.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_AFTER = "cdeghkmnrt"

_VOWEL, _REGION = re.compile("[aeiouy]"), re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    start = next((len(p) for p in PREFIXES if word.startswith(p)), None)
    if start is None:
        m = _REGION.search(word)
        start = m.end() if m else len(word)
    m = _REGION.search(word, start)
    return start, m.end() if m else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        return w[: -len(ending)] + "ee" if len(w) - len(ending) >= r1 else w
    if ending is None or not _VOWEL.search(w[: -len(ending)]):
        return w
    w = w[: -len(ending)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT_END.search(w) else w


def _replaced(w: str, r1: int, r2: int, rules: dict[str, str]) -> str:
    ending = _longest(w, rules)
    if ending is None or len(w) - len(ending) < r1:
        return w
    before = w[: -len(ending)]
    allowed = {"ogi": before.endswith("l"), "li": before[-1:] in LI_AFTER and before != "", "ative": len(before) >= r2}.get(ending, True)
    return before + rules[ending] if allowed else w


def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.lstrip("'") if word.startswith("'") else word
    w = re.sub("(^|(?<=[aeiouy]))y", "Y", w)  # a consonant
    r1, r2 = _regions(w)
    w = re.sub("'(s'?)?$", "", w)
    w = _plural(w)
    if w in FINISHED:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _replaced(w, r1, r2, SECOND)
    w = _replaced(w, r1, r2, THIRD)
    ending = _longest(w, FOURTH)
    if ending and len(w) - len(ending) >= r2 and (ending != "ion" or w[: -len(ending)].endswith(("s", "t"))):
        w = w[: -len(ending)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def with_stems(rows: DataFrame, word: str = "word") -> DataFrame:
    """rows with `lexeme`, the stem of their word: each distinct word is stemmed once, however often it stands."""
    known = rows.select(word).distinct().withColumn("lexeme", _stems(word))
    return rows.join(known, word)
