"""English stems by Porter's published rules (1980), for keyword search that matches inflected forms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffix tables of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_PLAIN = re.compile(r"[a-z]{3,}$")


def _shape(w: str) -> str:
    """v and c for each letter; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replaced(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + table[suffix] if _measure(base) > 0 else w
    return w


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    if not _PLAIN.match(w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and "v" in _shape(base):
            w = base
            if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w)):
                w += "e"
            elif _doubled(w) and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _doubled(w) and w.endswith("l") else w


def stemmed(words: Column) -> Column:
    """An array of words as stems, by Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(words)
