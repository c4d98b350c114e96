"""The Porter stemmer (M. F. Porter, 1980), by its published rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = _C + "[^aeiouy]*", _V + "[aeiou]*"
_MEASURE = re.compile(f"^({_CS})?{_VS}{_CS}")
_MEASURE_1 = re.compile(f"^({_CS})?{_VS}{_CS}({_VS})?$")
_MEASURE_2 = re.compile(f"^({_CS})?({_VS}{_CS}){{2,}}")
_VOWEL = re.compile(f"^({_CS})?{_V}")
_CVC = re.compile(f"^{_CS}{_V}[^aeiouwxy]$")
#: Suffixes of steps 2 to 4 (fixed values of the published algorithm).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _swap(word: str, table: dict[str, str], test: re.Pattern) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + table[suffix] if test.search(base) else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    first = word[0] == "y"
    w = "Y" + word[1:] if first else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _MEASURE.search(w[:-3]) else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and _VOWEL.search(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"([^aeiouylsz])\1$", w):
                w = w[:-1]
            elif _CVC.search(w):
                w += "e"
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, _MEASURE), _STEP3, _MEASURE)
    for suffix in _STEP4:
        if w.endswith(suffix):
            w = w[: -len(suffix)] if _MEASURE_2.search(w[: -len(suffix)]) else w
            break
    else:
        if w.endswith(("sion", "tion")) and _MEASURE_2.search(w[:-3]):
            w = w[:-3]
    if w.endswith("e"):
        base = w[:-1]
        if _MEASURE_2.search(base) or (_MEASURE_1.search(base) and not _CVC.search(base)):
            w = base
    if w.endswith("ll") and _MEASURE_2.search(w[:-1]):
        w = w[:-1]
    return w.lower() if first else w


def stem_column(word) -> Column:
    """Stems of a column of words; each different word of a batch is stemmed once."""

    @F.pandas_udf("string")
    def stems(batch: pd.Series) -> pd.Series:
        number, words = pd.factorize(batch)
        return pd.Series(pd.Series([*(stem(w) for w in words), None], dtype=object).to_numpy()[number])

    return stems(word)
