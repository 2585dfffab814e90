"""Suffix stripping of English words in five steps of measured rules (the public Porter algorithm)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Suffixes and what replaces them where the stem in front has at least one, or more than one, vowel group (fixed values).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_PAIRS = [sorted((p.split(":") for p in step.split()), key=lambda p: -len(p[0])) for step in (_STEP2, _STEP3)]
_LAST = sorted(_STEP4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
        if cut is not None and "v" in _shape(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for pairs in _PAIRS:
        for end, to in pairs:
            if word.endswith(end):
                word = word[: -len(end)] + to if _measure(word[: -len(end)]) > 0 else word
                break
    for end in _LAST:
        if word.endswith(end):
            front = word[: -len(end)]
            if _measure(front) > 1 and (end != "ion" or front[-1:] in ("s", "t")):
                word = front
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem_of(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def stems_of(words: pd.Series) -> pd.Series:
    """The stems of arrays of words; a batch's distinct words are stemmed once."""
    known = {w: stem(w) for w in {w for row in words if row is not None for w in row}}
    return words.map(lambda row: None if row is None else [known[w] for w in row])
