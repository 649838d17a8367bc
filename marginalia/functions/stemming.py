"""Stems of English words (Porter, An algorithm for suffix stripping, 1980), and words without their accents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

#: Suffixes of the paper's steps 2 to 4 and what takes their place.
STEP_2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
)
STEP_3 = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
PAIRS = [{a: b.replace("-", "") for a, b in (x.split() for x in step.split(", "))} for step in (STEP_2, STEP_3)]
REMEMBERED = 1 << 18


def _shape(word: str) -> str:
    """The word as v(owels) and c(onsonants); a y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return len(re.findall("v+c", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends with consonant, vowel, consonant, the last of them none of w, x, y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, pairs: dict[str, str], least: int) -> str:
    """The longest suffix that fits is replaced if what stands before it has a measure over ``least``."""
    for n in range(min(7, len(word)), 0, -1):
        end = word[-n:]
        if end in pairs:
            return word[:-n] + pairs[end] if _measure(word[:-n]) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words in other scripts stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
        if cut and "v" in _shape(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-2:-1] == word[-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for pairs in PAIRS:
        word = _swap(word, pairs, 0)
    end = max((e for e in STEP_4 if word.endswith(e)), key=len, default="")
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        short = word[:-1]
        if _measure(short) > 1 or _measure(short) == 1 and not _short_end(short):
            word = short
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def folded(text: str | None) -> str:
    """Lower case, accents taken off."""
    plain = (text or "").lower()
    return plain if plain.isascii() else "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))


def folded_words(text: str | None) -> list[str]:
    """A text's words, folded, in their order."""
    return re.findall(r"\w+", folded(text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of a text's words in their order; null and empty texts have none."""
    known: dict[str, str] = {}
    for texts in batches:
        out = []
        for text in texts:
            words = folded_words(text)
            for w in words:
                if w not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[w] = stem(w)
            out.append([known.get(w) or stem(w) for w in words])
        yield pd.Series(out, dtype="object")
