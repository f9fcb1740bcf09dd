"""Romanisations of Sanskrit: SLP1, IAST and Harvard-Kyoto, and reduction to letters.

SLP1 has one ASCII letter per sound, so SLP1 to IAST is a map of single characters and stays in
the JVM. IAST to SLP1 is a greedy longest match at each position and runs in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The SLP1 letters, in the order vowels, signs, consonants, with their IAST forms.
SLP1_TO_IAST = {
    "a": "a", "A": "ā", "i": "i", "I": "ī", "u": "u", "U": "ū", "f": "ṛ", "F": "ṝ", "x": "ḷ", "X": "ḹ",
    "e": "e", "E": "ai", "o": "o", "O": "au", "M": "ṃ", "H": "ḥ",
    "k": "k", "K": "kh", "g": "g", "G": "gh", "N": "ṅ", "c": "c", "C": "ch", "j": "j", "J": "jh", "Y": "ñ",
    "w": "ṭ", "W": "ṭh", "q": "ḍ", "Q": "ḍh", "R": "ṇ", "t": "t", "T": "th", "d": "d", "D": "dh", "n": "n",
    "p": "p", "P": "ph", "b": "b", "B": "bh", "m": "m", "y": "y", "r": "r", "l": "l", "v": "v",
    "S": "ś", "z": "ṣ", "s": "s", "h": "h",
}
# Other ways in which IAST letters are written.
IAST_VARIANTS = {"ṁ": "M", "m̐": "M", "r̥̄": "F", "r̥": "f", "l̥̄": "X", "l̥": "x", "ē": "e", "ō": "o"}
# Harvard-Kyoto letters that differ from SLP1.
HK_TO_SLP1 = {
    "lRR": "X", "lR": "x", "RR": "F", "R": "f", "ai": "E", "au": "O", "kh": "K", "gh": "G", "G": "N", "ch": "C", "jh": "J",
    "J": "Y", "Th": "W", "T": "w", "Dh": "Q", "D": "q", "N": "R", "th": "T", "dh": "D", "ph": "P", "bh": "B",
    "z": "S", "S": "z",
}

# SLP1 letters in Devanagari: vowels alone and after a consonant, consonants, signs.
DEVANAGARI_VOWELS = {
    "a": ("अ", ""), "A": ("आ", "ा"), "i": ("इ", "ि"), "I": ("ई", "ी"), "u": ("उ", "ु"), "U": ("ऊ", "ू"), "f": ("ऋ", "ृ"), "F": ("ॠ", "ॄ"),
    "x": ("ऌ", "ॢ"), "X": ("ॡ", "ॣ"), "e": ("ए", "े"), "E": ("ऐ", "ै"), "o": ("ओ", "ो"), "O": ("औ", "ौ"),
}
DEVANAGARI_CONSONANTS = {
    "k": "क", "K": "ख", "g": "ग", "G": "घ", "N": "ङ", "c": "च", "C": "छ", "j": "ज", "J": "झ", "Y": "ञ", "w": "ट", "W": "ठ", "q": "ड", "Q": "ढ", "R": "ण",
    "t": "त", "T": "थ", "d": "द", "D": "ध", "n": "न", "p": "प", "P": "फ", "b": "ब", "B": "भ", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व",
    "S": "श", "z": "ष", "s": "स", "h": "ह",
}
DEVANAGARI_SIGNS = {"M": "ं", "H": "ः", "'": "ऽ"}
VIRAMA = "्"


def _scanner(table: dict[str, str]) -> tuple[re.Pattern, dict[str, str]]:
    return re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))), table


_IAST = _scanner({v: k for k, v in SLP1_TO_IAST.items() if v != k} | IAST_VARIANTS)
_HK = _scanner(HK_TO_SLP1)
_DIACRITIC = re.compile("[" + "".join(sorted({c for c in "".join(_IAST[1]) if ord(c) > 127 and not unicodedata.combining(c)})) + "]|[rl]̥")


def iast_to_slp1(text: str) -> str:
    """Greedy longest match at each position; unknown characters stay."""
    pattern, table = _IAST
    return pattern.sub(lambda m: table[m.group()], text)


def hk_to_slp1(text: str) -> str:
    """Harvard-Kyoto to SLP1 by greedy longest match; unknown characters stay."""
    pattern, table = _HK
    return pattern.sub(lambda m: table[m.group()], text)


def slp1_to_iast(text: str) -> str:
    """Letter by letter; unknown characters stay."""
    return "".join(SLP1_TO_IAST.get(c, c) for c in text)


def is_iast(text: str) -> bool:
    """Whether a composed text has a letter that only IAST has."""
    return bool(_DIACRITIC.search(text.lower()))


def slp1_letters(text: str | None) -> str:
    """A text of either romanisation and any Unicode form as its SLP1 letters alone.

    A text is IAST if it has an IAST diacritic, and is then read without case; otherwise it is
    SLP1, where case matters. Null and texts without letters become the empty string.
    """
    if not text:
        return ""
    # format characters (soft hyphens, joiners) first: one may stand between a letter and its mark
    text = "".join([c for c in text if unicodedata.category(c) != "Cf"]) if not text.isascii() else text
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text)) if not text.isascii() else text
    if not text.isascii() and is_iast(text):
        text = iast_to_slp1(text.lower())
    return "".join([c for c in text if c in SLP1_TO_IAST])


def _text_udf(convert: Callable[[str | None], str | None]):
    """A Python text function over Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(convert)

    return F.pandas_udf(run, T.StringType())


def slp1_letters_column(col: Column) -> Column:
    """slp1_letters of a column, in Arrow batches."""
    return _text_udf(slp1_letters)(col)


def iast_to_slp1_column(col: Column) -> Column:
    """iast_to_slp1 of a column; null stays null."""
    return _text_udf(lambda t: None if t is None else iast_to_slp1(t))(col)


def nfc_strip_column(col: Column) -> Column:
    """Composed Unicode form without white space at either end; null stays null."""
    return _text_udf(lambda t: None if t is None else unicodedata.normalize("NFC", t).strip())(col)


def slp1_to_iast_column(col: Column) -> Column:
    """SLP1 to IAST inside the JVM: one pass per target length, no Python."""
    single = {k: v for k, v in SLP1_TO_IAST.items() if len(v) == 1 and v != k}
    double = {k: v for k, v in SLP1_TO_IAST.items() if len(v) == 2}
    lookup = F.create_map(*[F.lit(x) for pair in (single | double).items() for x in pair])
    return F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(lookup, c), c)), "")


def slp1_to_devanagari_column(col: Column) -> Column:
    """SLP1 to Devanagari inside the JVM, letter by letter with a look at both neighbours.

    A consonant carries the sign of a following vowel, a virama before anything else; a vowel after
    a consonant is in that sign already. Unknown characters stay. Null stays null.
    """
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    alone, after = table({k: v[0] for k, v in DEVANAGARI_VOWELS.items()}), table({k: v[1] for k, v in DEVANAGARI_VOWELS.items()})
    consonants, signs = table(DEVANAGARI_CONSONANTS), table(DEVANAGARI_SIGNS)
    letters = F.split(col, "")
    neighbour = lambda i: F.coalesce(F.get(letters, i), F.lit(""))

    def one(c: Column, i: Column) -> Column:
        sign = F.coalesce(F.try_element_at(after, neighbour(i + 1)), F.lit(VIRAMA))
        vowel = F.try_element_at(alone, c)
        bound = F.try_element_at(consonants, neighbour(i - 1)).isNotNull() & (i > 0)
        return F.coalesce(F.concat(F.try_element_at(consonants, c), sign), F.when(vowel.isNotNull() & bound, F.lit("")).otherwise(vowel), F.try_element_at(signs, c), c)

    return F.array_join(F.transform(letters, one), "")
