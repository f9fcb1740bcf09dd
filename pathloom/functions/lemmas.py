"""Lemma normalisation and the spellings under which one annotation scheme may list another's lemma.

All column functions; applied once per distinct lemma, then joined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IAST sequences in the order in which they are replaced, then single letters.
DIGRAPHS = [("kh", "K"), ("gh", "G"), ("ch", "C"), ("jh", "J"), ("ṭh", "W"), ("ḍh", "Q"), ("th", "T"), ("dh", "D"), ("ph", "P"), ("bh", "B"), ("ai", "E"), ("au", "O")]
LETTERS_FROM, LETTERS_TO = "āīūṛṝḷḹṅñṭḍṇśṣḥṃ", "AIUfFxXNYwqRSzHM"
# Spelling variants, each one chain of replacements of the whole word.
RETROFLEX = [[("R", "n"), ("z", "s"), ("M", "m")], [("Md", "nd"), ("Mt", "nt"), ("MD", "nD")], [("Mb", "mb"), ("Mp", "mp")]]
VOWELS = [[("A", "aa")], [("I", "ii")], [("U", "uu")]]
GRADES = [[("u", "o"), ("U", "O")], [("i", "e"), ("I", "E")], [("o", "u"), ("O", "U")], [("e", "i"), ("E", "I")]]
ANUSVARA = [[("M", nasal)] for nasal in "NYRnm"]
R_GRADES = [[("f", "ar")], [("f", "Ar")], [("F", "Ar")], [("ar", "f")], [("Ar", "f")]]
# Endings that are stripped: ending, least length of the word, letters cut.
SUFFIXES = [("ay", 4, 2), ("pay", 5, 3), ("vay", 5, 3), ("ant", 5, 1), ("d", 3, 1), ("n", 4, 1)]
# Lemmas, and lemma and code pairs, with another name in the other scheme.
ALIASES = {"mahA": "mahant", "tva": "tvad", "Bavant": "Bavat", "uB": "uBa", "nAma": "nAman", "ityAdi": "iti"}
CODE_ALIASES = {("mahA", "2"): ("mahant", "3")}


def normalize_lemma(col: Column) -> Column:
    """IAST to SLP1 by ordered replacement; apostrophes fall away; null becomes the empty string."""
    out = F.coalesce(col, F.lit(""))
    for a, b in DIGRAPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, LETTERS_FROM + "'", LETTERS_TO)


def _chain(word: Column, steps: list[tuple[str, str]]) -> Column:
    for a, b in steps:
        word = F.replace(word, F.lit(a), F.lit(b))
    return word


def _spellings(words: Column, families: list[list[list[tuple[str, str]]]], suffixes: bool) -> Column:
    """Every word with its variants of all families, each once."""

    def of(word: Column) -> Column:
        out = [word, *[_chain(word, steps) for family in families for steps in family]]
        if suffixes:
            out += [F.when(word.endswith(ending) & (F.length(word) >= least), F.left(word, F.length(word) - cut)).otherwise(word) for ending, least, cut in SUFFIXES]
        return F.array(*out)

    return F.array_distinct(F.flatten(F.transform(words, of)))


def lemma_candidates(col: Column, extended: bool = False) -> Column:
    """The sorted spellings of a raw lemma: itself, its variants, their variants, and aliases.

    ``extended`` adds nasal and r-grade spellings of those, once, and the shortened forms of these.
    The null lemma has the one spelling ''.
    """
    base = F.array(normalize_lemma(col))
    words = base
    for _ in range(2):
        words = _spellings(words, [RETROFLEX, VOWELS, GRADES], True)
    if extended:
        more = _spellings(words, [ANUSVARA, R_GRADES], False)
        words = F.array_union(words, _spellings(more, [], True))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    other = F.filter(F.transform(words, lambda w: F.try_element_at(names, w)), lambda w: w.isNotNull())
    return F.array_sort(F.array_union(words, other))


def lemma_code_candidates(lemma: Column, code: Column, extended: bool = False) -> Column:
    """(lemma, code) pairs of an annotation: all its spellings with its code, and aliased pairs."""
    pairs = F.transform(lemma_candidates(lemma, extended), lambda w: F.struct(w.alias("lemma"), code.alias("code")))
    for (a, b), (c, d) in CODE_ALIASES.items():
        hit = (normalize_lemma(lemma) == a) & (code == b)
        pairs = F.when(hit, F.concat(pairs, F.array(F.struct(F.lit(c).alias("lemma"), F.lit(d).alias("code"))))).otherwise(pairs)
    return F.array_distinct(pairs)
