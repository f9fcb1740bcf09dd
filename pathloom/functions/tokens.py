"""Analysed tokens ``form_lemma_features``, the roles that a tag names, and predicates over paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grammatical classes of tag tokens.
CASES = ["nom", "acc", "dat", "abl", "g", "loc", "voc", "i"]
NUMBERS = ["sg", "du", "pl"]
PERSONS = ["1", "2", "3"]
PARTICIPLES = ["ppr", "pfp", "pp", "ppa"]
INDECLINABLES = ["adv", "ind", "conj", "prep", "part"]


def parse_analysed(text: Column) -> dict[str, Column]:
    """words, lemmas and tags of a text of analysed tokens, as arrays.

    A token has up to three fields; a form's trailing hyphens and underscores around the features
    fall away. A token with an empty form has no word but a lemma and a tag. Blank text: no tokens.
    """
    parts = F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), lambda t: F.split(t, "_", 3))
    field = lambda p, i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    words = F.transform(parts, lambda p: F.regexp_replace(field(p, 0), "-+$", ""))
    return {
        "words": F.filter(words, lambda w: w != ""),
        "lemmas": F.transform(parts, lambda p: field(p, 1)),
        "tags": F.transform(parts, lambda p: F.trim(F.regexp_replace(field(p, 2), "^_+|_+$", ""))),
    }


def roles(tag: Column) -> dict[str, Column]:
    """What a tag says of its word; a null tag says nothing (false and empty)."""
    t = F.split(F.replace(F.coalesce(tag, F.lit("")), F.lit("."), F.lit(" ")), r"\s+")
    some = lambda names: F.arrays_overlap(t, F.array(*[F.lit(n) for n in names]))
    first = lambda names: F.coalesce(F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(t, n)), F.lit(0)), F.lit(""))
    return {
        "is_participle": some(PARTICIPLES), "is_finite": some(PERSONS) & ~some(PARTICIPLES), "case_name": first(CASES), "number_name": first(NUMBERS),
        "is_indeclinable": some(INDECLINABLES), "is_compound": F.array_contains(t, "iic"),
    }


def gold_roles(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Gold nodes with the roles of their tags; an unknown tag has none."""
    tags = vocab.where("kind = 'tag'").select(F.col("id").alias("tag_id"), *[c.alias(n) for n, c in roles(F.col("token")).items()])
    return nodes.where("is_gold").join(tags, "tag_id", "left")


def gold_role_counts(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per sentence with gold nodes: words per case, number and class."""
    g = gold_roles(nodes, vocab)
    counts = [F.count_if(F.col("case_name") == c).alias(f"n_{c}") for c in CASES] + [F.count_if(F.col("number_name") == c).alias(f"n_{c}") for c in NUMBERS]
    flags = [F.count_if(F.col(f"is_{c}")).alias(f"n_{c}") for c in ("finite", "participle", "indeclinable", "compound")]
    return g.groupBy("sentence_id").agg(*counts, *flags, F.count("*").alias("n_words"))


def gold_constraints(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per sentence: a finite verb, a nominative, and one of each that agree in number.

    Numbers are few, so agreement is an overlap of two sets of numbers and no join of pairs.
    """
    g = gold_roles(nodes, vocab).where("is_finite is not null")
    numbers = lambda flag: F.collect_set(F.when(flag & (F.col("number_name") != ""), F.col("number_name")))
    per = g.groupBy("sentence_id").agg(
        F.bool_or("is_finite").alias("has_finite"), F.bool_or(F.col("case_name") == "nom").alias("has_nominative"),
        numbers(F.col("case_name") == "nom").alias("n"), numbers(F.col("is_finite")).alias("v"),
    )
    return per.select("sentence_id", "has_finite", "has_nominative", F.arrays_overlap("n", "v").alias("agrees"))
