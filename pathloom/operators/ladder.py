"""Whole analyses against an external reference: the ladder of agreement, and what goes wrong.

An analysis is a row of arrays, one entry per word in text order. The reference spells lemmas in
its own way: a lemma agrees strictly if it is the normalised spelling, tolerantly if it is one of
the spellings under which the other scheme may list it (aliases and variants included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lemmas, tokens
from .metrics import sequence_levels


def analyses(paths: DataFrame, words: DataFrame, fields: list[str]) -> DataFrame:
    """(sentence_id, node_id array, <fields> arrays): the words of each path (sentence_id, nodes) in text order.

    ``words`` has (sentence_id, node_id, char_start, form, ...). Words are ordered by their place in
    the text, equal places as the path has them; nodes with an empty, null or unknown form are no
    words. A path without words does not come out.
    """
    each = paths.select("sentence_id", F.posexplode("nodes").alias("at", "node_id")).join(words.where("form <> ''"), ["sentence_id", "node_id"])
    x = F.array_sort(F.collect_list(F.struct("char_start", "at", "node_id", *[f for f in fields if f != "node_id"])))
    return each.groupBy("sentence_id").agg(x.alias("x")).select("sentence_id", *[F.col(f"x.{f}").alias(f) for f in fields])


def reference_lemmas(rows: DataFrame, raw: str) -> DataFrame:
    """rows with ``strict``, the normalised spelling of the reference's lemma, and ``tolerant``, all that it may stand for."""
    return rows.withColumn("strict", lemmas.normalize_lemma(F.col(raw))).withColumn("tolerant", lemmas.lemma_candidates(F.col(raw), True))


def levels(predicted: str = "p", reference: str = "g") -> dict[str, Column]:
    """The eight levels over columns <p>_form, <p>_lemma, <p>_code and <g>_form, <g>_strict, <g>_tolerant, <g>_code."""
    p, g = (lambda c, x=x: F.col(f"{x}_{c}") for x in (predicted, reference))
    s, m, strict = p("form") == g("form"), p("code") == g("code"), p("lemma") == g("strict")
    each = F.forall(F.zip_with(g("tolerant"), p("lemma"), lambda t, x: F.coalesce(F.array_contains(t, x), F.lit(False))), lambda ok: ok)
    tolerant = (F.size(p("lemma")) == F.size(g("tolerant"))) & each
    return {
        "S": s, "L": strict, "L(tol)": tolerant, "S+M": s & m, "L+M": strict & m, "L+M(tol)": tolerant & m,
        "S+L+M": s & strict & m, "S+L+M(tol)": s & tolerant & m,
    }


def ladder(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(level, sentences, hits, share) of the reference's sentences; one without a prediction is a miss.

    reference (sentence_id, form, strict, tolerant, code), predicted (sentence_id, form, lemma, code).
    """
    return sequence_levels(sided(reference, predicted), levels())


def sided(reference: DataFrame, predicted: DataFrame, how: str = "left") -> DataFrame:
    """Both analyses of a sentence in one row, with prefixes g_ and p_."""
    prefix = lambda df, x: df.select("sentence_id", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "sentence_id"])
    return prefix(reference, "g").join(prefix(predicted, "p"), "sentence_id", how)


# -- what goes wrong -----------------------------------------------------------------------------


def role_counts(analysed: DataFrame, vocab: DataFrame) -> DataFrame:
    """(sentence_id, counts struct<n_nom, n_acc, n_finite, n_part>) of the tags of each analysis."""
    tags = vocab.where("kind = 'tag'").select(F.col("token").alias("tag"), *[tokens.roles(F.col("token"))[k].alias(k) for k in ("case_name", "is_finite", "is_participle")]).distinct()
    each = analysed.select("sentence_id", F.explode("tag").alias("tag")).join(tags, "tag", "left")
    counted = each.groupBy("sentence_id").agg(
        F.count_if(F.col("case_name") == "nom").alias("n_nom"), F.count_if(F.col("case_name") == "acc").alias("n_acc"),
        F.count_if("is_finite").alias("n_finite"), F.count_if("is_participle").alias("n_part"),
    )
    return counted.select("sentence_id", F.struct("n_nom", "n_acc", "n_finite", "n_part").alias("counts"))


def constraints(c: Column) -> dict[str, Column]:
    """Whether role counts are those of a well-formed clause, by three crude rules."""
    return {
        "one nominative per verb": c["n_nom"] <= F.greatest(F.lit(1), c["n_finite"]),
        "accusative has a governor": (c["n_acc"] == 0) | (c["n_finite"] + c["n_part"] > 0),
        "nominatives up to verbs plus one": c["n_nom"] <= c["n_finite"] + 1,
    }


def word_errors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Word by word (sentence_id, category, p_tag, g_tag, p_counts, g_counts); sentences of unlike length are one row each.

    Both sides are (sentence_id, node_id, form, lemma, tag, counts). Categories: length, right, form,
    lemma, same, morph: the first of these in which the analyses differ.
    """
    both = sided(gold, predicted, "inner")
    alike = F.size("g_form") == F.size("p_form")
    word = F.arrays_zip(*[f"{x}_{c}" for x in "gp" for c in ("node_id", "form", "lemma", "tag")])
    none = F.array().cast(both.select(word.alias("w")).schema["w"].dataType)
    each = both.select("sentence_id", "g_counts", "p_counts", F.explode_outer(F.when(alike, word).otherwise(none)).alias("w"))
    w = lambda c: (F.col(f"w.g_{c}") == F.col(f"w.p_{c}"))
    category = F.when(F.col("w").isNull(), "length").when(w("node_id"), "right").when(~w("form"), "form").when(~w("lemma"), "lemma").when(w("tag"), "same").otherwise("morph")
    return each.select("sentence_id", category.alias("category"), F.col("w.p_tag").alias("p_tag"), F.col("w.g_tag").alias("g_tag"), "p_counts", "g_counts")


def error_report(errors: DataFrame, gate: float = 0.4) -> DataFrame:
    """(section, name, n): categories, tag confusions, direction of case errors, verbless and separable ones, and the gate.

    Separable: the gold counts keep a rule that the predicted ones break, so a reranker over counts
    could tell them apart; ``gate`` is the share of separable errors, by any rule, that must be reached
    (n of the gate is 1 or 0). ``errors`` is read several times, so it should be stored.
    """
    row = lambda df, section, name: df.agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), name, "n")
    cases = errors.where("category = 'morph'")
    part = lambda c: F.struct(F.substring_index(c, ".", 1).alias("head"), F.when(F.instr(c, ".") > 0, F.substring(c, F.instr(c, ".") + 1, F.length(c))).otherwise("").alias("rest"))
    split = cases.select(part(F.col("p_tag")).alias("p"), part(F.col("g_tag")).alias("g"))
    case_only = split.where((F.col("p.rest") == F.col("g.rest")) & F.col("p.head").isin(tokens.CASES) & F.col("g.head").isin(tokens.CASES))
    keeps, breaks = constraints(F.col("g_counts")), constraints(F.col("p_counts"))
    apart = {name: keeps[name] & ~breaks[name] for name in keeps}
    some = F.lit(False)
    for c in apart.values():
        some = some | c
    counted = {"errors": F.lit(True), "verbless": F.col("g_counts.n_finite") == 0, "identical counts": F.col("g_counts") == F.col("p_counts"), **apart, "any rule": some}
    sums = cases.agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    gated = F.when(F.col("any rule") >= gate * F.greatest("errors", F.lit(1)), 1).otherwise(0).cast("long")
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counted], F.struct(F.lit("gate").alias("name"), gated.alias("n")))).alias("x")
    return (
        row(errors.groupBy("category"), "category", F.col("category").alias("name"))
        .unionByName(row(cases.groupBy(F.concat_ws(" -> ", "p_tag", "g_tag").alias("name")), "confusion", F.col("name")))
        .unionByName(row(case_only.groupBy(F.concat_ws(" -> ", "p.head", "g.head").alias("name")), "direction", F.col("name")))
        .unionByName(sums.select(stacked).select(F.lit("morph").alias("section"), "x.name", "x.n"))
    )
