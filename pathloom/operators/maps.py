"""Tables that translate between labelling conventions: learning, checking and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dominant(pairs: DataFrame, key: list[str], value: list[str], least_count: int = 3, least_ratio: float = 0.9, drop_identity: bool = True) -> DataFrame:
    """(key, value, support, total): the commonest value of each key, where it is common enough.

    Of equally common values the least holds. Rows with a null in the key or value are not counted.
    """
    counted = pairs.dropna(subset=[*key, *value]).groupBy(*key, *value).agg(F.count("*").alias("support"))
    # keys are many and a key's distinct values few, so the choice is an aggregate and no sort of all pairs
    best = counted.groupBy(*key).agg(
        F.sum("support").alias("total"), F.max("support").alias("most"),
        F.min(F.struct((-F.col("support")).alias("s"), *[F.col(v) for v in value])).alias("b"),
    )
    out = best.select(*key, *[F.col(f"b.{v}").alias(v) for v in value], F.col("most").alias("support"), "total")
    out = out.where((F.col("support") >= least_count) & (F.col("support") >= least_ratio * F.col("total")))
    if drop_identity and len(key) == len(value):
        same = F.lit(True)
        for k, v in zip(key, value, strict=True):
            same = same & (F.col(k) == F.col(v))
        out = out.where(~same)
    return out


def purity(pairs: DataFrame, key: str, value: str, least_support: int = 10, gate: float = 0.9) -> DataFrame:
    """One row: keys, tokens, support-weighted purity over all and over well-supported keys, the share
    of tokens in keys less pure than ``gate``, and whether the purity of the supported ones passes."""
    counted = pairs.dropna(subset=[key, value]).groupBy(key, value).agg(F.count("*").alias("n"))
    keys = counted.groupBy(key).agg(F.sum("n").alias("support"), F.max("n").alias("most"))
    solid = F.col("support") >= least_support
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    out = keys.agg(
        F.count("*").alias("keys"), F.sum("support").alias("tokens"), share(F.sum("most"), F.sum("support")).alias("purity"),
        share(F.sum(F.when(solid, F.col("most"))), F.sum(F.when(solid, F.col("support")))).alias("solid_purity"),
        F.count_if(~solid).alias("low_support_keys"),
        share(F.sum(F.when(F.col("most") < gate * F.col("support"), F.col("support"))), F.sum("support")).alias("impure_share"),
    )
    return out.withColumn("passes", F.col("solid_purity") >= gate)


def apply_with_backoff(rows: DataFrame, pair_rules: DataFrame, lemma_rules: DataFrame, lemma: str = "lemma", tag: str = "tag") -> DataFrame:
    """Rewrite (lemma, tag) by the joint rule, else the lemma by the lemma rule, else keep both.

    pair_rules (lemma, tag, to_lemma, to_tag) and lemma_rules (lemma, to) are unique by key. A null
    lemma or tag meets no rule. The column ``rule`` says which rule held.
    """
    p = pair_rules.select(F.col("lemma").alias(lemma), F.col("tag").alias(tag), F.col("to_lemma").alias("_pl"), F.col("to_tag").alias("_pt"))
    s = lemma_rules.select(F.col("lemma").alias(lemma), F.col("to").alias("_sl"))
    joined = rows.join(p, [lemma, tag], "left").join(s, lemma, "left")
    return (
        joined.withColumn("rule", F.when(F.col("_pl").isNotNull(), "pair").when(F.col("_sl").isNotNull(), "lemma").otherwise("none"))
        .withColumn("new_lemma", F.coalesce("_pl", "_sl", lemma))
        .withColumn("new_tag", F.when(F.col("_pl").isNotNull(), F.col("_pt")).otherwise(F.col(tag)))
        .drop("_pl", "_pt", "_sl")
    )


def with_sentinel(rows: DataFrame, bridge: DataFrame, key: str, value: str) -> DataFrame:
    """Join a bridge (key, value); a miss becomes '<unmapped:key>', a null key '<unmapped:>'."""
    miss = F.concat(F.lit("<unmapped:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(">"))
    return rows.join(bridge, key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), miss))


def assert_disjoint(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row (shared): the number of keys in both; 0 where nothing leaks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("shared"))


def require_disjoint(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """The same row, or an error that says what leaks, if a key is in both."""
    shared = assert_disjoint(left, right, key)
    wrong = F.raise_error(F.concat(F.lit(f"{what}: "), F.col("shared").cast("string"), F.lit(" keys in both")))
    return shared.select(F.when(F.col("shared") > 0, wrong.cast("long")).otherwise(F.col("shared")).alias("shared"))


def most_common(rows: DataFrame, by: list[str], n: int, tie: list[Column] | None = None) -> DataFrame:
    """The n commonest groups, ties by the group itself."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), *(tie or [F.asc(c) for c in by])).limit(n)


def examples(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """At most n rows of each group, first in the order given.

    Spark cuts a rank limit before the exchange as well (window group limit), so a group brings at
    most n rows per input partition to its task.
    """
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_i") <= n).drop("_i")
