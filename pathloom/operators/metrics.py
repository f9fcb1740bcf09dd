"""Metrics of predicted paths against gold paths.

Paths are (sentence_id, rank, score, nodes array<int>) with rank 0 the best; gold is
(sentence_id, nodes array<int>) in path order. Boundaries are stripped by ``strip`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(nodes: Column) -> Column:
    """A path without its first and last node; empty for two nodes or fewer."""
    return F.when(F.size(nodes) > 2, F.slice(nodes, F.lit(2), F.size(nodes) - 2)).otherwise(F.array().cast("array<int>"))


def ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def compared(gold: DataFrame, predicted: DataFrame, skip_empty: bool = True) -> DataFrame:
    """Per gold sentence: tp, fp, fn over node sets and whether the sets are equal.

    A missing prediction is empty. Sentences with empty gold are skipped or scored, as asked.
    """
    none = F.array().cast("array<int>")
    g = gold.select("sentence_id", F.array_distinct(F.coalesce("nodes", none)).alias("g"))
    p = predicted.select("sentence_id", F.array_distinct(F.coalesce("nodes", none)).alias("p"))
    both = g.join(p, "sentence_id", "left").withColumn("p", F.coalesce("p", none))
    if skip_empty:
        both = both.where(F.size("g") > 0)
    tp = F.size(F.array_intersect("g", "p"))
    rows = both.select("sentence_id", tp.alias("tp"), (F.size("p") - tp).alias("fp"), (F.size("g") - tp).alias("fn"))
    return rows.withColumn("perfect", (F.col("fp") == 0) & (F.col("fn") == 0))


def micro(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of tp, fp and fn, their ratios, and the share of perfect sentences."""
    sums = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("sentences"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"),
        F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"), F.count_if("perfect").alias("perfect"),
    )
    share = F.round(F.coalesce(F.try_divide("perfect", "sentences"), F.lit(0.0)), 6).alias("perfect_share")
    return sums.select(*(by or []), "sentences", "tp", "fp", "fn", *ratios(F.col("tp"), F.col("fp"), F.col("fn")), share)


def macro(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the sentences' precision, recall and f1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("sentences"), *[F.round(F.avg(c), 6).alias(n) for n, c in (("precision", p), ("recall", r), ("f1", f))])


def multiset(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per sentence tp, fp, fn over token multisets; (sentence_id, token) rows, one per occurrence.

    A sentence of one side only is scored against the empty multiset.
    """
    a = gold.groupBy("sentence_id", "token").agg(F.count("*").alias("g"), F.lit(0).cast("long").alias("p"))
    b = predicted.groupBy("sentence_id", "token").agg(F.lit(0).cast("long").alias("g"), F.count("*").alias("p"))
    each = a.unionByName(b).groupBy("sentence_id", "token").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    hit = F.least("g", "p")
    rows = each.groupBy("sentence_id").agg(F.sum(hit).alias("tp"), F.sum(F.col("p") - hit).alias("fp"), F.sum(F.col("g") - hit).alias("fn"))
    return rows.withColumn("perfect", (F.col("fp") == 0) & (F.col("fn") == 0))


def sequence_levels(pairs: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """Share of sentences whose whole sequences are equal, per level; a null comparison is a miss."""
    hits = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in levels.items()]
    counted = pairs.agg(F.count("*").alias("sentences"), *hits)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("hits")) for n in levels]))
    return counted.select("sentences", stacked.alias("x")).select("x.level", "sentences", "x.hits", F.round(F.coalesce(F.try_divide("x.hits", "sentences"), F.lit(0.0)), 6).alias("share"))


def hit_ranks(gold: DataFrame, paths: DataFrame) -> DataFrame:
    """(sentence_id, hit): the least rank whose path is the gold path, null if none is."""
    g = gold.select("sentence_id", F.col("nodes").alias("g"))
    hit = F.min(F.when(F.col("nodes") == F.col("g"), F.col("rank")))
    return g.join(paths.select("sentence_id", "rank", "nodes"), "sentence_id", "left").groupBy("sentence_id").agg(hit.alias("hit"))


def recall_at(hits: DataFrame, ks: list[int]) -> DataFrame:
    """(k, sentences, hits, recall) for each k: sentences whose gold path is among the first k."""
    counted = hits.agg(F.count("*").alias("sentences"), *[F.count_if(F.col("hit") < k).alias(f"k{k}") for k in ks])
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks]))
    return counted.select("sentences", stacked.alias("x")).select("x.k", "sentences", "x.hits", F.round(F.coalesce(F.try_divide("x.hits", "sentences"), F.lit(0.0)), 6).alias("recall"))


def labelled(gold: DataFrame, paths: DataFrame) -> DataFrame:
    """Candidate paths with ``label``: whether the path is the sentence's gold path."""
    g = gold.select("sentence_id", F.col("nodes").alias("g"))
    return paths.join(g, "sentence_id", "left").withColumn("label", F.coalesce(F.col("nodes") == F.col("g"), F.lit(False))).drop("g")


def pick(candidates: DataFrame, score: Column) -> DataFrame:
    """Per sentence the candidate with the greatest score; of equal scores the least rank."""
    best = F.max_by(F.struct("rank", "nodes"), F.struct(score.alias("s"), (-F.col("rank")).alias("r")))
    return candidates.groupBy("sentence_id").agg(best.alias("b")).select("sentence_id", "b.rank", "b.nodes")


def separable(candidates: DataFrame, key: Column) -> DataFrame:
    """Per sentence with a labelled candidate: whether a key of a right one is no key of a wrong one."""
    keyed = candidates.select("sentence_id", "label", key.alias("k")).where("k is not null").groupBy("sentence_id", "k").agg(F.bool_or("label").alias("ok"), F.bool_or(~F.col("label")).alias("bad"))
    return keyed.groupBy("sentence_id").agg(F.bool_or("ok").alias("any"), F.bool_or(F.col("ok") & ~F.col("bad")).alias("separable")).where("any").drop("any")
