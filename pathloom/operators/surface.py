"""Reconstruction of a sentence's surface text from its candidate words.

Every candidate votes for the characters it covers: weight 4 where its spelling is as long as its
span, else 1. A character's winner is the one with most weight, of equals the first seen in node
order. A position that a declared span covers but no candidate spells is '?'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXACT, PREFIX = 4, 1


def votes(nodes: DataFrame) -> DataFrame:
    """(sentence_id, chunk, pos, ch, weight, first) from (sentence_id, node_id, chunk, position, length, word)."""
    word = F.coalesce("word", F.lit(""))
    spelled = nodes.where("chunk is not null and position is not null and length is not null").withColumn("word", word)
    spelled = spelled.withColumn("w", F.when(F.length("word") == F.col("length"), EXACT).otherwise(PREFIX))
    letters = F.posexplode(F.filter(F.split(F.left("word", F.greatest("length", F.lit(0))), ""), lambda c: c != "")).alias("i", "ch")
    each = spelled.select("sentence_id", "chunk", "node_id", "position", "w", letters)
    return each.groupBy("sentence_id", "chunk", (F.col("position") + F.col("i")).alias("pos"), "ch").agg(F.sum("w").alias("weight"), F.min(F.struct("node_id", "i")).alias("first"))


def winners(nodes: DataFrame) -> DataFrame:
    """(sentence_id, chunk, pos, ch): the winning character of every voted position."""
    v = votes(nodes)
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("first"), F.col("ch"))).alias("b")
    return v.groupBy("sentence_id", "chunk", "pos").agg(best, F.count("*").alias("kinds")).select("sentence_id", "chunk", "pos", F.col("b.ch").alias("ch"), "kinds")


def extents(nodes: DataFrame) -> DataFrame:
    """(sentence_id, chunk, width): how far the chunk's candidates reach."""
    return nodes.groupBy("sentence_id", "chunk").agg(F.max(F.col("position") + F.col("length")).alias("width"))


def chunk_texts(nodes: DataFrame) -> DataFrame:
    """(sentence_id, chunk, text) with holes as '?'; positions below 0 are outside the text."""
    w = winners(nodes).where("pos >= 0")
    known = w.groupBy("sentence_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ch"))).alias("m"), (F.max("pos") + 1).alias("last"))
    wide = extents(nodes).join(known, ["sentence_id", "chunk"], "left")
    width = F.greatest(F.col("width"), F.coalesce("last", F.lit(0)), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    text = F.array_join(F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit("?"))), "")
    return wide.select("sentence_id", "chunk", text.alias("text"))


def chunk_starts(texts: DataFrame) -> DataFrame:
    """(sentence_id, chunk, start): offsets of the chunks when they are joined by single spaces."""
    w = W.partitionBy("sentence_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return texts.select("sentence_id", "chunk", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("start"))


def sentence_texts(texts: DataFrame) -> DataFrame:
    """(sentence_id, text): the chunks in order, joined by single spaces."""
    x = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    return texts.groupBy("sentence_id").agg(x.alias("x")).select("sentence_id", F.array_join("x.text", " ").alias("text"))


def vote_stats(nodes: DataFrame) -> DataFrame:
    """One row: positions, positions with more than one character, holes within the extents."""
    w = winners(nodes).agg(F.count("*").alias("positions"), F.count_if(F.col("kinds") > 1).alias("ambiguous"))
    holes = chunk_texts(nodes).agg(F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))), F.lit(0)).alias("holes"))
    return w.select("positions", "ambiguous", holes.scalar().alias("holes"))
