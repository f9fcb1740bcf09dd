"""Edge scorers and the gold path's edges.

A scorer turns edges (sentence_id, src, dst, ...) into the same edges with a double column ``w``.
Node vectors are (sentence_id, node_id, x array<double>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(edges: DataFrame) -> DataFrame:
    """Every edge scores 1."""
    return edges.withColumn("w", F.lit(1.0))


def length(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The natural logarithm of one plus the destination's length; null length, null score."""
    w = nodes.select("sentence_id", F.col("node_id").alias("dst"), F.log1p(F.col("length").cast("double")).alias("w"))
    return edges.join(w, ["sentence_id", "dst"])


def _dot(x: Column, weights: list[float]) -> Column:
    """A fixed weight vector times a column vector, unrolled so that it stays in generated code."""
    return sum((x[i] * F.lit(float(v)) for i, v in enumerate(weights) if v), F.lit(0.0))


def _checked(vectors: DataFrame, width: int) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit(f"feature width differs from {width}: "), F.size("x").cast("string")))
    return vectors.withColumn("x", F.when(F.size("x") == width, F.col("x")).otherwise(wrong.cast("array<double>")))


def log_linear(vectors: DataFrame, edges: DataFrame, weights: list[float], bias: float = 0.0) -> DataFrame:
    """bias + w . x(destination); a vector of another width is an error. Computed once per node."""
    per_node = _checked(vectors, len(weights)).select("sentence_id", F.col("node_id").alias("dst"), (F.lit(float(bias)) + _dot(F.col("x"), weights)).alias("w"))
    return edges.join(per_node, ["sentence_id", "dst"])


def _projected(vectors: DataFrame, source: list[list[float]], destination: list[list[float]]) -> DataFrame:
    """Each node projected once: ``s`` as the source of an edge, ``d`` as its destination."""
    if len(source) != len(destination) or len({len(r) for r in [*source, *destination]}) != 1:
        raise ValueError("the two matrices must have the same shape")
    both = {"s": F.array(*[_dot(F.col("x"), r) for r in source]), "d": F.array(*[_dot(F.col("x"), r) for r in destination])}
    return _checked(vectors, len(source[0])).withColumns(both).drop("x")


def _inner(s: Column, d: Column, rank: int, bias: float) -> Column:
    return sum((s[i] * d[i] for i in range(rank)), F.lit(0.0)) + F.lit(float(bias))


def biaffine(vectors: DataFrame, edges: DataFrame, source: list[list[float]], destination: list[list[float]], bias: float = 0.0) -> DataFrame:
    """<S x(src), D x(dst)> + bias. Each node is projected once, before the edges are joined."""
    projected = _projected(vectors.select("sentence_id", "node_id", "x"), source, destination)
    left = projected.select("sentence_id", F.col("node_id").alias("src"), "s")
    right = projected.select("sentence_id", F.col("node_id").alias("dst"), "d")
    w = _inner(F.col("s"), F.col("d"), len(source), bias)
    return edges.join(left, ["sentence_id", "src"]).join(right, ["sentence_id", "dst"]).withColumn("w", w).drop("s", "d")


def biaffine_levels(nodes: DataFrame, source: list[list[float]], destination: list[list[float]], bias: float = 0.0) -> DataFrame:
    """(sentence_id, src, dst, w): ``biaffine`` over all edges between consecutive levels, and a row without ``dst`` for each node.

    ``nodes`` has (sentence_id, node_id, topo_level, x), each node once. A node finds the next level's in a window over
    its sentence, so edges become rows where their nodes lie: no table of nodes is joined, and none can be broadcast.
    """
    projected = _projected(nodes.select("sentence_id", "node_id", "topo_level", "x"), source, destination)
    ahead = F.collect_list(F.struct("node_id", "d")).over(W.partitionBy("sentence_id").orderBy("topo_level").rangeBetween(1, 1))
    met = projected.withColumn("ahead", F.when(F.col("topo_level").isNotNull(), ahead).otherwise(F.array()))
    pairs = met.select("sentence_id", F.col("node_id").alias("src"), "s", F.explode(F.concat(F.array(F.lit(None)), "ahead")).alias("b"))
    return pairs.select("sentence_id", "src", F.col("b.node_id").alias("dst"), _inner(F.col("s"), F.col("b.d"), len(source), bias).alias("w"))


def gold_pairs(nodes: DataFrame) -> DataFrame:
    """(sentence_id, src, dst): consecutive gold nodes in topological order."""
    w = W.partitionBy("sentence_id").orderBy("topo_level", "node_id")
    pairs = nodes.where("is_gold").select("sentence_id", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"))
    return pairs.where("dst is not null")


def gold_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sentence_id, src, dst, edge_id) of the gold path; a sentence with a missing edge is dropped whole."""
    linked = gold_pairs(nodes).join(edges.select("sentence_id", "src", "dst", "edge_id"), ["sentence_id", "src", "dst"], "left")
    whole = F.bool_and(F.col("edge_id").isNotNull()).over(W.partitionBy("sentence_id"))
    return linked.withColumn("whole", whole).where("whole").drop("whole")


def gold_score(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """(sentence_id, score, n_edges) of the gold paths whose edges all exist."""
    linked = gold_pairs(nodes).join(scored.select("sentence_id", "src", "dst", "edge_id", "w"), ["sentence_id", "src", "dst"], "left")
    return linked.groupBy("sentence_id").agg(F.sum("w").alias("score"), F.count("*").alias("n_edges"), F.count("edge_id").alias("found")).where("n_edges = found").drop("found")
