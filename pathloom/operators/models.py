"""Linear learners over explicit edge tables, for any lattice, and the plain parts of the recurrent ones.

Log-linear scorers and rerankers are trained by gradient sums over all given rows: what travels is
one vector of weights per epoch. Lattices whose levels are fully linked have ``training`` instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sweep import kbest

# -- embeddings ------------------------------------------------------------------------------


def seeded_table(rows: int, width: int, seed: int) -> np.ndarray:
    """A random table with unit variance over the width; row 0 (padding, boundary) is zero."""
    table = np.random.default_rng(seed).normal(0, 1 / np.sqrt(width), (rows, width)).astype(np.float32)
    if rows:
        table[0] = 0
    return table


# -- character encoder -----------------------------------------------------------------------


def lstm_parameters(inputs: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights of one direction; gates in the order input, forget, cell, output."""
    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(hidden)
    return {"wx": rng.uniform(-bound, bound, (inputs, 4 * hidden)), "wh": rng.uniform(-bound, bound, (hidden, 4 * hidden)), "b": np.zeros(4 * hidden)}


def lstm(x: np.ndarray, lengths: np.ndarray, p: dict[str, np.ndarray], reverse: bool = False) -> np.ndarray:
    """Hidden states [batch, time, hidden] of padded rows; positions past a row's length are 0."""
    batch, steps, _ = x.shape
    hidden = p["wh"].shape[0]
    h, c, out = np.zeros((batch, hidden)), np.zeros((batch, hidden)), np.zeros((batch, steps, hidden))
    projected = x @ p["wx"] + p["b"]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        z = projected[:, t] + h @ p["wh"]
        i, f, g, o = np.split(z, 4, axis=1)
        live = (t < lengths)[:, None]
        c = np.where(live, sigmoid(f) * c + sigmoid(i) * np.tanh(g), c)
        h = np.where(live, sigmoid(o) * np.tanh(c), h)
        out[:, t] = np.where(live, h, 0)
    return out


# -- structured training ---------------------------------------------------------------------


def _vector_sum(rows: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """The sum of the column ``x`` and the number of rows; one row goes to the driver."""
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("double")).alias(f"s{i}") for i in range(width)]).first()
    return np.array([sums[f"s{i}"] or 0.0 for i in range(width)]), int(sums["n"])


def path_features(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per node of the paths (sentence_id, nodes) with its vector."""
    return paths.select("sentence_id", F.explode("nodes").alias("node_id")).join(vectors, ["sentence_id", "node_id"]).select("x")


def node_scores(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """(sentence_id, node_id, s): a fixed weight vector times each node's vector."""
    s = sum((F.col("x")[i].cast("double") * float(v) for i, v in enumerate(weights) if v), F.lit(0.0))
    return vectors.select("sentence_id", "node_id", s.alias("s"))


def train_structured(nodes: DataFrame, edges: DataFrame, gold: DataFrame, vectors: DataFrame, width: int, epochs: int = 3, rate: float = 0.5, margin: float = 1.0) -> tuple[np.ndarray, list[dict[str, float]]]:
    """Weights of a log-linear scorer by the structured hinge loss, averaged over the epochs.

    Every epoch decodes all training sentences with each wrong node's score raised by the margin
    and moves the weights from the decoded paths' features to the gold paths'. Sentences whose
    gold nodes are not a path still count by their features. Adaptive steps per weight (AdaGrad).
    ``gold`` is (sentence_id, nodes). Returns the weights and a log of (epoch, wrong, gradient).
    """
    weights, seen, total, log = np.zeros(width), np.zeros(width), np.zeros(width), []
    right = gold.select("sentence_id", F.explode("nodes").alias("node_id"), F.lit(1.0).alias("right"))
    target, _ = _vector_sum(path_features(gold, vectors), width)
    sentences = max(gold.count(), 1)
    inside = nodes.join(gold.select("sentence_id"), "sentence_id", "left_semi")
    links = edges.join(gold.select("sentence_id"), "sentence_id", "left_semi")
    for epoch in range(epochs):
        scored = node_scores(vectors, weights).join(right, ["sentence_id", "node_id"], "left")
        w = scored.select("sentence_id", F.col("node_id").alias("dst"), (F.col("s") + F.when(F.col("right").isNull(), margin).otherwise(0.0)).alias("w"))
        best = kbest(inside, links.join(w, ["sentence_id", "dst"], "left"), 1).select("sentence_id", "nodes")
        found, n = _vector_sum(path_features(best, vectors), width)
        gradient = (found - target) / sentences
        seen += gradient**2
        weights = weights - rate * gradient / np.sqrt(seen + 1e-12)
        total += weights
        log.append({"epoch": epoch, "nodes": float(n), "gradient": float(np.abs(gradient).sum())})
    return total / max(epochs, 1), log


# -- reranking -------------------------------------------------------------------------------


def listwise(scores: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log of the right candidates' share of the softmax, and its gradient by score."""
    e = np.exp(scores - scores.max())
    p = e / e.sum()
    right = float(p[labels].sum())
    return -float(np.log(max(right, 1e-300))), p - np.where(labels, p / max(right, 1e-300), 0.0)


def train_reranker(candidates: DataFrame, width: int, epochs: int = 5, rate: float = 0.5) -> tuple[np.ndarray, list[float]]:
    """Weights of a linear reranker over candidate features, by the listwise loss.

    ``candidates`` is (sentence_id, rank, score, label, x). The score is base + w . x with w 0 at
    first, so training starts as the base decoder. Sentences without a right candidate teach
    nothing. Per epoch every task sends one gradient row.
    """
    grouped = candidates.groupBy("sentence_id").agg(F.collect_list(F.struct(F.col("score").cast("double").alias("score"), "label", F.col("x").cast("array<double>").alias("x"))).alias("c"))
    weights, seen, losses = np.zeros(width), np.zeros(width), []
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
    for _ in range(epochs):

        def run(batches: Iterator, weights: np.ndarray = weights) -> Iterator:
            import pyarrow as pa

            n, loss, gradient = 0, 0.0, np.zeros(width)
            for batch in batches:
                for cands in batch.column(0).to_pylist():
                    labels = np.array([c["label"] for c in cands], dtype=bool)
                    if not labels.any():
                        continue
                    x = np.array([c["x"] for c in cands])
                    one, g = listwise(np.array([c["score"] for c in cands]) + x @ weights, labels)
                    n, loss, gradient = n + 1, loss + one, gradient + g @ x
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([gradient.tolist()])], names=["n", "loss", "g"])

        sums = grouped.select("c").mapInArrow(run, schema)
        row = sums.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), *[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(width)]).first()
        count = max(int(row["n"] or 0), 1)
        gradient = np.array([row[f"g{i}"] or 0.0 for i in range(width)]) / count
        losses.append(float(row["loss"] or 0.0) / count)
        seen += gradient**2
        weights = weights - rate * gradient / np.sqrt(seen + 1e-12)
    return weights, losses


def rerank(candidates: DataFrame, weights: np.ndarray) -> DataFrame:
    """Candidates with ``new_score``: base + w . x."""
    bonus = sum((F.col("x")[i].cast("double") * float(v) for i, v in enumerate(weights)), F.lit(0.0))
    return candidates.withColumn("new_score", F.col("score") + bonus)
