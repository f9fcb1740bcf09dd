"""Level-synchronous dynamic programs over many lattices at once.

Nodes and edges of a sentence are gathered into one row (a sentence has hundreds of nodes at
most), and an Arrow batch of sentences is one array program: all edges into one level of all
sentences of the batch are relaxed together, so the number of steps is the depth of the deepest
sentence and not the number of nodes.

Programs: ``levels`` (longest path), ``counts`` (paths up to a node, saturated at K) and ``kbest``
(exact K best paths). In ``kbest`` a node keeps its K best partial paths, ordered by score
descending, then parent node ascending (or edge id ascending), then the parent's rank ascending;
back-pointers give the paths. Sums are exact for integer weights below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CYCLE = -1
#: candidates (edges times places of a beam) that are worked on together; one sentence may have more
BATCH_CANDIDATES = 3_000_000


class Batch:
    """The nodes and edges of a batch of sentences, renumbered densely."""

    def __init__(self, owner: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, edge: np.ndarray, is_edge: np.ndarray):
        node_owner, node = owner[~is_edge], src[~is_edge]
        order = np.lexsort((node, node_owner))
        node_owner, node = node_owner[order], node[order]
        fresh = np.r_[True, (node_owner[1:] != node_owner[:-1]) | (node[1:] != node[:-1])] if len(node) else np.zeros(0, bool)
        self.owner, self.node = node_owner[fresh], node[fresh]
        self.base = int(node.min(initial=0))
        self.span = int(node.max(initial=0)) - self.base + 1
        self.keys = self.owner * self.span + (self.node - self.base)
        e_owner = owner[is_edge]
        u, v = self._find(e_owner, src[is_edge]), self._find(e_owner, dst[is_edge])
        known = (u >= 0) & (v >= 0)
        self.u, self.v, self.weight, self.edge = u[known], v[known], weight[is_edge][known], edge[is_edge][known]
        self.level = self._levels()

    def _find(self, owner: np.ndarray, node: np.ndarray) -> np.ndarray:
        inside = (node >= self.base) & (node < self.base + self.span)
        key = owner * self.span + (node - self.base)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(inside & (self.keys[at] == key), at, -1) if len(self.keys) else np.full(len(node), -1)

    def _levels(self) -> np.ndarray:
        """Longest path from a source, by peeling; CYCLE for all nodes of a sentence with a cycle."""
        n = len(self.node)
        level = np.zeros(n, dtype=np.int64)
        waiting = np.bincount(self.v, minlength=n) if len(self.v) else np.zeros(n, dtype=np.int64)
        order = np.argsort(self.u, kind="stable")
        start = np.searchsorted(self.u[order], np.arange(n + 1))
        ready, done = np.flatnonzero(waiting == 0), 0
        while len(ready):
            done += len(ready)
            count = start[ready + 1] - start[ready]
            e = order[np.repeat(start[ready] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
            if not len(e):
                break
            np.maximum.at(level, self.v[e], level[self.u[e]] + 1)
            np.subtract.at(waiting, self.v[e], 1)
            touched = np.unique(self.v[e])
            ready = touched[waiting[touched] == 0]
        if (waiting > 0).any():
            bad = np.unique(self.owner[waiting > 0])
            level[np.isin(self.owner, bad)] = CYCLE
        return level

    def by_level(self) -> Iterator[np.ndarray]:
        """The edges into each level, lowest first, sorted by their destination."""
        to = self.level[self.v]
        order = np.lexsort((self.v, to))
        order = order[to[order] > 0]
        bounds = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0, True]) if len(order) else np.array([0])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield order[a:b]

    def counts(self, most: int) -> np.ndarray:
        """Paths from a source to each node, at most ``most``; 0 in a sentence with a cycle."""
        out = ((self.level == 0) & (np.bincount(self.v, minlength=len(self.node)) == 0)).astype(np.int64)
        for e in self.by_level():
            np.add.at(out, self.v[e], out[self.u[e]])
            hit = np.unique(self.v[e])
            out[hit] = np.minimum(out[hit], most)
        return out

    def beams(self, k: int, tie: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, parent, parent rank) of the k best partial paths of each node."""
        n = len(self.node)
        score = np.full((n, k), -np.inf)
        parent = np.full((n, k), -1, dtype=np.int64)
        rank = np.full((n, k), -1, dtype=np.int64)
        score[(self.level == 0), 0] = 0.0
        for e in self.by_level():
            cand = (score[self.u[e]] + self.weight[e, None]).ravel()
            dst, src = np.repeat(self.v[e], k), np.repeat(self.u[e], k)
            first = src if tie == "parent" else np.repeat(self.edge[e], k)
            r = np.tile(np.arange(k), len(e))
            live = np.isfinite(cand)
            cand, dst, src, first, r = cand[live], dst[live], src[live], first[live], r[live]
            order = np.lexsort((r, first, -cand, dst))
            d = dst[order]
            lead = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            place = np.arange(len(d)) - np.repeat(lead, np.diff(np.r_[lead, len(d)]))
            keep = place < k
            order, place = order[keep], place[keep]
            score[dst[order], place], parent[dst[order], place], rank[dst[order], place] = cand[order], src[order], r[order]
        return score, parent, rank

    def paths(self, k: int, tie: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, rank, score, offsets, nodes) of the k best complete paths of each sentence."""
        score, parent, rank = self.beams(k, tie)
        sink = np.flatnonzero((np.bincount(self.u, minlength=len(self.node)) == 0) & (self.level >= 0))
        node, place = np.repeat(sink, k), np.tile(np.arange(k), len(sink))
        live = np.isfinite(score[node, place])
        node, place = node[live], place[live]
        owner, total = self.owner[node], score[node, place]
        order = np.lexsort((place, node, -total, owner))
        o = owner[order]
        lead = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(o)) - np.repeat(lead, np.diff(np.r_[lead, len(o)]))
        order, nth = order[nth < k], nth[nth < k]
        node, place, owner, total = node[order], place[order], owner[order], total[order]
        steps = []
        at, r = node.copy(), place.copy()
        while (at >= 0).any():
            steps.append(np.where(at >= 0, self.node[at], np.iinfo(np.int64).min))
            inside = at >= 0
            up = np.where(inside, parent[at, r], -1)
            r = np.where(inside & (up >= 0), rank[at, r], 0)
            at = up
        grid = np.array(steps[::-1]).T if steps else np.zeros((0, 0), dtype=np.int64)
        valid = grid != np.iinfo(np.int64).min
        offsets = np.r_[0, np.cumsum(valid.sum(axis=1))] if len(grid) else np.zeros(1, dtype=np.int64)
        return owner, nth, total, offsets, grid[valid]


def _batch(column, n: int) -> Batch:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    src, dst, w, e = (flat.field(i) for i in range(4))
    is_edge = dst.is_valid().to_numpy(zero_copy_only=False)
    ints = lambda a: a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return Batch(np.repeat(np.arange(n), lengths), ints(src), ints(dst), w.fill_null(0.0).to_numpy(zero_copy_only=False), ints(e), is_edge)


def _level_batch(column, n: int) -> Batch:
    """Nodes (node, level, w) of whole lattices: every node is linked to all of the next level."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    node, level, w = (flat.field(i) for i in range(3))
    placed = level.is_valid().to_numpy(zero_copy_only=False)
    ints = lambda a: a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return linked(np.repeat(np.arange(n), lengths), ints(node), ints(level), placed, w.fill_null(0.0).to_numpy(zero_copy_only=False))


def linked(owner: np.ndarray, node: np.ndarray, level: np.ndarray, placed: np.ndarray, w: np.ndarray) -> Batch:
    """The lattices in which every node that has a place is linked to all of the next level; an edge weighs what its end does."""
    order = np.lexsort((node, level, owner))
    order = order[placed[order]]
    o, v, lv = owner[order], node[order], level[order]
    fresh = np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1]) | (lv[1:] != lv[:-1])] if len(o) else np.zeros(0, bool)
    order, o, v, lv = order[fresh], o[fresh], v[fresh], lv[fresh]
    start = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (lv[1:] != lv[:-1])]) if len(o) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[start, len(o)])
    follows = np.r_[(o[start[1:]] == o[start[:-1]]) & (lv[start[1:]] == lv[start[:-1]] + 1), False] if len(start) else np.zeros(0, bool)
    fan = np.repeat(np.where(follows, np.r_[size[1:], 0][: len(size)], 0), size)
    first = np.repeat(np.r_[start[1:], 0][: len(start)], size)
    src = np.repeat(np.arange(len(o)), fan)
    dst = np.repeat(first, fan) + np.arange(len(src)) - np.repeat(np.cumsum(fan) - fan, fan)
    all_owner, all_src, all_dst = np.r_[owner, o[src]], np.r_[node, v[src]], np.r_[np.zeros(len(node), dtype=np.int64), v[dst]]
    weight, edge = np.r_[np.zeros(len(node)), w[order][dst]], np.r_[np.zeros(len(node), dtype=np.int64), np.arange(len(src))]
    return Batch(all_owner, all_src, all_dst, weight, edge, np.r_[np.zeros(len(node), bool), np.ones(len(src), bool)])


def _edge_numbers(column, n: int, build) -> np.ndarray:
    """How many edges each row brings at most."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if build is _batch:
        return lengths
    level = column.flatten().field(1).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64)
    base, span = level.min(initial=0), level.max(initial=0) - level.min(initial=0) + 2
    key, size = np.unique(np.repeat(np.arange(n), lengths) * span + level - base, return_counts=True)
    linked = np.flatnonzero(key[1:] == key[:-1] + 1)
    return lengths + np.bincount(key[linked] // span, weights=size[linked] * size[linked + 1], minlength=n).astype(np.int64)


def _cut(batch, k: int, build) -> Iterator:
    """The batch in slices of whole sentences of about BATCH_CANDIDATES candidates."""
    work = np.cumsum(_edge_numbers(batch.column(1), batch.num_rows, build) * k)
    start = 0
    while start < batch.num_rows:
        done = work[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(work, done + BATCH_CANDIDATES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _run(batches: Iterator, program: str, k: int, tie: str, build=_batch) -> Iterator:
    import pyarrow as pa

    for batch in (part for whole in batches for part in _cut(whole, k if program == "kbest" else 1, build)):
        sid = batch.column(0)
        b = build(batch.column(1), batch.num_rows)
        if program == "kbest":
            owner, rank, score, offsets, nodes = b.paths(k, tie)
            arrays = [
                sid.take(pa.array(owner)), pa.array(rank.astype(np.int32)), pa.array(score),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(nodes.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["sentence_id", "rank", "score", "nodes"])
            continue
        who = [sid.take(pa.array(b.owner)), pa.array(b.node.astype(np.int32))]
        value = b.level if program == "levels" else b.counts(k)
        out = pa.array(value.astype(np.int32), mask=b.level == CYCLE)
        yield pa.RecordBatch.from_arrays([*who, out], names=["sentence_id", "node_id", "level" if program == "levels" else "paths"])


def sweep(nodes: DataFrame, edges: DataFrame, program: str, k: int = 1, tie: str = "parent") -> DataFrame:
    """Run a program over the lattices of (sentence_id, node_id) and (sentence_id, src, dst, w).

    Edges to unknown nodes are left out; repeated nodes are one, repeated edges are parallel paths.
    A null or missing weight counts as 0. A sentence with a cycle has null levels and counts and no paths. A
    sentence with several sinks has the best paths over all of them. ``edge_id`` is read where the
    tie-break is by edge. One exchange, on the sentence.
    """
    if tie not in ("parent", "edge"):
        raise ValueError(f"unknown tie-break {tie!r}; known: parent, edge")
    edge_id = F.col("edge_id").cast("long") if tie == "edge" else F.lit(0).cast("long")
    if "w" not in edges.columns:
        edges = edges.withColumn("w", F.lit(0.0))
    e = edges.select("sentence_id", F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("w").cast("double").alias("w"), edge_id.alias("e")).alias("x"))
    empty = F.struct(F.col("node_id").cast("int").alias("src"), F.lit(None).cast("int").alias("dst"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("long").alias("e"))
    rows = nodes.where("sentence_id is not null and node_id is not null").select("sentence_id", empty.alias("x")).unionByName(e.where("sentence_id is not null"))
    lattice = rows.repartition("sentence_id").groupBy("sentence_id").agg(F.collect_list("x").alias("x"))
    return lattice.mapInArrow(lambda b: _run(b, program, k, tie), _schema(nodes, program))


def row_sweep(rows: DataFrame, program: str, k: int = 1) -> DataFrame:
    """A program over lattices whose nodes and edges are rows of one table (sentence_id, src, dst, w).

    A row without ``dst`` is the node ``src``. The same rows as ``sweep``, but what lies by sentence
    already is gathered where it is.
    """
    x = F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("w").cast("double").alias("w"), F.lit(0).cast("long").alias("e"))
    lattice = rows.where("sentence_id is not null and src is not null").groupBy("sentence_id").agg(F.collect_list(x).alias("x"))
    return lattice.mapInArrow(lambda b: _run(b, program, k, "parent"), _schema(rows, program))


def _schema(nodes: DataFrame, program: str) -> T.StructType:
    fields = [T.StructField("sentence_id", nodes.schema["sentence_id"].dataType)]
    if program == "kbest":
        fields += [T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("nodes", T.ArrayType(T.IntegerType()))]
    else:
        fields += [T.StructField("node_id", T.IntegerType()), T.StructField("level" if program == "levels" else "paths", T.IntegerType())]
    return T.StructType(fields)


def level_sweep(nodes: DataFrame, weight: Column, program: str, k: int = 1) -> DataFrame:
    """A program over lattices whose consecutive levels are fully linked, without an edge table.

    ``nodes`` has (sentence_id, node_id, topo_level) and whatever ``weight`` reads; an edge weighs
    what its destination does. The same rows as ``sweep`` over ``level_edges`` and those weights,
    but the nodes are scanned and exchanged once and edges exist only inside a batch. Repeated rows
    are one node; a node without a level has no edges.
    """
    x = F.struct(F.col("node_id").cast("int").alias("node"), F.col("topo_level").cast("int").alias("level"), weight.cast("double").alias("w"))
    rows = nodes.where("sentence_id is not null and node_id is not null").select("sentence_id", x.alias("x"))
    return rows.groupBy("sentence_id").agg(F.collect_list("x").alias("x")).mapInArrow(lambda b: _run(b, program, k, "parent", _level_batch), _schema(nodes, program))


def kbest(nodes: DataFrame, edges: DataFrame, k: int, tie: str = "parent") -> DataFrame:
    """(sentence_id, rank, score, nodes): the K best paths by the sum of their edges' ``w``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return sweep(nodes, edges, "kbest", k, tie)


def path_counts(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(sentence_id, node_id, paths): paths from the sources to each node, saturated at K."""
    return sweep(nodes, edges, "counts", k)


def keep_histogram(counts: DataFrame, k: int) -> DataFrame:
    """(keep, num_nodes) for keep from 0 to K, zeros included."""
    spine = counts.sparkSession.range(0, k + 1).select(F.col("id").cast("int").alias("keep"), F.lit(0).alias("n"))
    have = counts.select(F.least(F.col("paths"), F.lit(k)).alias("keep"), F.lit(1).alias("n")).where("keep is not null")
    return spine.unionByName(have).groupBy("keep").agg(F.sum("n").cast("long").alias("num_nodes"))
