"""Resolution of an annotated word sequence to one connected path of its lattice.

An annotation is a list of places; each place has candidate nodes. A path picks one candidate per
place, starts at a source, follows edges and ends at a sink. Of several ways to reach a candidate
the least predecessor holds, of several ends the least. Passes are tried in order, and the first
that resolves holds:

* exact: only nodes with the annotation's own analysis;
* variant: also nodes with a spelling variant; a place whose candidates are all without edges is
  redirected to wired nodes of the same chunk and surface form;
* widened: every place also takes all wired nodes of the chunk and surface form of a candidate.

A sentence is gathered into one row by one exchange, and an Arrow batch of sentences is one array
program per pass: the candidates of all sentences' places p and p + 1 meet by their edges, and the
places are swept together, so the number of steps is the longest annotation and not the number
of sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSES = ("exact", "variant", "widened")
NODE, EDGE, CANDIDATE, PLACE = range(4)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which row, position) of the ranges [first, first + count)."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Annotations:
    """The annotated sentences of a batch: lattice nodes by number, edges and places."""

    def __init__(self, sentences: int, owner: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray, surface: np.ndarray):
        known = np.unique(np.stack([owner[kind == NODE], a[kind == NODE]]), axis=1)
        self.owner, self.node = known
        self.low = int(self.node.min(initial=0))
        self.span = int(self.node.max(initial=0)) - self.low + 1
        self.keys = self.owner * self.span + (self.node - self.low)
        n = len(self.keys)
        self.group = np.full(n, -1)
        self.group[self._find(owner[kind == NODE], a[kind == NODE])] = surface[kind == NODE]
        u, v = self._find(owner[kind == EDGE], a[kind == EDGE]), self._find(owner[kind == EDGE], b[kind == EDGE])
        links = np.unique(np.stack([u, v])[:, (u >= 0) & (v >= 0)], axis=1)
        self.u, self.v = links
        self.start = np.searchsorted(self.u, np.arange(n + 1))
        has_in, has_out = np.zeros(n, bool), np.zeros(n, bool)
        has_in[self.v], has_out[self.u] = True, True
        self.source, self.sink, self.wired = ~has_in, ~has_out, has_in | has_out
        self.size = np.zeros(sentences, dtype=np.int64)
        np.maximum.at(self.size, owner[kind == PLACE], a[kind == PLACE] + 1)
        self.offset = np.cumsum(self.size) - self.size
        self.places = int(self.size.sum())
        # wired nodes by sentence, chunk and surface
        wired = np.flatnonzero(self.wired)
        order = np.lexsort((wired, self.group[wired], self.owner[wired]))
        self.twins, self.groups = wired[order], int(self.group.max(initial=0)) + 1
        self.twin_keys = self.owner[self.twins] * self.groups + self.group[self.twins]
        here = self._find(owner[kind == CANDIDATE], b[kind == CANDIDATE])
        fits = (here >= 0) & (a[kind == CANDIDATE] >= 0) & (a[kind == CANDIDATE] < self.size[owner[kind == CANDIDATE]])
        self.candidates = np.stack([self.offset[owner[kind == CANDIDATE]] + a[kind == CANDIDATE], here])[:, fits]
        self.exact = surface[kind == CANDIDATE][fits] == 1

    def _find(self, owner: np.ndarray, node: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(node), -1)
        inside = (node >= self.low) & (node < self.low + self.span)
        key = owner * self.span + (node - self.low)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(inside & (self.keys[at] == key), at, -1)

    def _with_twins(self, candidates: np.ndarray) -> np.ndarray:
        """The twins of candidates, at their places."""
        place, node = candidates
        key = self.owner[node] * self.groups + self.group[node]
        low, high = np.searchsorted(self.twin_keys, key, "left"), np.searchsorted(self.twin_keys, key, "right")
        row, at = _spread(low, high - low)
        return np.stack([place[row], self.twins[at]])

    def redirected(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates with places without a wired one moved to its twins, if there are any, and those places' numbers."""
        place, node = candidates
        has_wired, has_twin = np.zeros(self.places, bool), np.zeros(self.places, bool)
        has_wired[place[self.wired[node]]] = True
        alone = candidates[:, ~has_wired[place]]
        twins = self._with_twins(alone)
        has_twin[twins[0]] = True
        return np.unique(np.concatenate([candidates[:, ~has_twin[place]], twins], axis=1), axis=1), np.flatnonzero(has_twin)

    def widened(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates and all their twins, and the places that grew."""
        more = np.unique(np.concatenate([candidates, self._with_twins(candidates)], axis=1), axis=1)
        grown = np.bincount(more[0], minlength=self.places) > np.bincount(candidates[0], minlength=self.places)
        return more, np.flatnonzero(grown)

    def connect(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, path of node numbers) of the sentences that resolve, paths one after another in place order."""
        place, node = candidates  # unique and sorted by place, then node
        m = len(node)
        owner = self.owner[node] if m else np.zeros(0, dtype=np.int64)
        within = place - self.offset[owner]
        # candidates of consecutive places that an edge links
        row, at = _spread(self.start[node], self.start[node + 1] - self.start[node]) if m else (np.zeros(0, dtype=np.int64),) * 2
        follows = within[row] + 1 < self.size[owner[row]]
        row, at = row[follows], at[follows]
        width = len(self.keys) + 1
        key, want = place * width + node, (place[row] + 1) * width + self.v[at]
        to = np.minimum(np.searchsorted(key, want), max(m - 1, 0))
        hit = key[to] == want if m else np.zeros(0, bool)
        row, to = row[hit], to[hit]
        reached, back = (within == 0) & self.source[node], np.full(m, m)
        order = np.argsort(within[to], kind="stable")
        row, to = row[order], to[order]
        bounds = np.searchsorted(within[to], np.arange(1, int(within.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            live = reached[row[a:b]]
            np.minimum.at(back, to[a:b][live], row[a:b][live])  # numbers at a place go by node
            reached[to[a:b][live]] = True
        end = np.flatnonzero(reached & self.sink[node] & (within == self.size[owner] - 1))
        sentence, first = np.unique(owner[end], return_index=True)
        steps, cur = [], end[first]
        left = within[cur].copy()
        while len(cur) and (left >= 0).any():
            live = left >= 0
            steps.append(np.where(live, cur, -1))
            cur = np.where(left > 0, back[np.minimum(cur, m - 1)], cur)
            left = left - 1
        grid = np.array(steps[::-1]).T if steps else np.zeros((0, 0), dtype=np.int64)
        return sentence, node[grid[grid >= 0]] if grid.size else np.zeros(0, dtype=np.int64)

    def resolve(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per sentence (pass number or 3, redirected, widened, path lengths) and the paths' nodes, in sentence order."""
        by, redirected, widened = (np.full(len(self.size), x) for x in (3, 0, 0))
        place_owner = np.repeat(np.arange(len(self.size)), self.size)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        candidates = np.unique(self.candidates[:, self.exact], axis=1)
        every = np.unique(self.candidates, axis=1)
        for i in range(len(PASSES)):
            if i:
                open_ = by == 3
                source = every if i == 1 else candidates
                source = source[:, open_[place_owner[source[0]]]]
                candidates, places = (self.redirected if i == 1 else self.widened)(source)
                count = np.bincount(place_owner[places], minlength=len(self.size))
                if i == 1:
                    redirected = count
                else:
                    widened = count
            sentence, path = self.connect(candidates)
            by[sentence] = i
            found.append((np.repeat(sentence, self.size[sentence]), path))
        owner, path = (np.concatenate([f[j] for f in found]) for j in range(2))
        order = np.argsort(owner, kind="stable")
        return by, redirected, widened, np.bincount(owner, minlength=len(self.size)), self.node[path[order]]


def _resolve(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column(1)
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        ints = lambda i: flat.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        kind, a, b, chunk = (ints(i) for i in range(4))
        names = pc.dictionary_encode(pc.fill_null(flat.field(4).cast(pa.string()), "\0")).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a surface is a chunk and a form; a candidate's is whether it is exact
        pairs = np.unique(np.stack([chunk, names]), axis=1, return_inverse=True)[1].ravel() if len(kind) else names
        surface = np.where(kind == CANDIDATE, chunk, pairs)
        by, redirected, widened, size, nodes = Annotations(batch.num_rows, np.repeat(np.arange(batch.num_rows), lengths), kind, a, b, surface).resolve()
        arrays = [
            batch.column(0), pa.array(np.array([*PASSES, "none"])[by]),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(nodes.astype(np.int32))),
            pa.array(redirected.astype(np.int32)), pa.array(widened.astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["sentence_id", "resolved_by", "nodes", "redirected", "widened"])


def resolve(annotations: DataFrame, candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sentence_id, resolved_by, nodes, redirected, widened) of every annotated sentence.

    annotations (sentence_id, place), places from 0 without gaps; candidates (sentence_id, place,
    node, exact); nodes (sentence_id, node, chunk, surface); edges (sentence_id, src, dst). A
    place without candidates leaves its sentence unresolved (pass none, no nodes). Repeated rows
    change nothing; edges and candidates of unknown nodes are none; null surfaces are alike.
    ``redirected`` and ``widened`` count places in the passes that were tried.
    """
    none = F.lit(None).cast("string")
    row = lambda df, kind, a, b, c, s: df.where("sentence_id is not null").select(
        "sentence_id", F.struct(F.lit(kind).alias("kind"), *[x.cast("int").alias(n) for n, x in (("a", a), ("b", b), ("c", c))], s.alias("s")).alias("x")
    )
    zero = F.lit(0)
    rows = row(nodes, NODE, F.col("node"), zero, F.col("chunk"), F.col("surface").cast("string"))
    rows = rows.unionByName(row(edges, EDGE, F.col("src"), F.col("dst"), zero, none))
    rows = rows.unionByName(row(candidates, CANDIDATE, F.col("place"), F.col("node"), F.col("exact"), none))
    rows = rows.unionByName(row(annotations, PLACE, F.col("place"), zero, zero, none))
    schema = T.StructType(
        [
            T.StructField("sentence_id", annotations.schema["sentence_id"].dataType), T.StructField("resolved_by", T.StringType()),
            T.StructField("nodes", T.ArrayType(T.IntegerType())), T.StructField("redirected", T.IntegerType()), T.StructField("widened", T.IntegerType()),
        ]
    )
    gathered = rows.repartition("sentence_id").groupBy("sentence_id").agg(F.collect_list("x").alias("x"))
    return gathered.where(F.exists("x", lambda x: x["kind"] == PLACE)).mapInArrow(_resolve, schema)
