"""Trained scorers of lattices: a bilinear scorer over dense features, embeddings and a character encoder; a path reranker.

A sentence is one stored row of nodes with their features, so an epoch exchanges nothing but weights.
Every task runs AdamW over its own sentences in small batches from the common weights, and the
weights of all tasks are averaged by sentences (iterative parameter mixing); blocks of weights are
summed where they lie, and the driver holds one model. Weights after the epoch that is best on
the dev split hold. NumPy does the arithmetic; gradients are written out and checked numerically.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .models import lstm_parameters, seeded_table
from .sweep import Batch, linked

IDS = ("form", "lemma", "preverb", "tag")
UNKNOWN = 1
BLOCK = 4_096
Params = dict[str, np.ndarray]


# -- rows ----------------------------------------------------------------------------------------


def packed(nodes: DataFrame, vectors: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(sentence_id, split, text, nodes): one row per lattice with all that training reads.

    nodes (sentence_id, node_id, topo_level, is_gold, chunk, char_start, length, form_id, lemma_id,
    preverb_id, tag_id, split); vectors (sentence_id, node_id, x); texts (sentence_id, text). One
    exchange on the sentence; nodes without a level are left out. Without vectors x is the nodes' own, or empty.
    """
    rows = nodes.where("topo_level is not null")
    if vectors is not None:
        rows = rows.join(vectors, ["sentence_id", "node_id"])
    elif "x" not in rows.columns:
        rows = rows.withColumn("x", F.array().cast("array<float>"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    node = F.struct(
        F.col("node_id").cast("int").alias("node"), F.col("topo_level").cast("int").alias("level"), F.coalesce("is_gold", F.lit(False)).alias("gold"),
        F.coalesce(F.col("chunk") >= 0, F.lit(True)).alias("inner"), zero("char_start").alias("start"), (zero("char_start") + zero("length") - 1).alias("stop"),
        *[zero(f"{c}_id").alias(c) for c in IDS], F.col("x").cast("array<float>").alias("x"),
    )
    out = rows.groupBy("sentence_id", "split").agg(F.collect_list(node.alias("n")).alias("nodes"))
    out = out.join(texts, "sentence_id", "left") if texts is not None else out.withColumn("text", F.lit(None).cast("string"))
    return out.select("sentence_id", "split", "text", "nodes")


class Sentences:
    """A batch of packed rows as arrays, with the links of all their lattices; ``row`` is a node's place among the features."""

    def __init__(self, batch, sentence: int = 0, text: int = 2, nodes: int = 3):
        column = batch.column(nodes)
        self.n = batch.num_rows
        owner = np.repeat(np.arange(self.n), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = column.flatten()
        ints = lambda i: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64)
        node, level = ints(0), ints(1)
        self.lattice: Batch = linked(owner, node, level, np.ones(len(node), bool), np.zeros(len(node)))
        row = np.zeros(len(self.lattice.node), dtype=np.int64)
        row[self.lattice._find(owner, node)] = np.arange(len(node))
        self.owner, self.level = owner[row], level[row]
        self.gold, self.inner = ints(2)[row].astype(bool), ints(3)[row].astype(bool)
        self.start, self.stop = ints(4)[row], ints(5)[row]
        self.ids = {c: ints(6 + i)[row] for i, c in enumerate(IDS)}
        values = flat.field(6 + len(IDS)).flatten().to_numpy(zero_copy_only=False)
        self.dense = values.reshape(len(node), len(values) // max(len(node), 1))[row].astype(np.float64)
        self.keys = batch.column(sentence)
        self.texts = [t or "" for t in batch.column(text).to_pylist()]

    def gold_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Consecutive nodes of the gold paths with their boundaries; no sentence without a gold node has any."""
        has = np.zeros(self.n, bool)
        has[self.owner[self.gold]] = True
        on = np.flatnonzero((self.gold | ~self.inner) & has[self.owner])
        on = on[np.lexsort((self.level[on], self.owner[on]))]
        same = self.owner[on[1:]] == self.owner[on[:-1]]
        return on[:-1][same], on[1:][same]

    def best(self, weight: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, rank, score, offsets, nodes by place) of the k best paths under edge weights."""
        self.lattice.weight = weight
        owner, rank, score, offsets, nodes = self.lattice.paths(k, "parent")
        return owner, rank, score, offsets, self.lattice._find(np.repeat(owner, np.diff(offsets)), nodes)


# -- layers --------------------------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def lstm_forward(x: np.ndarray, lengths: np.ndarray, p: Params, reverse: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states [batch, time, hidden] of padded rows and what the way back needs."""
    batch, steps, _ = x.shape
    hidden = p["wh"].shape[0]
    h, c, out, memory = np.zeros((batch, hidden)), np.zeros((batch, hidden)), np.zeros((batch, steps, hidden)), []
    projected = x @ p["wx"] + p["b"]
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        z = projected[:, t] + h @ p["wh"]
        i, f, g, o = _sigmoid(z[:, :hidden]), _sigmoid(z[:, hidden : 2 * hidden]), np.tanh(z[:, 2 * hidden : 3 * hidden]), _sigmoid(z[:, 3 * hidden :])
        live = (t < lengths)[:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        memory.append((t, live, i, f, g, o, c, tanh, h))
        c, h = np.where(live, new, c), np.where(live, o * tanh, h)
        out[:, t] = np.where(live, h, 0)
    return out, memory


def lstm_backward(x: np.ndarray, p: Params, memory: list, dout: np.ndarray) -> tuple[np.ndarray, Params]:
    """Gradients of the inputs and the weights from those of the hidden states."""
    hidden = p["wh"].shape[0]
    dx, dh, dc = np.zeros_like(x), np.zeros((len(x), hidden)), np.zeros((len(x), hidden))
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    for t, live, i, f, g, o, c, tanh, h in reversed(memory):
        up = np.where(live, dout[:, t], 0) + dh
        inner = np.where(live, up * o * (1 - tanh**2) + dc, 0)
        dz = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), inner * i * (1 - g**2), np.where(live, up * tanh * o * (1 - o), 0)], axis=1)
        grads["wx"] += x[:, t].T @ dz
        grads["wh"] += h.T @ dz
        grads["b"] += dz.sum(axis=0)
        dx[:, t] = dz @ p["wx"].T
        dh = np.where(live, dz @ p["wh"].T, up)
        dc = np.where(live, inner * f, dc)
    return dx, grads


def _part(params: Params, name: str) -> Params:
    return {k.split(".", 1)[1]: v for k, v in params.items() if k.startswith(name + ".")}


# -- the bilinear scorer -------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """What a scorer reads, and its widths. Weights are a dictionary of arrays, made by ``start``.

    dense: width of the stored features; skip: how many of the first of them are left out. tables:
    sizes (rows, width) of embeddings by id column; row 0 is the boundary and stays zero, ids outside
    a table are row 1. project: width to which features are mixed, or none. alphabet, chars: the
    character encoder's letters and (embedding, hidden, output) widths. rank: the scorer's.
    """

    dense: int
    skip: int = 0
    tables: dict[str, tuple[int, int]] = field(default_factory=dict)
    project: int = 0
    alphabet: str = ""
    chars: tuple[int, int, int] = (0, 0, 0)
    rank: int = 16
    word_dropout: float = 0.0

    @property
    def joined(self) -> int:
        return self.dense - self.skip + sum(w for _, w in self.tables.values()) + self.chars[2]

    @property
    def width(self) -> int:
        return self.project or self.joined

    def start(self, seed: int, warm: Params | None = None) -> Params:
        """First weights; those of ``warm`` that have the same name and shape are taken over."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape)
        out: Params = {f"table.{c}": seeded_table(rows, w, seed + 10 + i).astype(np.float64) for i, (c, (rows, w)) in enumerate(sorted(self.tables.items()))}
        if self.chars[2]:
            e, h, o = self.chars
            out["letters"] = seeded_table(len(self.alphabet) + 2, e, seed + 1).astype(np.float64)
            for way, s in (("forward", 2), ("backward", 3)):
                out |= {f"{way}.{k}": v for k, v in lstm_parameters(e, h, seed + s).items()}
            out["spans"] = normal(4 * h, o) * 0.5
        if self.project:
            out["project"] = normal(self.joined, self.project) * np.sqrt(self.project / self.joined)
        out |= {"source": normal(self.rank, self.width), "destination": normal(self.rank, self.width), "bias": np.zeros(1)}
        return out | {k: v.copy() for k, v in (warm or {}).items() if k in out and out[k].shape == v.shape}

    def forward(self, p: Params, s: Sentences, rng: np.random.Generator | None = None) -> tuple[np.ndarray, dict]:
        """Node features [nodes, width]; boundaries are zero. With ``rng`` words drop out."""
        parts, cache = [s.dense[:, self.skip :]], {}
        drop = rng.random(len(s.owner)) < self.word_dropout if rng is not None and self.word_dropout else np.zeros(len(s.owner), bool)
        for c in sorted(self.tables):
            table = p[f"table.{c}"]
            ids = np.where((s.ids[c] >= 0) & (s.ids[c] < len(table)), s.ids[c], UNKNOWN)
            cache[c] = ids = np.where(drop & (c in ("form", "lemma")), UNKNOWN, ids)
            parts.append(table[ids])
        if self.chars[2]:
            index = {c: i + 2 for i, c in enumerate(self.alphabet)}
            lengths = np.array([len(t) for t in s.texts], dtype=np.int64)
            codes = np.zeros((s.n, max(1, int(lengths.max(initial=0)))), dtype=np.int64)
            for i, t in enumerate(s.texts):
                codes[i, : len(t)] = [index.get(c, 1) for c in t]
            x = p["letters"][codes]
            ways = {w: lstm_forward(x, lengths, _part(p, w), w == "backward") for w in ("forward", "backward")}
            states = np.concatenate([ways[w][0] for w in ("forward", "backward")], axis=2)
            last = np.maximum(lengths[s.owner] - 1, 0)
            a, b = np.clip(s.start, 0, last), np.clip(s.stop, 0, last)
            ends = np.concatenate([states[s.owner, a], states[s.owner, b]], axis=1)
            parts.append(ends @ p["spans"])
            cache |= {"x": x, "codes": codes, "ways": ways, "a": a, "b": b, "ends": ends}
        joined = np.concatenate(parts, axis=1) * s.inner[:, None]
        cache["joined"] = joined
        return (joined @ p["project"] if self.project else joined), cache

    def backward(self, p: Params, s: Sentences, cache: dict, dx: np.ndarray) -> Params:
        grads: Params = {}
        if self.project:
            grads["project"] = cache["joined"].T @ dx
            dx = dx @ p["project"].T
        dx = dx * s.inner[:, None]
        at = self.dense - self.skip
        for c in sorted(self.tables):
            w = self.tables[c][1]
            grads[f"table.{c}"] = np.zeros_like(p[f"table.{c}"])
            np.add.at(grads[f"table.{c}"], cache[c], dx[:, at : at + w])
            grads[f"table.{c}"][0] = 0
            at += w
        if self.chars[2]:
            h, dspan = self.chars[1], dx[:, at:]
            grads["spans"] = cache["ends"].T @ dspan
            dends = dspan @ p["spans"].T
            dstates = np.zeros((*cache["codes"].shape, 2 * h))
            np.add.at(dstates, (s.owner, cache["a"]), dends[:, : 2 * h])
            np.add.at(dstates, (s.owner, cache["b"]), dends[:, 2 * h :])
            grads["letters"] = np.zeros_like(p["letters"])
            for w, part in (("forward", dstates[:, :, :h]), ("backward", dstates[:, :, h:])):
                dchars, g = lstm_backward(cache["x"], _part(p, w), cache["ways"][w][1], part)
                grads |= {f"{w}.{k}": v for k, v in g.items()}
                np.add.at(grads["letters"], cache["codes"], dchars)
            grads["letters"][0] = 0
        return grads

    def weights(self, p: Params, s: Sentences, x: np.ndarray) -> np.ndarray:
        """The scores of all edges."""
        left, right = x @ p["source"].T, x @ p["destination"].T
        return np.einsum("ij,ij->i", left[s.lattice.u], right[s.lattice.v]) + p["bias"][0]

    def loss(self, p: Params, s: Sentences, margin: float, rng: np.random.Generator | None = None) -> tuple[float, int, Params]:
        """The structured hinge of a batch, its sentences with gold, and the gradients of the mean.

        The best path is sought with ``margin`` added for each node that is not gold; a sentence whose
        gold path scores as much teaches nothing.
        """
        x, cache = self.forward(p, s, rng)
        weight = self.weights(p, s, x) + margin * (s.inner & ~s.gold)[s.lattice.v]
        owner, _, total, offsets, nodes = s.best(weight)
        gu, gv = s.gold_links()
        left, right = x @ p["source"].T, x @ p["destination"].T
        gold = np.bincount(s.owner[gu], weights=np.einsum("ij,ij->i", left[gu], right[gv]) + p["bias"][0], minlength=s.n)
        taught = np.zeros(s.n, bool)
        taught[s.owner[gu]] = True
        hinge = np.zeros(s.n)
        hinge[owner] = total - gold[owner]
        wrong = taught & (hinge > 0)
        inside = np.ones(max(len(nodes) - 1, 0), bool)
        inside[offsets[1:-1] - 1] = False
        pu, pv = nodes[:-1][inside], nodes[1:][inside]
        count = max(int(taught.sum()), 1)
        dleft, dright, bias = np.zeros_like(left), np.zeros_like(right), 0.0
        for u, v, sign in ((pu, pv, 1.0), (gu, gv, -1.0)):
            on = wrong[s.owner[u]]
            u, v = u[on], v[on]
            np.add.at(dleft, u, sign / count * right[v])
            np.add.at(dright, v, sign / count * left[u])
            bias += sign * len(u) / count
        grads = {"source": dleft.T @ x, "destination": dright.T @ x, "bias": np.array([bias])}
        return float(hinge[wrong].sum()) / count, int(taught.sum()), grads | self.backward(p, s, cache, dleft @ p["source"] + dright @ p["destination"])


# -- the reranker --------------------------------------------------------------------------------


@dataclass(frozen=True)
class PathRanker:
    """A bidirectional LSTM over a path's node features; its scalar is added to the base score.

    The last layer starts at zero, so an untrained ranker is the base decoder.
    """

    dense: int
    hidden: int = 16

    def start(self, seed: int) -> Params:
        out: Params = {"out": np.zeros(2 * self.hidden)}
        for way, s in (("forward", 2), ("backward", 3)):
            out |= {f"{way}.{k}": v for k, v in lstm_parameters(self.dense, self.hidden, seed + s).items()}
        return out

    def scores(self, p: Params, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, dict]:
        ways = {w: lstm_forward(x, lengths, _part(p, w), w == "backward") for w in ("forward", "backward")}
        rows, last = np.arange(len(x)), np.maximum(lengths - 1, 0)
        ends = np.concatenate([ways["forward"][0][rows, last], ways["backward"][0][:, 0]], axis=1)
        return ends @ p["out"], {"ways": ways, "ends": ends, "x": x, "last": last}

    def backward(self, p: Params, cache: dict, d: np.ndarray) -> Params:
        grads: Params = {"out": cache["ends"].T @ d}
        dends, h, rows = np.outer(d, p["out"]), self.hidden, np.arange(len(d))
        for w, at, part in (("forward", cache["last"], dends[:, :h]), ("backward", 0, dends[:, h:])):
            dout = np.zeros_like(cache["ways"][w][0])
            dout[rows, at] = part
            grads |= {f"{w}.{k}": v for k, v in lstm_backward(cache["x"], _part(p, w), cache["ways"][w][1], dout)[1].items()}
        return grads

    def loss(self, p: Params, c: Candidates, margin: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, int, Params]:
        """The listwise loss: minus the log of the right candidates' share, where there is a right one."""
        bonus, cache = self.scores(p, c.x, c.lengths)
        total = c.base + bonus
        top = np.maximum.reduceat(total, c.first) if len(total) else total
        e = np.exp(total - np.repeat(top, c.size))
        share = e / np.repeat(np.add.reduceat(e, c.first), c.size) if len(e) else e
        right = np.add.reduceat(share * c.label, c.first) if len(e) else e
        taught = right > 0
        count = max(int(taught.sum()), 1)
        each = np.repeat(np.maximum(right, 1e-300), c.size)
        d = np.where(np.repeat(taught, c.size), share - share * c.label / each, 0.0) / count
        return float(-np.log(np.maximum(right[taught], 1e-300)).sum()) / count, int(taught.sum()), self.backward(p, cache, d)


class Candidates:
    """A batch of candidate paths (sentence_id, split, text, nodes, paths array<struct<rank, score, nodes, label>>) with their nodes' features."""

    def __init__(self, batch):
        s = Sentences(batch)
        column = batch.column(4)
        self.size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        owner = np.repeat(np.arange(s.n), self.size)
        self.keys, self.owner = s.keys, owner
        self.rank = flat.field(0).to_numpy(zero_copy_only=False)
        self.base = flat.field(1).to_numpy(zero_copy_only=False).astype(np.float64)
        self.label = flat.field(3).fill_null(False).to_numpy(zero_copy_only=False).astype(np.float64)
        self.lengths = flat.field(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        nodes = flat.field(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        path = np.repeat(np.arange(len(owner)), self.lengths)
        at = np.arange(len(nodes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        place = s.lattice._find(owner[path], nodes)
        self.x = np.zeros((len(owner), max(1, int(self.lengths.max(initial=0))), s.dense.shape[1]))
        self.x[path, at] = s.dense[place]
        keep = self.size > 0
        self.first = (np.cumsum(self.size) - self.size)[keep]
        self.size = self.size[keep]


# -- training ------------------------------------------------------------------------------------


class AdamW:
    """Adam with decoupled weight decay over a dictionary of arrays."""

    def __init__(self, rate: float, decay: float = 0.01, clip: float = 5.0):
        self.rate, self.decay, self.clip, self.t = rate, decay, clip, 0
        self.m: Params = {}
        self.v: Params = {}

    def step(self, p: Params, grads: Params) -> None:
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / norm) if norm > 0 else 1.0
        self.t += 1
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g**2
            step = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            p[k] = p[k] - self.rate * (step + self.decay * p[k])


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.asarray(values[at : at + like[k].size], dtype=np.float64).reshape(like[k].shape)
        at += like[k].size
    return out


def _slices(batches: Iterator, rows: int) -> Iterator:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


_BLOCKS = "block int, n double, loss double, values array<double>"


def _epoch(rows: DataFrame, model, params: Params, read: Callable, rate: float, margin: float, batch: int, seed: int) -> tuple[Params, float, int]:
    """One epoch: the average of all tasks' weights by the sentences that taught them, the mean loss, and those sentences."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        rng = np.random.default_rng([seed, context.partitionId() if context else 0])
        p, optimizer, n, loss = {k: v.copy() for k, v in params.items()}, AdamW(rate), 0, 0.0
        for part in _slices(batches, batch):
            one, taught, grads = model.loss(p, read(part), margin, rng)
            if taught:
                optimizer.step(p, grads)
                n, loss = n + taught, loss + one * taught
        values = flat(p) * n
        for k in range(0, len(values), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([float(n)]), pa.array([loss]), pa.array([values[k : k + BLOCK]], pa.list_(pa.float64()))], names=["block", "n", "loss", "values"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, list] = {}
        for part in batches:
            for block, n, loss, values in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
                held = sums.setdefault(block, [0.0, 0.0, 0.0])
                held[0], held[1], held[2] = held[0] + n, held[1] + loss, held[2] + values.values.to_numpy(zero_copy_only=False)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([s[i] for s in sums.values()]) for i in range(2)), pa.array([s[2] for s in sums.values()], pa.list_(pa.float64()))], names=["block", "n", "loss", "values"])

    blocks = -(-len(flat(params)) // BLOCK)
    summed = rows.mapInArrow(work, _BLOCKS).repartitionById(min(blocks, 200), "block").mapInArrow(add, _BLOCKS).orderBy("block").collect()
    n = summed[0]["n"] if summed else 0
    if not n:
        return params, 0.0, 0
    return shaped(np.concatenate([r["values"] for r in summed]) / n, params), summed[0]["loss"] / n, int(n)


def train(
    rows: DataFrame, model, params: Params, dev: Callable[[Params], float] | None = None, read: Callable = Sentences, epochs: int = 8, rate: float = 0.01,
    margin: float = 1.0, batch: int = 64, patience: int = 3, seed: int = 1, folder: str | None = None,
) -> tuple[Params, list[dict[str, float]]]:
    """Weights after the epoch that is best by ``dev``, or the last one, and a log of (epoch, loss, taught, dev).

    ``rows`` are read once per epoch, so they should be a stored table. Training stops when ``dev`` has
    not risen for ``patience`` epochs. With a ``folder`` every epoch's state is saved there, and a run
    goes on after the last saved one. Rows without gold teach nothing; without rows the weights stay.
    """
    log, best, spark = [], (-np.inf, params, -1), rows.sparkSession
    first = 0
    saved = runs.load_state(spark, f"{folder}/state") if folder else None
    if saved is not None:
        step, values = saved
        first, params = step + 1, shaped(np.array(values["weights"]), params)
        best = (values["best"][0], shaped(np.array(values["best_weights"]), params), int(values["best"][1]))
    for epoch in range(first, epochs):
        params, loss, taught = _epoch(rows, model, params, read, rate, margin, batch, seed * 1_000 + epoch)
        score = dev(params) if dev else float(epoch)
        log.append({"epoch": epoch, "loss": loss, "taught": taught, "dev": score})
        if score > best[0]:
            best = (score, params, epoch)
        if folder:
            runs.save_state(spark, f"{folder}/state", epoch, {"weights": flat(params).tolist(), "best": [float(best[0]), float(best[2])], "best_weights": flat(best[1]).tolist()})
            runs.append_log(spark, f"{folder}/log", [(epoch, name, float(v)) for name, v in log[-1].items()])
        if epoch - best[2] >= patience:
            break
    return best[1], log


# -- use -----------------------------------------------------------------------------------------


def predict(rows: DataFrame, model: Model, params: Params, k: int = 1, batch: int = 256) -> DataFrame:
    """(sentence_id, rank, score, nodes): the k best paths; edges are scored inside the batch that decodes them.

    The fused form of scoring: no edge and no projected node is ever a row.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _slices(batches, batch):
            s = Sentences(part)
            owner, rank, score, offsets, nodes = s.best(model.weights(params, s, model.forward(params, s)[0]), k)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(s.lattice.node[nodes].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([s.keys.take(pa.array(owner)), pa.array(rank.astype(np.int32)), pa.array(score), lists], names=["sentence_id", "rank", "score", "nodes"])

    return rows.mapInArrow(run, f"sentence_id {rows.schema['sentence_id'].dataType.simpleString()}, rank int, score double, nodes array<int>")


def evaluate(rows: DataFrame, model: Model, params: Params, batch: int = 256) -> dict[str, float]:
    """sentences, f1 and perfect (share) of the best paths over the rows that have gold; one row of sums goes to the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(5, dtype=np.int64)
        for part in _slices(batches, batch):
            s = Sentences(part)
            owner, _, _, offsets, nodes = s.best(model.weights(params, s, model.forward(params, s)[0]))
            on = np.zeros(len(s.owner), bool)
            on[nodes] = True
            on &= s.inner
            has = np.bincount(s.owner[s.gold], minlength=s.n) > 0
            count = lambda flag, s=s, has=has: np.bincount(s.owner[flag], minlength=s.n) * has
            tp, fp, fn = count(on & s.gold), count(on & ~s.gold), count(~on & s.gold)
            sums += np.array([tp.sum(), fp.sum(), fn.sum(), ((fp + fn == 0) & has).sum(), has.sum()])
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in sums.tolist()], names=["tp", "fp", "fn", "perfect", "n"])

    r = rows.mapInArrow(run, "tp long, fp long, fn long, perfect long, n long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "perfect", "n")]).first()
    return {"sentences": r["n"], "f1": 2 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1), "perfect": r["perfect"] / max(r["n"], 1)}


def materialize(rows: DataFrame, model: Model, params: Params, batch: int = 256) -> DataFrame:
    """(sentence_id, node_id, x): the model's node features, frozen; a scorer over them needs no tables or encoder."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _slices(batches, batch):
            s = Sentences(part)
            x = model.forward(params, s)[0].astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([s.keys.take(pa.array(s.owner)), pa.array(s.lattice.node.astype(np.int32)), lists], names=["sentence_id", "node_id", "x"])

    return rows.mapInArrow(run, f"sentence_id {rows.schema['sentence_id'].dataType.simpleString()}, node_id int, x array<float>")


def rescored(rows: DataFrame, model: PathRanker, params: Params, batch: int = 64) -> DataFrame:
    """(sentence_id, rank, label, score, new_score) of all candidates."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _slices(batches, batch):
            c = Candidates(part)
            new = c.base + model.scores(params, c.x, c.lengths)[0]
            yield pa.RecordBatch.from_arrays([c.keys.take(pa.array(c.owner)), pa.array(c.rank, pa.int32()), pa.array(c.label > 0), pa.array(c.base), pa.array(new)], names=["sentence_id", "rank", "label", "score", "new_score"])

    return rows.mapInArrow(run, f"sentence_id {rows.schema['sentence_id'].dataType.simpleString()}, rank int, label boolean, score double, new_score double")
