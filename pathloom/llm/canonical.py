"""Free-entered values to the nearest entry of a reference list: a BK-tree.

The tree hangs every entry under another one by their edit distance. A search with threshold t
that finds distance d at an entry only follows children whose distance lies in [d - t, d + t]: by
the triangle inequality nothing else can be within t. The search runs level by level for many
values at once, with bit-parallel distances in NumPy.

The search returns every entry within the threshold; which of them a value stands for is decided
afterwards. A reference list is written once to the shared folder in shards of bounded size. A task
holds a block of values, streams the shards, makes one tree after another and sets its values
against each; then the winners of the shards are merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.translit import SLP1_TO_IAST, hk_to_slp1, iast_to_slp1
from ..tables import ensure_checkpoint_dir
from . import shared

SHARD_ENTRIES = 20_000
#: values that a task holds while the shards pass
BLOCK_VALUES = 50_000
#: rows of the bit-parallel columns that stay in a processor's cache
CACHED_ROWS = 32_768
#: letters of the values that are searched together
STEP_LETTERS = 2_000_000
LETTERS = {c: i for i, c in enumerate(SLP1_TO_IAST)}
UNREADABLE = len(LETTERS)
WORD_BITS = 63


def codes(word: str) -> np.ndarray:
    """A word as letter numbers; anything else is a letter that equals none."""
    return np.array([LETTERS.get(c, UNREADABLE) for c in word], dtype=np.int64)


def edit_distance(a: str, b: str) -> int:
    """The Levenshtein distance, for words of any length."""
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
        previous = row
    return previous[-1]


class BKTree:
    """Entries (id, word) under the edit distance; repeated words keep the least id.

    Entries of at most WORD_BITS letters are measured in machine words, all rows at once. Longer
    ones hang in a tree of their own (``longer``), measured in whole numbers of any size.
    """

    def __init__(self, entries: list[tuple[int, str]], long: bool = False):
        least: dict[str, int] = {}
        for i, w in entries:
            if w and i < least.get(w, i + 1):
                least[w] = i
        words = [w for w in sorted(least, key=lambda w: least[w]) if long or len(w) <= WORD_BITS]
        over = [] if long else [(i, w) for w, i in least.items() if len(w) > WORD_BITS]
        self.longer = BKTree(over, long=True) if over else None
        self.long = long
        self.ids = np.array([least[w] for w in words], dtype=np.int64)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.masks: list[dict[int, int]] = []
        self.eq = np.zeros((0 if long else len(words), UNREADABLE + 1), dtype=np.uint64)
        for n, w in enumerate(words):
            mask: dict[int, int] = {}
            for k, c in enumerate(codes(w).tolist()):
                if c < UNREADABLE:
                    mask[c] = mask.get(c, 0) | 1 << k
            if long:
                self.masks.append(mask)
            else:
                for c, bits in mask.items():
                    self.eq[n, c] = np.uint64(bits)
        self._hang(words)

    def _hang(self, words: list[str]) -> None:
        """Build level by level: all entries of a node are measured against it at once."""
        padded, lengths = self._pad([codes(w) for w in words])
        children: list[dict[int, int]] = [{} for _ in words]
        todo = [(0, np.arange(1, len(words)))] if words else []
        while todo:
            node, rest = todo.pop()
            if not len(rest):
                continue
            d = self.distances(np.full(len(rest), node), padded, lengths, rest)
            for far in np.unique(d):
                group = rest[d == far]
                children[node][int(far)] = int(group[0])
                todo.append((int(group[0]), group[1:]))
        self.first = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(c) for c in children], out=self.first[1:])
        self.child = np.array([n for c in children for _, n in sorted(c.items())], dtype=np.int64)
        self.far = np.array([d for c in children for d in sorted(c)], dtype=np.int64)

    @staticmethod
    def _pad(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out = np.full((len(words), int(lengths.max(initial=0))), UNREADABLE, dtype=np.int8)
        for i, w in enumerate(words):
            out[i, : len(w)] = w
        return out, lengths

    def distances(self, node: np.ndarray, padded: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distance of the word of each ``row`` to its node's word, by Myers' bit-parallel columns."""
        if self.long:
            return np.array([self._distance(n, padded[r, : lengths[r]].tolist()) for n, r in zip(node.tolist(), row.tolist(), strict=True)], dtype=np.int64)
        # longest words first, so that column j is worked on for the words that have it only
        order = np.argsort(-lengths[row], kind="stable")
        out = np.empty(len(row), dtype=np.int64)
        for k in range(0, len(order), CACHED_ROWS):
            some = order[k : k + CACHED_ROWS]
            out[some] = self._columns(node[some], padded, lengths, row[some])
        return out

    def _columns(self, node: np.ndarray, padded: np.ndarray, lengths: np.ndarray, row: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        size, letters = lengths[row], padded[row].T
        having = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        m = self.lengths[node].astype(np.uint64)
        shift = m - one
        pv = (one << m) - one
        mv = np.zeros(len(node), dtype=np.uint64)
        score = self.lengths[node].copy()
        first = node * self.eq.shape[1]
        flat = self.eq.ravel()
        for j, n in enumerate(having.tolist()):
            e, p, v = flat[first[:n] + letters[j, :n]], pv[:n], mv[:n]
            xv = e | v
            xh = (((e & p) + p) ^ p) | e
            ph = v | ~(xh | p)
            mh = p & xh
            score[:n] += ((ph >> shift[:n]) & one).astype(np.int64) - ((mh >> shift[:n]) & one).astype(np.int64)
            ph = (ph << one) | one
            pv[:n] = (mh << one) | ~(xv | ph)
            mv[:n] = ph & xv
        return score

    def _distance(self, node: int, word: list[int]) -> int:
        """The same columns over whole numbers of any size, for one word."""
        m, eq = int(self.lengths[node]), self.masks[node]
        mask, last, pv, mv, score = (1 << m) - 1, 1 << (m - 1), (1 << m) - 1, 0, m
        for c in word:
            e = eq.get(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            score += bool(ph & last) - bool(mh & last)
            ph = (ph << 1 | 1) & mask
            pv = (mh << 1 | ~(xv | ph)) & mask
            mv = ph & xv
        return score

    def within(self, words: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, entry id, distance) of every entry within ``most`` of a word, the empty word excepted."""
        low = WORD_BITS + 1 if self.long else 1
        fit = [i for i, w in enumerate(words) if low - most <= len(w) and w and (self.long or len(w) <= WORD_BITS + most)]
        out = [(np.zeros(0, dtype=np.int64),) * 3]
        step: list[int] = []
        held = 0
        for i in fit:
            step.append(i)
            held += len(words[i])
            if held >= STEP_LETTERS:
                out.append(self._search(words, step, most))
                step, held = [], 0
        out.append(self._search(words, step, most))
        if self.longer is not None:
            out.append(self.longer.within(words, most))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def _search(self, words: list[str], which: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number, found = np.array(which, dtype=np.int64), []
        padded, lengths = self._pad([codes(words[i]) for i in which])
        row = np.arange(len(which) if len(self.ids) else 0)
        node = np.zeros(len(row), dtype=np.int64)
        while len(row):
            d = self.distances(node, padded, lengths, row)
            hit = d <= most
            found.append((number[row[hit]], self.ids[node[hit]], d[hit]))
            # only children whose distance to this entry lies within the threshold of the word's
            count = self.first[node + 1] - self.first[node]
            parent = np.repeat(np.arange(len(row)), count)
            at = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[node], count)
            keep = np.abs(self.far[at] - d[parent]) <= most
            row, node = row[parent[keep]], self.child[at[keep]]
        return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *(f[i] for f in found)]) for i in range(3))


_BRACKETS = re.compile(r"\([^)]*\)?|\[[^\]]*\]?|\{[^}]*\}?|<[^>]*>?|[\"“„][^\"”“]*[\"”“]?")
_GLOSS = re.compile(r"(?:[;:=,|]|\s[-–—]\s).*$", re.DOTALL)
_GRAMMAR = re.compile(r"\s(?:(?:m|f|n|mfn|ind|adj|adv|pron|num|pl|du|sg)(?![^\W_])\.?\s*)+$")
_NUMBERS = re.compile(r"(?<!\d)\d+[.)]?\s*$|^\s*\d+[.)]?")


def readings(value: str | None) -> list[str]:
    """The letters a value may stand for, as SLP1 words, likeliest first.

    What stands around the letters is set aside: brackets and quotes with what they hold, what
    follows a gloss sign, numbers, grammatical abbreviations, signs and white space. What is left
    is read as SLP1 with IAST letters in it, without a first capital, and as Harvard-Kyoto; also the
    whole value and its first word are read, for a sign may stand inside the letters.
    """
    if not value:
        return []
    text = "".join([c for c in unicodedata.normalize("NFKC", value) if unicodedata.category(c) != "Cf"])
    bare = _BRACKETS.sub(" ", text)
    core = _NUMBERS.sub("", _GLOSS.sub("", bare)).strip()
    forms = [core, _GRAMMAR.sub("", core), _GRAMMAR.sub("", _NUMBERS.sub("", bare).strip())]
    forms += core.split()[:1] if " " in core or "\t" in core else []
    out: dict[str, None] = {}
    for form in forms:
        # a first capital may be a sound of SLP1 or the capital of a sentence in IAST
        for word in (iast_to_slp1(form), iast_to_slp1(form[:1].lower() + form[1:]), hk_to_slp1(form)):
            letters = "".join([c for c in word if c in LETTERS])
            if letters:
                out[letters] = None
    return list(out)


_NEAR = T.StructType([T.StructField("value", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("entry", T.IntegerType())])


def _match(batches: Iterator, folder: str, shards: int, most: int) -> Iterator:
    """Every (value, distance, entry) within ``most``, for the values of a task."""
    import pyarrow as pa

    values: dict[str, list[str]] = {}
    for batch in batches:
        values.update((v, readings(v)) for v in batch.column(0).to_pylist())
    words = sorted({w for forms in values.values() for w in forms})
    number = {w: i for i, w in enumerate(words)}
    owners: list[list[str]] = [[] for _ in words]
    for value, forms in values.items():
        for w in forms:
            owners[number[w]].append(value)
    for shard in range(shards if words else 0):
        entries = [pair for batch in shared.read(folder, "shard", shard, ["i", "w"]) for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        best: dict[tuple[str, int], int] = {}
        for word, entry, d in zip(*(x.tolist() for x in BKTree(entries).within(words, most)), strict=True):
            for value in owners[word]:
                best[value, entry] = min(d, best.get((value, entry), d))
        yield pa.RecordBatch.from_arrays(
            [pa.array([v for v, _ in best], pa.string()), pa.array(list(best.values()), pa.int32()), pa.array([e for _, e in best], pa.int32())], names=_NEAR.names
        )


def _distinct(values: DataFrame) -> DataFrame:
    """(value): the distinct values, written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(values.sparkSession)
    return values.where("value is not null").groupBy("value").agg(F.lit(1).alias("one")).select("value").checkpoint()


def entries_within(values: DataFrame, reference: DataFrame, entry_id: str, entry: str, most: int = 2, shard_entries: int = SHARD_ENTRIES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(value, distance, entry): every entry within ``most`` edits of a reading of each distinct ``value``.

    A value without such an entry, and null, do not come out; of several readings near one entry the
    nearest counts; null and empty entries are none, repeated words are the one of the least id.
    The list is written to the shared folder in shards of about ``shard_entries`` words; nothing of
    it or of the values is collected but their numbers. A task holds about ``block_values`` values
    and one tree. Every block of values reads every shard.
    """
    return _near(_distinct(values), reference, entry_id, entry, most, shard_entries, block_values)


def _near(distinct: DataFrame, reference: DataFrame, entry_id: str, entry: str, most: int, shard_entries: int, block_values: int = BLOCK_VALUES) -> DataFrame:
    words = reference.where(F.col(entry) != "").groupBy(F.col(entry).alias("w")).agg(F.min(F.col(entry_id).cast("int")).alias("i")).where("i is not null")
    shards = max(1, -(-reference.count() // shard_entries))
    folder = shared.store(words.withColumn("shard", F.pmod(F.xxhash64("w"), F.lit(shards))), "reference-entries", "shard")
    blocks = max(int(distinct.sparkSession.sparkContext.defaultParallelism), -(-distinct.count() // block_values))
    spread = distinct.select("value", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block")).repartitionById(blocks, "block")
    return spread.select("value").mapInArrow(lambda b: _match(b, folder, shards, most), _NEAR)


def nearest_entries(values: DataFrame, reference: DataFrame, entry_id: str, entry: str, most: int = 2, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(value, distance, entry): every distinct value and its nearest entry, both null if none is within ``most``.

    The winners of the shards are merged: the least distance holds, of equally near entries the
    least id. Null values do not come out.
    """
    distinct = _distinct(values)
    near = _near(distinct, reference, entry_id, entry, most, shard_entries).select("value", F.struct("distance", "entry").alias("b"))
    every = distinct.select("value", F.lit(None).cast("struct<distance: int, entry: int>").alias("b"))
    return every.unionByName(near).groupBy("value").agg(F.min("b").alias("b")).select("value", "b.distance", "b.entry")
