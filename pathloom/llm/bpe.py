"""Byte-level BPE encoding with a segment tree over the ranks of adjacent pairs.

The vocabulary is a public ``.tiktoken`` rank file. Every pretoken is a leaf row of a segment
tree whose leaves hold ``rank << bits | position`` of the pair that starts there; the root is the
leftmost lowest-rank pair. A merge changes three leaves and their paths to the root, so a
pretoken of n bytes costs O(n log n). Two forms of the same tree are used: rows of equal width
worked on together with NumPy (20 bits for positions), and a plain one for a width with few rows
or very long words, with as many bits as the width needs, so that a pretoken may have any length.

Texts are cut at positions that are pretoken boundaries in any context, and the ids of the
pieces are remembered per worker, so that a repeated word is encoded once. The memory is
cleared when it is full; that changes the time only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import regex

POSITION_BITS = 20
NONE = np.int64(1) << np.int64(60)
FEW_ROWS = 24
BATCH_ROWS = 1 << 16
CACHE_PIECES = 400_000


def default_rank_file() -> str:
    """The rank file of byte_bpe_50k among the installed public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def default_pattern() -> str:
    """The pretoken pattern that belongs to byte_bpe_50k (fixed value)."""
    return r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairEncoder:
    """Encoder for one rank file; holds the memory of pieces already encoded."""

    def __init__(self, rank_file: str | None = None, pattern: str | None = None, cache_pieces: int = CACHE_PIECES):
        ranks: dict[bytes, int] = {}
        with open(rank_file or default_rank_file(), "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.shift = np.int64(max(ranks.values()).bit_length())
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << int(self.shift)) | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.find = regex.compile(pattern or default_pattern()).findall
        self.odd_space = regex.compile(r"\s\s|[^\S \n]|\x00").search
        self.cache: dict[str, bytes] = {}
        self.cache_pieces = cache_pieces

    # -- pretokens ---------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Parts of the text that can be encoded apart.

        A boundary lies before a single space and around a single line feed between other
        characters; where white space comes in runs or other kinds, the pattern itself cuts.
        """
        if self.odd_space(text):
            return self.find(text)
        return [p for p in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if p]

    # -- the tree ----------------------------------------------------------------------------

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right) at positions ``at``; right < 0 means no pair."""
        key = (left << self.shift) | np.maximum(right, 0)
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[i] == key) & (right >= 0)
        return np.where(found, (self.pair_ranks[i] << POSITION_BITS) | at, NONE)

    def _encode_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Encode byte words of at most ``width`` bytes (a power of two) together."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        columns = np.arange(width + 1)
        ids[columns[None, :] < lengths[:, None]] = flat
        following = np.tile(columns + 1, (n, 1))
        following = np.minimum(following, width)
        before = np.tile(columns - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = self._leaf(ids[:, :-1], ids[:, 1:], np.broadcast_to(columns[:-1], (n, width)))
        half = width // 2
        while half >= 1:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)
        mask = (1 << POSITION_BITS) - 1
        while len(rows):
            best = tree[rows, 1]
            at, new = best & mask, best >> POSITION_BITS
            gone = following[rows, at]
            then = following[rows, gone]
            ids[rows, at] = new
            ids[rows, gone] = -2
            following[rows, at] = then
            before[rows, then] = at
            prior = before[rows, at]
            right = np.where(then < width, ids[rows, then], -1)
            has_prior = prior >= 0
            left = np.where(has_prior, ids[rows, prior], 0)
            leaf_gone = gone + width
            leaf_at = at + width
            leaf_prior = np.maximum(prior, 0) + width
            tree[rows, leaf_gone] = NONE
            tree[rows, leaf_at] = self._leaf(new, right, at)
            tree[rows, leaf_prior] = np.where(has_prior, self._leaf(left, new, np.maximum(prior, 0)), tree[rows, leaf_prior])
            for node in (leaf_gone, leaf_at, leaf_prior):
                node = node >> 1
                while node[0] >= 1:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < NONE]
        kept = ids[:, :width]
        valid = kept >= 0
        return np.split(kept[valid].astype(np.int32), np.cumsum(valid.sum(axis=1))[:-1])

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same tree for one word, in plain Python."""
        n = len(word)
        width = 1 << max(0, (n - 1).bit_length())
        ids = [int(self.byte_ids[b]) for b in word]
        bits, shift, pairs = width.bit_length(), int(self.shift), self.pairs
        none = 1 << (shift + bits)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get((ids[i] << shift) | ids[i + 1])
            if rank is not None:
                tree[width + i] = (rank << bits) | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, left: int, right: int) -> None:
            rank = pairs.get((left << shift) | right) if right >= 0 else None
            node = width + i
            tree[node] = none if rank is None else (rank << bits) | i
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while width > 1 and tree[1] < none:
            at, new = tree[1] & ((1 << bits) - 1), tree[1] >> bits
            gone = following[at]
            then = following[gone]
            ids[at], ids[gone] = new, -2
            following[at] = then
            if then < n:
                before[then] = at
            put(gone, 0, -1)
            put(at, new, ids[then] if then < n else -1)
            if before[at] >= 0:
                put(before[at], ids[before[at]], new)
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    def encode_pretokens(self, pretokens: list[str]) -> dict[str, bytes]:
        """The ids of each pretoken, as the bytes of an int32 array."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for token in pretokens:
            word = token.encode("utf-8", "surrogatepass")
            if len(word) == 1:
                out[token] = np.int32(self.byte_ids[word[0]]).tobytes()
            elif word:
                by_width.setdefault(1 << (len(word) - 1).bit_length(), []).append((token, word))
        for width, words in by_width.items():
            if len(words) < FEW_ROWS or width >= 1 << 12:
                for token, word in words:
                    out[token] = self.encode_long(word).tobytes()
                continue
            step = max(FEW_ROWS, BATCH_ROWS * 16 // width)
            for k in range(0, len(words), step):
                some = words[k : k + step]
                for (token, _), ids in zip(some, self._encode_rows([w for _, w in some], width), strict=True):
                    out[token] = ids.tobytes()
        return out

    # -- texts -------------------------------------------------------------------------------

    def encode_bytes(self, texts: Iterable[str | None]) -> list[bytes]:
        """Per text the bytes of its int32 ids; empty for an empty and a null text."""
        cut = [self.pieces(t) if t else [] for t in texts]
        cache = self.cache
        missing = {p for pieces in cut for p in pieces if p not in cache}
        if missing:
            if len(cache) + len(missing) > self.cache_pieces:
                cache.clear()
                missing = {p for pieces in cut for p in pieces}
            split = {p: self.find(p) for p in missing}
            known = self.encode_pretokens(list({t for tokens in split.values() for t in tokens}))
            for piece, tokens in split.items():
                cache[piece] = known[tokens[0]] if len(tokens) == 1 else b"".join([known[t] for t in tokens])
        return [b"".join([cache[p] for p in pieces]) for pieces in cut]


_encoders: dict[tuple[str, str | None], BytePairEncoder] = {}


def encoder(rank_file: str | None = None, pattern: str | None = None) -> BytePairEncoder:
    """The worker's encoder for a rank file, made once per Python worker."""
    key = (rank_file or default_rank_file(), pattern)
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(*key)
    return _encoders[key]


def encode_batches(batches: Iterator, rank_file: str | None, lengths_only: bool, chars: int = 4_000_000) -> Iterator:
    """Arrow batches of (id, text) to batches of (id, ids) or (id, number of ids)."""
    import pyarrow as pa

    enc = encoder(rank_file)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            stop, total = start, 0
            while stop < len(texts) and total < chars:
                total += len(texts[stop] or "")
                stop += 1
            rows = enc.encode_bytes(texts[start:stop])
            sizes = np.fromiter((len(r) // 4 for r in rows), dtype=np.int64, count=len(rows))
            key = keys.slice(start, stop - start)
            if lengths_only:
                yield pa.RecordBatch.from_arrays([key, pa.array(sizes)], names=["k", "n_tokens"])
            else:
                offsets = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(rows), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["k", "ids"])
            start = stop
