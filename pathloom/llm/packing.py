"""Filling containers of fixed capacity: bounded-space online best fit.

Items arrive in an order fixed by a hash of their key. At most ``open_bins`` containers are open
at a time; a bitset with one bit per amount of free room names the amounts for which a container
is open. An item goes to the open container with the least room that still holds it (the lowest
set bit at or above its size). If none holds it and all are open, the fullest closes first.

Every part of the items packs its own. The containers still open at its end are at most
``open_bins``; they alone travel on, as items of their own, to a second packing under the same bound,
so that what room is left open per part is filled as well. Nothing is collected but the sum of all
sizes, which decides the number of parts, so the result depends on the items alone. A task
keeps ``open_bins`` containers and one batch in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ensure_checkpoint_dir

CAPACITY = 2048
OPEN_BINS = 512
#: containers' worth of items in one part, and open containers in one group of the second packing
PART_BINS = 8_192
LATE_GROUP = 20_000


class OpenBins:
    """The open containers, kept by free room; ``put`` returns a container that had to close."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.count = 0, 0
        self.by_room: list[list] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, bin_: object) -> None:
        self.by_room[room].append(bin_)
        self.bits |= 1 << room
        self.count += 1

    def _take(self, room: int) -> object:
        stack = self.by_room[room]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << room)
        self.count -= 1
        return bin_

    def put(self, size: int, content: list) -> list:
        """Place an item; returns the containers this closes, as (used, content) pairs."""
        closed = []
        above = self.bits >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            bin_ = self._take(room)
            bin_.extend(content)
        else:
            if self.count >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                closed.append((self.capacity - fullest, self._take(fullest)))
            room, bin_ = self.capacity, list(content)
        if room == size:
            closed.append((self.capacity, bin_))
        else:
            self._add(room - size, bin_)
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        """The containers open at the end, fullest first."""
        for room in range(self.capacity + 1):
            for bin_ in self.by_room[room]:
                yield self.capacity - room, bin_


_ITEM = T.StructType([T.StructField("item", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("size", T.LongType())])
_BIN = T.StructType(
    [
        T.StructField("bin_key", T.StringType()),
        T.StructField("open", T.BooleanType()),
        T.StructField("used", T.LongType()),
        T.StructField("content", T.ArrayType(_ITEM)),
    ]
)


def _bins_to_batch(bins: list[tuple[int, bool, int, list]]):
    import pyarrow as pa

    struct = pa.struct([("item", pa.int64()), ("part", pa.int32()), ("size", pa.int64())])
    flat = [x for b in bins for x in b[3]]
    items = pa.StructArray.from_arrays(
        [pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int64())],
        fields=list(struct),
    )
    offsets, at = [0], 0
    for b in bins:
        at += len(b[3])
        offsets.append(at)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b[0] for b in bins], pa.string()),
            pa.array([b[1] for b in bins], pa.bool_()),
            pa.array([b[2] for b in bins], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items),
        ],
        names=["bin_key", "open", "used", "content"],
    )


def _key(content: list) -> str:
    """A container's name: its least (item, part)."""
    item, part, _ = min(content)
    return f"{item}-{part}"


def _pack(batches: Iterator, capacity: int, open_bins: int, contents: Callable[[object], Iterator[tuple[int, list]]]) -> Iterator:
    """Pack what ``contents`` reads from each batch, as (size, content); the rest comes out open."""
    bins = OpenBins(capacity, open_bins)
    for batch in batches:
        out = [(_key(content), False, used, content) for size, new in contents(batch) for used, content in bins.put(size, new)]
        if out:
            yield _bins_to_batch(out)
    out = [(_key(content), True, used, content) for used, content in bins.rest()]
    if out:
        yield _bins_to_batch(out)


def _items(batch) -> Iterator[tuple[int, list]]:
    for item in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield item[2], [item]


def _open_bins(batch) -> Iterator[tuple[int, list]]:
    for used, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield used, [(x["item"], x["part"], x["size"]) for x in content]


def pack(
    sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, part_bins: int = PART_BINS
) -> DataFrame:
    """Containers for items: one row (container_id, key, part, start, n_tokens) per placed piece.

    An item larger than the capacity is split into full containers and a rest that is packed like
    any item; no other item is split. ``part`` counts an item's pieces from 0, ``start`` is the
    piece's first token in the item. Items of size null or below 1, and rows without a key, need no
    place and do not come out. Keys are unique integers of 64 bits; a repeated key would be two
    items of one name. A container's name is the least (key, part) in it. Every item is packed
    whatever the sizes. Sizes are stored once in the shared checkpoint folder, and the containers
    of the first packing; those that it closed leave from there.
    """
    ensure_checkpoint_dir(sizes.sparkSession)
    items = sizes.where((F.col(size) > 0) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(size).cast("long").alias("total")).checkpoint()
    total = items.agg(F.sum("total")).first()[0] or 0
    n = max(1, -(-total // (capacity * part_bins)))
    full = F.floor(F.col("total") / capacity).cast("int")
    rest = F.col("total") % capacity
    # an item's full containers pass through the packing and close at once
    parts = F.sequence(F.lit(0), F.when(rest > 0, full).otherwise(full - 1))
    items = items.select("item", F.explode(parts).alias("part"), full.alias("full"), rest.alias("rest"))
    items = items.select("item", "part", F.when(F.col("part") < F.col("full"), F.lit(capacity).cast("long")).otherwise(F.col("rest")).alias("size"))
    part = lambda hash_, parts: F.pmod(hash_, F.lit(parts)).cast("int").alias("p")
    ordered = items.withColumn("h", F.xxhash64("item")).select("*", part(F.col("h"), n)).repartitionById(n, "p").sortWithinPartitions("h", "item", "part").select("item", "part", "size")
    first = ordered.mapInArrow(lambda b: _pack(b, capacity, open_bins, _items), _BIN).checkpoint()
    groups = max(1, -(-n * open_bins // LATE_GROUP))
    late = first.where("open").select("used", "content", "bin_key", F.xxhash64("bin_key").alias("h")).select("*", part(F.col("h"), groups))
    late = late.repartitionById(groups, "p").sortWithinPartitions("h", "bin_key").select("used", "content")
    second = late.mapInArrow(lambda b: _pack(b, capacity, open_bins, _open_bins), _BIN)
    placed = first.where("not open").unionByName(second).select("bin_key", F.explode("content").alias("c"))
    return placed.select(
        F.col("bin_key").alias("container_id"), F.col("c.item").alias(key), F.col("c.part").alias("part"),
        (F.col("c.part").cast("long") * capacity).alias("start"), F.col("c.size").alias("n_tokens"),
    )


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens in them, the least number that could hold them, unused share.

    Without a placed piece: 0 containers, 0 tokens, and a null share.
    """
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).alias("least_containers"),
        F.count_if(F.col("used") == capacity).alias("full_containers"),
        F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("unused_share"),
    )
