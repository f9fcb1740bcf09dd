"""How often every distinct term occurs and in how many records: last-seen counters.

Records are hash-partitioned and sorted by their identifier, so a record and all its repeated
deliveries lie side by side in one partition. A worker keeps, per term, the occurrences, the
number of records and the last record seen: an occurrence counts a record only if the term's last
record is another one. No set of records is kept per term. A partition's counters are sums over
its own records, so they are added up per term afterwards; a term that a third of all tokens carry
is then one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLUSH_TERMS = 500_000


class LastSeenCounters:
    """Counters of one field: term -> occurrences, records, last record."""

    def __init__(self) -> None:
        self.terms = np.empty(0, dtype=np.int64)
        self.seen = np.empty((0, 3), dtype=np.int64)

    def add(self, terms: np.ndarray, records: np.ndarray) -> None:
        """Count occurrences; ``records`` never falls, from call to call too."""
        if not len(terms):
            return
        order = np.argsort(terms, kind="stable")
        t, r = terms[order], records[order]
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        names = t[start]
        absent = names[~np.isin(names, self.terms, assume_unique=True)]
        if len(absent):
            all_terms = np.concatenate([self.terms, absent])
            all_seen = np.concatenate([self.seen, np.tile(np.array([[0, 0, np.iinfo(np.int64).min]]), (len(absent), 1))])
            order = np.argsort(all_terms)
            self.terms, self.seen = all_terms[order], all_seen[order]
        slot = np.searchsorted(self.terms, names)
        previous = np.empty_like(r)
        previous[1:] = r[:-1]
        previous[start] = self.seen[slot, 2]
        self.seen[slot, 0] += np.diff(np.r_[start, len(t)])
        self.seen[slot, 1] += np.add.reduceat((r != previous).astype(np.int64), start)
        self.seen[slot, 2] = r[np.r_[start[1:], len(t)] - 1]


def _count(batches: Iterator, fields: list[str]) -> Iterator:
    """Batches (record, one int list per field), sorted by record, to partial counters."""
    import pyarrow as pa

    def flush(counters: list[LastSeenCounters]) -> Iterator:
        for name, c in zip(fields, counters, strict=True):
            if len(c.terms):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(c.terms)), pa.array(c.terms), pa.array(c.seen[:, 0]), pa.array(c.seen[:, 1])],
                    names=["kind", "id", "occurrences", "records"],
                )

    counters, last = [LastSeenCounters() for _ in fields], None
    for batch in batches:
        record = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(record):
            continue
        fresh = np.r_[record[0] != last, record[1:] != record[:-1]]
        last = record[-1]
        for i, c in enumerate(counters):
            lists = batch.column(i + 1).filter(pa.array(fresh))
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values, owner = lists.flatten(), np.repeat(record[fresh], lengths)
            valid = values.is_valid().to_numpy(zero_copy_only=False)
            terms = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = valid & (terms >= 1)
            c.add(terms[keep], owner[keep])
        if sum(len(c.terms) for c in counters) > FLUSH_TERMS:
            yield from flush(counters)
            counters = [LastSeenCounters() for _ in fields]
    yield from flush(counters)


def term_frequencies(df: DataFrame, record: str, fields: dict[str, str], rare_below: int = 3, common_share: tuple[int, int] = (1, 5)) -> DataFrame:
    """One row (kind, id, occurrences, records, mark) per distinct id of each field.

    ``fields`` maps the kind's name to the array column. A record counts once, however often it is
    delivered (deliveries of one record are equal). Null arrays, null elements and ids below 1 are
    not counted; rows without a record identifier are no records. ``mark`` is rare below
    ``rare_below`` records, common above ``common_share`` of all distinct records (whether they
    have ids or not), else null; rare holds where both would. An empty table has no rows.
    """
    kinds = list(fields)
    rows = df.select(F.col(record).cast("long").alias("r"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields.values())]).where(F.col("r").isNotNull())
    ordered = rows.repartition("r").sortWithinPartitions("r")
    schema = T.StructType(
        [T.StructField("kind", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("id", "occurrences", "records")]
    )
    partial = ordered.mapInArrow(lambda b: _count(b, kinds), schema)
    counted = partial.groupBy("kind", "id").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = df.where(F.col(record).isNotNull()).select(F.countDistinct(record)).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_share[1] > total * common_share[0], "common")
    return counted.select("kind", F.col("id").cast("int").alias("id"), "occurrences", "records", mark.alias("mark"))
