"""Tables in the shared checkpoint folder that tasks read for themselves, part by part.

A side of a comparison that every task needs is written once, as Parquet, to the folder that all
executors share. A task streams the parts it needs, so the other side is moved once or not at all,
nothing is broadcast or collected, and a task holds one part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..sources.files import filesystem
from ..sources.tables import scratch


def store(df: DataFrame, name: str, by: str) -> str:
    """Write a table in folders by the column ``by``; returns the folder's address."""
    folder = scratch(df.sparkSession, name)
    df.write.partitionBy(by).parquet(folder)
    return folder


def read(folder: str, by: str, value: int, columns: list[str], rows: int = 4096) -> Iterator:
    """The record batches of one value of ``by``, in order of file names; none if there is no such folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = filesystem(folder)
    infos = system.get_file_info(fs.FileSelector(f"{path}/{by}={value}", allow_not_found=True))
    for info in sorted(infos, key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=rows, columns=columns)
