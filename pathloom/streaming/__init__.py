"""An extension beyond the reference: lattices' sentences as a stream of deliveries.

Sentences arrive again and late. ``first_deliveries`` keeps the first delivery of each within the
watermark; ``term_windows`` counts terms per time window. Both are incremental plans of
Structured Streaming; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, key: str = "sentence_id", time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """The first delivery of each key within the watermark; rows without key or time fall away."""
    valid = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    return valid.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def term_windows(stream: DataFrame, terms: str = "node_form_id", time: str = "loaded_at", width: str = "30 days", late: str = "7 days") -> DataFrame:
    """(window, term, n): occurrences of each term of an array column per window; nulls and ids below 1 are not counted."""
    each = stream.where(F.col(time).isNotNull()).select(F.col(time).cast("timestamp").alias("t"), F.explode(terms).alias("term")).where("term >= 1")
    return each.withWatermark("t", late).groupBy(F.window("t", width), "term").agg(F.count("*").alias("n"))
