"""Corpus statistics, histograms and dictionary encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import global_rank
from ..tables import ensure_checkpoint_dir


def quantiles(df: DataFrame, value: Column, shares: list[float]) -> tuple[dict[str, float | int | None], list[float | None]]:
    """({n, mean, most}, quantiles) of the non-null values, with linear interpolation, as numbers.

    Rows are counted per distinct value, the distinct values are range-partitioned and their counts
    summed up over the ranges, so no task holds all values. Of no values: n 0, all else None.
    """
    counts = df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    rows = running_total(counts, "v", "c", "upto")
    total = rows.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.max("v").alias("most")).first()
    n = total["n"]
    places = [(int((n - 1) * s), min(int((n - 1) * s) + 1, n - 1), (n - 1) * s - int((n - 1) * s)) for s in shares] if n else []
    at = sorted({p for low, high, _ in places for p in (low, high)})
    # the value at a place is the least one that reaches beyond it
    found = rows.agg(*[F.min(F.when(F.col("upto") > p, F.col("v"))).alias(f"p{p}") for p in at]).first() if at else {}
    return {"n": n, "mean": total["mean"], "most": total["most"]}, [found[f"p{lo}"] + w * (found[f"p{hi}"] - found[f"p{lo}"]) for lo, hi, w in places] or [None] * len(shares)


def running_total(df: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """Add the sum of ``amount`` up to and with each row, in the order of a unique column.

    Ranges of the order are summed one by one; only one sum per range is joined back. The ranges
    are stored in the shared checkpoint folder, since both sides must see the same ones.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(amount).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    # one row per partition, so its size is bounded by their number
    return ranged.withColumn("_upto", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_upto") + F.col("_before")).drop("_part", "_upto", "_before")


def distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: name, count, mean, median, 95th and 99th percentile (linear interpolation), max."""
    numbers, q = quantiles(df, value, [0.5, 0.95, 0.99])
    row = (name, numbers["n"], *[None if x is None else float(x) for x in (numbers["mean"], *q, numbers["most"])])
    out = df.sparkSession.createDataFrame([row], "name string, n long, mean double, median double, p95 double, p99 double, most double")
    return out.select("name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99")], "most")


def histogram(df: DataFrame, value: Column, bounds: list[int]) -> DataFrame:
    """(low, high, n, density) over [low, high) bins; values at or above the last bound count there.

    ``density`` is the count per unit of width. Bins without values come out with 0; values below
    the first bound and nulls are in no bin.
    """
    last = len(bounds) - 2
    which = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        which = F.when((value >= bounds[i]) & (F.lit(i == last) | (value < bounds[i + 1])), i).otherwise(which)
    bins = df.sparkSession.createDataFrame([(i, bounds[i], bounds[i + 1]) for i in range(last + 1)], "bin int, low int, high int")
    counted = df.select(which.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    out = bins.join(counted, "bin", "left").na.fill(0, ["n"])
    return out.select("low", "high", "n", F.round(F.col("n") / (F.col("high") - F.col("low")), 6).alias("density"))


def first_seen_vocabulary(df: DataFrame, token: str, order: list[str]) -> DataFrame:
    """(token, id): distinct tokens numbered from 1 in the order in which they are first seen.

    Id 0 is kept for the empty or boundary token, so empty and null tokens are left out. The order
    must be total over a token's first rows for ids to be certain; ties go by the token itself.
    """
    seen = df.where(F.col(token).isNotNull() & (F.col(token) != "")).groupBy(F.col(token).alias("token")).agg(F.min(F.struct(*order)).alias("at"))
    placed = global_rank(seen, [F.asc("at"), F.asc("token")], "place")
    return placed.select("token", (F.col("place") + 1).cast("int").alias("id"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by the MD5 of seed and key, the same in every run; fewer if there are fewer."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)
