"""Long work in shards that can be stopped and taken up again, and logs of runs.

A shard's output is a Parquet folder of its own, complete when Spark has committed it. A run does
the shards that are not complete, at most a given number; merging reads the complete ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key: an MD5 bucket, the same in every run and session."""
    return (F.conv(F.substring(F.md5(F.encode(key.cast("string"), "UTF-8")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def run_shards(rows: DataFrame, key: str, shards: int, folder: str, work: Callable[[DataFrame], DataFrame], max_new: int | None = None) -> list[int]:
    """Do the work for the shards that have no complete output, at most ``max_new``; returns their numbers.

    An incomplete output of an earlier run is overwritten. The shards are driven one after another,
    each is a distributed job.
    """
    spark, done = rows.sparkSession, []
    for shard in range(shards):
        if max_new is not None and len(done) == max_new:
            break
        out = f"{folder}/shard={shard}"
        if not _exists(spark, f"{out}/_SUCCESS"):
            work(rows.where(shard_of(F.col(key), shards) == shard)).write.mode("overwrite").parquet(out)
            done.append(shard)
    return done


def merge(spark: SparkSession, folder: str, shards: int) -> DataFrame:
    """All shards' outputs, with the column ``shard``; an incomplete shard is an error that names it."""
    missing = [s for s in range(shards) if not _exists(spark, f"{folder}/shard={s}/_SUCCESS")]
    if missing:
        raise FileNotFoundError(f"shards without a complete output: {missing}")
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/shard={s}" for s in range(shards)])


def save_state(spark: SparkSession, folder: str, step: int, values: dict[str, list[float]]) -> None:
    """The state after a step: small named vectors, as one row in a folder of its own."""
    spark.createDataFrame([(step, values)], "step int, state map<string, array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/step-{step:06d}")


def load_state(spark: SparkSession, folder: str) -> tuple[int, dict[str, list[float]]] | None:
    """The last complete state (step, values), or None."""
    if not _exists(spark, folder):
        return None
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)))
    for name in reversed([n for n in names if n.startswith("step-") and _exists(spark, f"{folder}/{n}/_SUCCESS")]):
        row = spark.read.parquet(f"{folder}/{name}").first()
        return row["step"], {k: list(v) for k, v in row["state"].items()}
    return None


def append_log(spark: SparkSession, folder: str, rows: list[tuple[int, str, float]]) -> None:
    """Add (step, name, value) lines to a run's log; a step that is logged again replaces nothing, readers take the last."""
    spark.createDataFrame(rows, "step int, name string, value double").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """(step, name, value) of a log, the last line of each step and name."""
    rows = spark.read.schema("step int, name string, value double, at timestamp").json(folder)
    return rows.groupBy("step", "name").agg(F.max_by("value", "at").alias("value"))
