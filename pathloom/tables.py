"""Reading the Parquet tables of one data directory, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def safe_unions(spark: SparkSession) -> None:
    """Keep a union from claiming its children's partitioning.

    Spark 4.1 plans no exchange after a union of equally partitioned children, but concatenates
    their partitions where an exchange below is reused (as in a self-join), and an aggregate then
    sees one group in two tasks. Aggregates here that depend on it exchange explicitly as well.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; column pruning and filters reach the scan."""
    safe_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only where none is set, as in tests, a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="pathloom-checkpoint-")
    sc.setCheckpointDir(shared)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for explicit exchanges, as the session sets it for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Give executors this package once per application, however they were started."""
    import atexit
    import io
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_pathloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    # the driver serves this file to the executors; nothing on them needs its path
    with tempfile.NamedTemporaryFile(prefix="pathloom-", suffix=".zip", delete=False) as out:
        out.write(data.getvalue())
    sc.addPyFile(out.name)
    sc._pathloom_shipped = True
    atexit.register(lambda: os.path.exists(out.name) and os.remove(out.name))
