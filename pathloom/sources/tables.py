"""Text, JSON and binary sources, and sinks, of the lattice tables."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import list_files, read_file, write_file

# Fixed value: the number with which a weight file begins.
MAGIC = 0x43534233


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files, in the checkpoint folder that all executors share."""
    from ..tables import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def remove_scratch(spark: SparkSession) -> int:
    """Delete the folders that this process has made by ``scratch``, once nothing reads them any more; returns their number."""
    at, n = spark._jvm.org.apache.hadoop.fs.Path, len(_made)
    while _made:
        path = at(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


# -- sources -------------------------------------------------------------------------------------


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header; a byte order mark before the first name falls away."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_vocabulary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, id, token) from lines ``id<TAB>token``; lines without an id are left out, a missing token is ''."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t", 2)
    rows = lines.select(F.lit(kind).alias("kind"), F.get(parts, F.lit(0)).try_cast("int").alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("token"))
    return rows.where("id is not null")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, mode, words, lemmas, tags, raw) from JSON lines; a line that cannot be read is left out."""
    schema = "id string, mode string, words array<string>, lemmas array<string>, tags array<string>, raw string, _corrupt_record string"
    return spark.read.schema(schema).json(path, mode="PERMISSIVE").where("_corrupt_record is null").drop("_corrupt_record")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(stem, chunk, place, lemma, code): annotated words from JSON lines of per-chunk lists.

    Chunks count from 1. A chunk whose lists differ in length is cut to the shorter one.
    """
    rows = spark.read.schema("sentence_id string, lemmas array<array<string>>, cng array<array<string>>").json(path)
    chunks = rows.select(F.col("sentence_id").alias("stem"), F.posexplode(F.arrays_zip(F.col("lemmas").alias("l"), F.col("cng").alias("c"))).alias("i", "z"))
    pairs = F.arrays_zip(F.col("z.l").alias("lemma"), F.col("z.c").alias("code"))
    words = chunks.where("z.l is not null and z.c is not null").select("stem", (F.col("i") + 1).alias("chunk"), F.posexplode(F.slice(pairs, F.lit(1), F.least(F.size("z.l"), F.size("z.c")))).alias("place", "w"))
    return words.select("stem", "chunk", "place", F.col("w.lemma").alias("lemma"), F.col("w.code").alias("code"))


def flat_reference(annotations: DataFrame) -> DataFrame:
    """(stem, lemmas, codes): a sentence's words in order, all chunks together."""
    x = F.array_sort(F.collect_list(F.struct("chunk", "place", "lemma", "code")))
    return annotations.groupBy("stem").agg(x.alias("x")).select("stem", F.col("x.lemma").alias("lemmas"), F.col("x.code").alias("codes"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem) of the files below a folder. Spark's own scan leaves empty files out, so names come from the file system."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return spark.createDataFrame([(f,) for f in list_files(path)], "path string").select("path", name.alias("stem"))


def stems(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(stem): the files below a folder by name in string order, at most ``limit`` if asked. Contents are not read."""
    rows = _listed(spark, path).select("stem").orderBy("stem")
    return rows.limit(limit) if limit is not None else rows


def require(df: DataFrame, schema: T.StructType, optional: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``schema`` with its types; a missing one takes its default or is an error."""
    out = []
    for field in schema:
        if field.name in df.columns:
            if df.schema[field.name].dataType != field.dataType:
                raise TypeError(f"column {field.name} is {df.schema[field.name].dataType.simpleString()}, expected {field.dataType.simpleString()}")
            out.append(F.col(field.name))
        elif field.name in (optional or {}):
            out.append((optional or {})[field.name].cast(field.dataType).alias(field.name))
        else:
            raise KeyError(f"required column {field.name} is missing")
    return df.select(*out)


def pack_weights(source: list[list[float]], destination: list[list[float]], bias: float) -> bytes:
    """Little-endian header (magic, rows, columns, bias) and two row-major float matrices."""
    rows, cols = len(source), len(source[0])
    if any(len(m) != rows or any(len(r) != cols for r in m) for m in (source, destination)):
        raise ValueError("the two matrices must have the same shape")
    flat = [x for m in (source, destination) for r in m for x in r]
    return struct.pack("<iiif", MAGIC, rows, cols, bias) + struct.pack(f"<{2 * rows * cols}f", *flat)


def write_weights(path: str, source: list[list[float]], destination: list[list[float]], bias: float) -> None:
    """A weight file, in a folder that executors share."""
    write_file(path, pack_weights(source, destination, bias))


def parse_weights(data: bytes) -> tuple[list[list[float]], list[list[float]], float]:
    """The matrices and bias of a weight file; another magic number or length is an error."""
    if len(data) < 16:
        raise ValueError("weight file is too short")
    magic, rows, cols, bias = struct.unpack_from("<iiif", data)
    if magic != MAGIC:
        raise ValueError(f"weight file has magic number {magic:#x}, expected {MAGIC:#x}")
    if len(data) != 16 + 8 * rows * cols:
        raise ValueError(f"weight file has {len(data)} bytes, expected {16 + 8 * rows * cols}")
    flat = struct.unpack_from(f"<{2 * rows * cols}f", data, 16)
    matrix = lambda o: [list(flat[o + i * cols : o + (i + 1) * cols]) for i in range(rows)]
    return matrix(0), matrix(rows * cols), bias


def read_weights(spark: SparkSession, path: str) -> tuple[list[list[float]], list[list[float]], float]:
    """A weight file through the binary source: one small file, the model of a scorer."""
    return parse_weights(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


# -- sinks ---------------------------------------------------------------------------------------


def write_lattice(df: DataFrame, path: str, buckets: int = 16) -> None:
    """Parquet in folders by a bucket of the sentence, so that a lookup reads one of them."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64("sentence_id"), F.lit(buckets)).cast("int"))
    out.repartition("bucket").sortWithinPartitions("sentence_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Lines ``id<TAB>token`` in id order, in one sorted set of files."""
    vocab.orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), F.coalesce("token", F.lit("")))).write.mode("overwrite").text(path)


def nine_digits(col: Column) -> Column:
    """A double as C's %.9g writes it: nine significant digits without trailing zeros."""
    text = F.format_string("%.8e", F.abs(col))
    digits = F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit(""))
    power = F.substring_index(text, "e", -1).cast("int")
    strip = lambda c: F.regexp_replace(c, r"\.?0*$", "")
    whole = F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(9)))
    part = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.concat(strip(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), F.lit(8)))), F.lit("e"), F.substring_index(text, "e", -1))
    fixed = F.when((power >= 9) | (power < -4), wide).when(power >= 0, strip(whole)).otherwise(strip(part))
    return F.concat(F.when(col < 0, "-").otherwise(""), fixed)


def golden_json(paths: DataFrame) -> DataFrame:
    """(sentence_id, value): a sentence's ranked paths as JSON, scores with nine significant digits."""
    score = nine_digits(F.col("score"))
    nodes = F.concat(F.lit("["), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ","), F.lit("]"))
    one = F.concat(F.lit('{"score":'), score, F.lit(',"nodes":'), nodes, F.lit("}"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", one.alias("x"))))
    body = F.array_join(F.transform("p", lambda s: s["x"]), ",")
    grouped = paths.groupBy("sentence_id").agg(ordered.alias("p"))
    return grouped.select("sentence_id", F.concat(F.lit('{"sentence_id":'), F.col("sentence_id").cast("string"), F.lit(',"paths":['), body, F.lit("]}")).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """A headed CSV file set, for histograms and benchmark rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_candidates(paths: DataFrame, k: int, path: str) -> None:
    """Candidate paths below a folder ``K=k``; other values of K stay."""
    paths.withColumn("K", F.lit(k)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("K").parquet(path)


def write_manifest(df: DataFrame, text: str, key: str, path: str) -> None:
    """The texts as lines in key order, and beside them (row, key), so that results can be joined by row."""
    from ..functions.features import global_rank

    rows = global_rank(df.select(key, text), [F.asc(key)], "row")
    rows.orderBy("row").select(F.coalesce(F.regexp_replace(text, r"[\r\n]+", " "), F.lit(""))).write.mode("overwrite").text(f"{path}/text")
    rows.select("row", key).write.mode("overwrite").parquet(f"{path}/manifest")


def link_by_row(manifest: DataFrame, results: DataFrame, row: str) -> DataFrame:
    """Results joined to the manifest by row number, without the number; an error if they have unlike numbers of rows."""
    sizes = [df.agg(F.count("*").alias("n")).scalar() for df in (manifest, results)]
    wrong = F.raise_error(F.concat(F.lit("manifest and results have unlike numbers of rows: "), sizes[0].cast("string"), F.lit(", "), sizes[1].cast("string")))
    checked = manifest.withColumn(row, F.when(sizes[0] == sizes[1], F.col(row)).otherwise(wrong.cast("long")))
    return checked.join(results, row).drop(row)


def swap_in(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a Parquet folder whole: write beside it, keep the old one as .bak, move in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.new", f"{path}.bak"
    df.write.mode("overwrite").parquet(new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))


# -- files, documents, remote tables ---------------------------------------------------------------


def write_files(rows: DataFrame, name: str, content: str, folder: str) -> None:
    """One file per row, by its name; a null content is an empty file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                write_file(f"{folder}/{file}", (data or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    rows.where(F.col(name).isNotNull()).select(F.col(name).cast("string"), F.col(content).cast("string")).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def copy_sample(spark: SparkSession, folder: str, target: str, n: int, seed: int) -> DataFrame:
    """Copy n files chosen by a hash of seed and stem, whole and under their names; returns (stem, bytes)."""
    from ..operators.stats import seeded_sample

    chosen = seeded_sample(_listed(spark, folder), "stem", n, seed)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, stem in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                data = read_file(path)
                write_file(f"{target}/{path.rsplit('/', 1)[-1]}", data)
                rows.append((stem, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["stem", "bytes"])

    return chosen.mapInArrow(run, "stem string, bytes long").checkpoint()


def write_documents(documents: DataFrame, folder: str, buckets: int = 8) -> None:
    """(idx, text) as compressed documents in folders by a bucket of idx, so that a lookup reads one of them."""
    import zlib

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            packed = [None if t is None else zlib.compress(t.encode("utf-8")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["idx", "document"])

    packed = documents.select(F.col("idx").cast("long"), "text").mapInArrow(run, "idx long, document binary")
    packed.withColumn("bucket", F.pmod("idx", F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_documents(spark: SparkSession, folder: str, idx: int | None = None, buckets: int = 8) -> DataFrame:
    """(idx, text) of the stored documents; of one idx, only its bucket is read. No row: there is no such document."""
    import zlib

    rows = spark.read.parquet(folder)
    if idx is not None:
        rows = rows.where((F.col("bucket") == idx % buckets) & (F.col("idx") == idx))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [None if d is None else zlib.decompress(d).decode("utf-8") for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["idx", "text"])

    return rows.select("idx", "document").mapInArrow(run, "idx long, text string")


def read_dataset(spark: SparkSession, uri: str, split: str) -> DataFrame:
    """One split of a Parquet dataset at an address that Spark's file systems know: all files named after it."""
    return spark.read.option("pathGlobFilter", f"{split}*.parquet").option("recursiveFileLookup", "true").parquet(uri)
