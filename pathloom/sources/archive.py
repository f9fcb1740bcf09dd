"""Lattices as archives of flat arrays (NPZ), and as folders of one array per file (a cache).

An archive holds whole sentences: node columns as arrays over all nodes, edges as a forward offset
array and a list of ends, sentences and gold paths as offset arrays. Reading turns it into rows that
carry their sentence and their node's number in it; writing gathers sentences and makes archives of
a bounded number of them, one after another in every task. No pickled members are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import filesystem, list_files, write_file

# Names of raw members and the names under which the rest of a pipeline knows them.
RENAMED = {"node_length": "node_word_length", "rowptr": "row_ptr", "colidx": "col_idx", "topolevel": "topo_level", "goldpathmask": "gold_path_mask"}
# Members that a lattice must or may have, and their types.
REQUIRED = {"row_ptr": "int32", "col_idx": "int32", "topo_level": "int32", "sentence_offsets": "int32"}
OPTIONAL = {"gold_path_mask": "int8", "node_word_length": "int32", "gold_path_nodes": "int32", "gold_path_offsets": "int32"}
NODE_COLUMNS = {
    "tag_id": "node_features", "length": "node_word_length", "position": "node_position", "chunk": "node_chunk", "form_id": "node_form_id",
    "lemma_id": "node_lemma_id", "preverb_id": "node_preverb_id", "char_start": "node_char_start", "topo_level": "topo_level",
}
PER_ARCHIVE = 4_096


# -- one archive ---------------------------------------------------------------------------------


def load(data: bytes, names: list[str] | None = None) -> dict[str, np.ndarray]:
    """The members of an archive under their later names, offsets closed; only the asked ones are read.

    Raw archives leave the total out of the sentence offsets; it is added.
    """
    archive = np.load(io.BytesIO(data), allow_pickle=False)
    known = {RENAMED.get(n, n): n for n in archive.files}
    want = set(known) if names is None else {n for n in names if n in known}
    out = {n: archive[known[n]] for n in want}
    if "sentenceoffsets" in known and (names is None or "sentence_offsets" in names):
        out.pop("sentenceoffsets", None)
        total = len(out["topo_level"]) if "topo_level" in out else len(archive[known["topo_level"]])
        out["sentence_offsets"] = np.append(archive["sentenceoffsets"], total).astype(np.int32)
    return out


def checked(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays, if all required ones are there, types are as they must be and offsets span; else an error that names the field."""
    for name, kind in (REQUIRED | OPTIONAL).items():
        if name not in arrays:
            if name in REQUIRED:
                raise ValueError(f"required array {name} is missing")
            continue
        if str(arrays[name].dtype) != kind:
            raise ValueError(f"array {name} is {arrays[name].dtype}, must be {kind}")
    n = len(arrays["topo_level"])
    for name, total, size in (("row_ptr", len(arrays["col_idx"]), n + 1), ("sentence_offsets", n, None)):
        offsets = arrays[name]
        if not len(offsets) or (size is not None and len(offsets) != size) or offsets[0] != 0 or offsets[-1] != total or (np.diff(offsets) < 0).any():
            raise ValueError(f"offsets {name} do not span {total} entries")
    return arrays


def node_rows(arrays: dict[str, np.ndarray], columns: list[str]) -> dict[str, np.ndarray]:
    """sentence, node (its number in the sentence), gold, and the asked columns; an absent optional one is -1, or false."""
    offsets = arrays["sentence_offsets"].astype(np.int64)
    n, size = int(offsets[-1]), np.diff(offsets)
    out = {"sentence": np.repeat(np.arange(len(size)), size), "node": np.arange(n) - np.repeat(offsets[:-1], size)}
    out["gold"] = np.asarray(arrays.get("gold_path_mask", np.zeros(n, np.int8))) != 0
    for c in columns:
        out[c] = np.asarray(arrays.get(NODE_COLUMNS[c], np.full(n, -1)))[:n].astype(np.int32)
    return out


def edge_rows(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """sentence, src and dst, as numbers in the sentence, of all edges."""
    offsets = arrays["sentence_offsets"].astype(np.int64)
    src = np.repeat(np.arange(len(arrays["row_ptr"]) - 1), np.diff(arrays["row_ptr"]))
    sentence = np.searchsorted(offsets, src, side="right") - 1
    return {"sentence": sentence, "src": src - offsets[sentence], "dst": arrays["col_idx"].astype(np.int64) - offsets[sentence]}


def pack(sentences: list[tuple[int, list[dict], list[dict], str | None]], raw: bool) -> bytes:
    """An archive of (id, nodes, edges, text): nodes in order, edges between their numbers."""
    nodes = [n for _, ns, _, _ in sentences for n in ns]
    sizes = np.array([len(ns) for _, ns, _, _ in sentences], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    column = lambda c, kind=np.int32: np.array([-1 if n[c] is None else n[c] for n in nodes], dtype=kind)
    arrays = {member: column(c) for c, member in NODE_COLUMNS.items()}
    src = np.array([e["src"] + b for (_, _, es, _), b in zip(sentences, base, strict=True) for e in es], dtype=np.int64)
    dst = np.array([e["dst"] + b for (_, _, es, _), b in zip(sentences, base, strict=True) for e in es], dtype=np.int32)
    order = np.lexsort((dst, src))
    arrays["row_ptr"] = np.searchsorted(src[order], np.arange(len(nodes) + 1)).astype(np.int32)
    arrays["col_idx"] = dst[order]
    arrays["gold_path_mask"] = np.array([bool(n["is_gold"]) for n in nodes], dtype=np.int8)
    gold = [[b + i for i, n in enumerate(ns) if n["is_gold"]] for (_, ns, _, _), b in zip(sentences, base, strict=True)]
    arrays["gold_path_nodes"] = np.array([g for path in gold for g in path], dtype=np.int32)
    arrays["gold_path_offsets"] = np.cumsum([0, *map(len, gold)]).astype(np.int32)
    texts = [(t or "").encode("utf-8") for *_, t in sentences]
    arrays["surface_text"] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    arrays["surface_text_offsets"] = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    arrays["sentence_ids"] = np.array([i for i, *_ in sentences], dtype=np.int64)
    offsets = np.cumsum([0, *sizes]).astype(np.int32)
    if raw:
        back = {later: first for first, later in RENAMED.items()}
        arrays = {back.get(n, n): a for n, a in arrays.items()} | {"sentenceoffsets": offsets[:-1]}
    else:
        arrays["sentence_offsets"] = offsets
    return _zipped(arrays)


def _zipped(arrays: dict[str, np.ndarray], compressed: bool = True) -> bytes:
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, **arrays)
    return out.getvalue()


# -- tables --------------------------------------------------------------------------------------


def gathered(nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(sentence_id, nodes, edges, text): a sentence's nodes in node order, its edges between their numbers, its text."""
    columns = [c for c in NODE_COLUMNS if c != "topo_level"]
    n = nodes.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "topo_level", *columns, "is_gold"))).alias("nodes"))
    e = edges.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("links"))
    joined = n.join(e, "sentence_id", "left").join(texts, "sentence_id", "left")
    place = lambda end: (F.array_position("nodes.node_id", end) - 1).cast("int")
    numbered = F.transform(F.coalesce("links", F.array().cast(e.schema["links"].dataType)), lambda x: F.struct(place(x["src"]).alias("src"), place(x["dst"]).alias("dst")))
    return joined.select("sentence_id", "nodes", numbered.alias("edges"), "text")


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def write_archives(lattices: DataFrame, folder: str, raw: bool = False, per_archive: int = PER_ARCHIVE) -> None:
    """Archives of at most ``per_archive`` sentences; names come from partitions, so a task that runs again writes the same files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        number = 0

        def flush() -> int:
            write_file(f"{folder}/part-{_task():05d}-{number:05d}.npz", pack(held, raw))
            return len(held)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                if len(held) == per_archive:
                    yield pa.RecordBatch.from_arrays([pa.array([flush()], pa.int64())], names=["sentences"])
                    held, number = [], number + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([flush()], pa.int64())], names=["sentences"])

    lattices.select("sentence_id", "nodes", "edges", "text").mapInArrow(run, "sentences long").agg(F.sum("sentences")).collect()


def read_archives(spark: SparkSession, folder: str, what: str = "nodes", columns: list[str] | None = None) -> DataFrame:
    """Rows of all archives below a folder: one file is one task's work, and only the members that are needed are unpacked.

    nodes: (file, sentence_id, node, gold, <columns>); edges: (file, sentence_id, src, dst). Archives
    without sentence ids number their sentences from 0. Missing or mistyped required members are errors.
    """
    columns = list(NODE_COLUMNS) if columns is None else columns
    fields = [("node", "int"), ("gold", "boolean"), *((c, "int") for c in columns)] if what == "nodes" else [("src", "int"), ("dst", "int")]
    members = [*REQUIRED, "sentence_ids", "gold_path_mask", *(NODE_COLUMNS[c] for c in columns)] if what == "nodes" else [*REQUIRED, "sentence_ids"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                arrays = checked(load(data.as_py(), members))
                rows = node_rows(arrays, columns) if what == "nodes" else edge_rows(arrays)
                sentence = rows.pop("sentence")
                ids = arrays.get("sentence_ids", np.arange(len(arrays["sentence_offsets"]) - 1))[sentence]
                kinds = {"int": pa.int32(), "boolean": pa.bool_()}
                out = [pa.array([path] * len(ids)), pa.array(ids, pa.int64()), *(pa.array(rows[n], kinds[k]) for n, k in fields)]
                yield pa.RecordBatch.from_arrays(out, names=["file", "sentence_id", *(n for n, _ in fields)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, sentence_id long, " + ", ".join(f"{n} {k}" for n, k in fields))


# -- caches --------------------------------------------------------------------------------------


def extract(spark: SparkSession, folder: str, cache: str) -> DataFrame:
    """Copy every member of every archive to ``cache``/<archive>/<member>.npy; returns (archive, member, entries).

    Members go under their later names, offsets are closed. One archive is one task's work.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stem, rows = path.rsplit("/", 1)[-1].removesuffix(".npz"), []
                for name, array in sorted(load(data.as_py()).items()):
                    out = io.BytesIO()
                    np.save(out, array, allow_pickle=False)
                    write_file(f"{cache}/{stem}/{name}.npy", out.getvalue())
                    rows.append((stem, name, len(array)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], names=["archive", "member", "entries"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "content")
    return files.mapInArrow(run, "archive string, member string, entries long").checkpoint()


def _mapped(path: str) -> np.ndarray:
    """An array file: mapped into memory where the folder is local, else read."""
    from pyarrow import fs

    system, inner = filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(inner, mmap_mode="r", allow_pickle=False)
    with system.open_input_file(inner) as source:
        return np.load(io.BytesIO(source.read()), allow_pickle=False)


def scan_cache(spark: SparkSession, cache: str, columns: list[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """(sentence_id, node, <columns>) of a cache: only the asked columns' files are touched, in ranges of whole sentences."""
    folders = sorted({p.rsplit("/", 1)[0] for p in list_files(cache, "topo_level.npy")})
    schema = "sentence_id long, node int, " + ", ".join(f"{c} int" for c in columns)

    def ranges(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                offsets = _mapped(f"{folder}/sentence_offsets.npy")
                cuts = np.unique(np.r_[0, np.searchsorted(offsets, np.arange(rows_per_task, int(offsets[-1]), rows_per_task)), len(offsets) - 1])
                yield pa.RecordBatch.from_arrays([pa.array([folder] * (len(cuts) - 1)), pa.array(cuts[:-1]), pa.array(cuts[1:])], names=["folder", "first", "last"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for folder, first, last in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                offsets = _mapped(f"{folder}/sentence_offsets.npy")[first : last + 1].astype(np.int64)
                ids, size = _mapped(f"{folder}/sentence_ids.npy")[first:last], np.diff(offsets)
                node = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
                values = [np.asarray(_mapped(f"{folder}/{NODE_COLUMNS[c]}.npy")[offsets[0] : offsets[-1]]) for c in columns]
                arrays = [pa.array(np.repeat(ids, size), pa.int64()), pa.array(node, pa.int32()), *(pa.array(v, pa.int32()) for v in values)]
                yield pa.RecordBatch.from_arrays(arrays, names=["sentence_id", "node", *columns])

    rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders)))
    return rows.mapInArrow(ranges, "folder string, first long, last long").repartition(max(1, 2 * len(folders))).mapInArrow(run, schema)


def repack(spark: SparkSession, cache: str, folder: str) -> DataFrame:
    """Archives from the folders of a cache: (archive, nodes, edges, sentences); wrong types or offsets are errors."""
    folders = sorted({p.rsplit("/", 1)[0] for p in list_files(cache, "topo_level.npy")})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for source in batch.column(0).to_pylist():
                arrays = checked({p.rsplit("/", 1)[-1].removesuffix(".npy"): np.asarray(_mapped(p)) for p in list_files(source, ".npy")})
                stem = source.rsplit("/", 1)[-1]
                write_file(f"{folder}/{stem}.npz", _zipped(arrays, compressed=False))
                sizes = [len(arrays["topo_level"]), len(arrays["col_idx"]), len(arrays["sentence_offsets"]) - 1]
                yield pa.RecordBatch.from_arrays([pa.array([stem]), *(pa.array([s], pa.int64()) for s in sizes)], names=["archive", "nodes", "edges", "sentences"])

    rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders)))
    return rows.mapInArrow(run, "archive string, nodes long, edges long, sentences long").checkpoint()


# -- features ------------------------------------------------------------------------------------


def write_features(vectors: DataFrame, folder: str, name: str, width: int) -> None:
    """Node vectors (sentence_id, node_id, x) as archives with their width and the featurizer's name, one per batch of rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for i, batch in enumerate(batches):
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
            if batch.num_rows and x.shape[1] != width:
                raise ValueError(f"vectors have {x.shape[1]} columns, {name} has {width}")
            arrays = {"sentence_ids": batch.column(0).to_numpy(zero_copy_only=False), "node_ids": batch.column(1).to_numpy(zero_copy_only=False), "node_features": x}
            write_file(f"{folder}/part-{_task():05d}-{i:05d}.npz", _zipped(arrays | {"feat_dim": np.int64(width), "featurizer_name": np.str_(name)}))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])

    vectors.select("sentence_id", "node_id", "x").mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def read_features(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """(sentence_id, node_id, x, featurizer_name); an archive whose width is not the declared one, or of another featurizer, is an error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                a = np.load(io.BytesIO(data.as_py()), allow_pickle=False)
                x, made = a["node_features"], str(a["featurizer_name"])
                if x.shape[1] != int(a["feat_dim"]) or (name is not None and made != name):
                    raise ValueError(f"features of {made} with {x.shape[1]} columns, declared {int(a['feat_dim'])}, asked {name}")
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                arrays = [pa.array(a["sentence_ids"], pa.int64()), pa.array(a["node_ids"], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())), pa.array([made] * len(x))]
                yield pa.RecordBatch.from_arrays(arrays, names=["sentence_id", "node_id", "x", "featurizer_name"])

    schema = T.StructType(
        [T.StructField("sentence_id", T.LongType()), T.StructField("node_id", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType())), T.StructField("featurizer_name", T.StringType())]
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("content")
    return files.mapInArrow(run, schema)
