"""Archives, caches, document stores, benchmark files and sharded runs: written, read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import translit
from ..functions.features import split_name
from ..operators import lattice as L
from ..operators import maps, runs
from ..operators import metrics as M
from ..operators import scorers as SC
from ..operators.sweep import level_sweep
from ..sources import archive, graphml
from ..sources import tables as S
from ..tables import ensure_checkpoint_dir, table
from .evaluation import gold_paths
from .features import _TEXT, _featurized, texts
from .io import _graph
from .lattice import EDGES, INTEGER_WEIGHT, NODES, base
from .lattice import SQL as _LATTICE_SQL


def _archives(spark: SparkSession, sf_dir: str, raw: bool) -> str:
    nodes, edges = base(spark, sf_dir)
    folder = S.scratch(spark, "archives")
    archive.write_archives(archive.gathered(nodes, edges, texts(spark, sf_dir).select("sentence_id", F.col("surface_text").alias("text"))), folder, raw)
    return folder


def s09_raw_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from raw archives: members renamed, offsets closed."""
    return archive.read_archives(spark, _archives(spark, sf_dir, True), "nodes").drop("file")


def s14_archive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.read_archives(spark, _archives(spark, sf_dir, False), "edges").drop("file")


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    ensure_checkpoint_dir(spark)
    cache = S.scratch(spark, "cache")
    return archive.extract(spark, _archives(spark, sf_dir, True), cache), cache


def s16_split_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per member over all archives; of offsets, the spans they close."""
    copied, _ = _cache(spark, sf_dir)
    spans = F.col("member").endswith("offsets") | (F.col("member") == "row_ptr")
    return copied.groupBy("member").agg(F.sum(F.col("entries") - spans.cast("int")).alias("entries"))


def s11_cache_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of the cache; no other file is touched."""
    rows = archive.scan_cache(spark, _cache(spark, sf_dir)[1], ["form_id", "length"], rows_per_task=5_000)
    return rows.select("sentence_id", "node", "form_id", "length")


def s24_repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as archives again, types and offsets asserted, and its nodes read back."""
    folder = S.scratch(spark, "repacked")
    made = archive.repack(spark, _cache(spark, sf_dir)[1], folder).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), F.sum("sentences").alias("sentences"))
    back = archive.read_archives(spark, folder, "nodes", ["length"]).agg(F.count("*").alias("read"), F.sum(F.col("gold").cast("int")).alias("gold"), F.sum("length").alias("letters"))
    return back.select("*", *[made.select(c).scalar().alias(c) for c in ("nodes", "edges", "sentences")])


def s15_feature_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors through archives that name their featurizer and width."""
    folder = S.scratch(spark, "features")
    archive.write_features(_featurized(spark, sf_dir, "morph43"), folder, "morph43", 64)
    back = archive.read_features(spark, folder, "morph43")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return back.select("sentence_id", "node_id", "featurizer_name", F.size("x").alias("width"), total.alias("ones"))


def s13_weight_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges scored by the matrices of a weight file, read through the binary source and checked by its magic number."""
    path = f"{S.scratch(spark, 'weights')}/biaffine.bin"
    S.write_weights(path, [[1.0, 0.0, 0.5], [0.0, 1.0, 0.0]], [[2.0, 0.0, 1.0], [0.0, 1.0, 1.0]], 0.5)
    nodes, edges = base(spark, sf_dir)
    x = nodes.select("sentence_id", "node_id", F.array(*[F.col(c).cast("double") for c in ("length", "position", "chunk")]).alias("x"))
    scored = SC.biaffine(x, edges, *S.read_weights(spark, path))
    return scored.groupBy("sentence_id").agg(F.round(F.sum("w"), 4).alias("total"), F.max("w").alias("most"), F.count("*").alias("n"))


# -- benchmark files -----------------------------------------------------------------------------

KS = (1, 4, 16)
RUNS = {"length": "length", "length and form": INTEGER_WEIGHT}


def _bench_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (run, k, sentences, paths, table_bytes, recall) of two scorers, written as CSV and read back."""
    path = S.scratch(spark, "bench")
    raw, out = table(spark, sf_dir, "nodes"), None
    nodes = L.clean_nodes(raw).agg(F.count("*").alias("nodes"))
    for name, weight in RUNS.items():
        paths = level_sweep(raw, F.expr(weight), "kbest", max(KS)).withColumn("nodes", M.strip(F.col("nodes")))
        g = gold_paths(raw).select("sentence_id", F.col("nodes").alias("g"))
        per = paths.join(g, "sentence_id", "left").groupBy("sentence_id").agg(F.count("*").alias("n"), F.bool_or(F.col("g").isNotNull()).alias("has"), F.min(F.when(F.col("nodes") == F.col("g"), F.col("rank"))).alias("hit"))
        one = per.agg(F.count("*").alias("sentences"), F.count_if("has").alias("golds"), *[F.sum(F.least("n", F.lit(k))).alias(f"p{k}") for k in KS], *[F.count_if(F.col("hit") < k).alias(f"h{k}") for k in KS])
        rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("paths"), F.round(F.col(f"h{k}") / F.col("golds"), 6).alias("recall")) for k in KS])).alias("r")
        # a beam entry is a score, a parent and a rank of four bytes each
        each = one.select(F.lit(name).alias("run"), "sentences", nodes.scalar().alias("nodes"), rows).select("run", "r.k", "sentences", "r.paths", (F.col("nodes") * F.col("r.k") * 12).alias("table_bytes"), "r.recall")
        out = each if out is None else out.unionByName(each)
    S.write_csv(out, path)
    return spark.read.option("header", True).schema("run string, k int, sentences long, paths long, table_bytes long, recall double").csv(path)


def s21_benchmark_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench_file(spark, sf_dir)


def v06_benchmark_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark file as lines of a report: one table per run, and a matrix of recall, K by run."""
    rows = _bench_file(spark, sf_dir)
    cell = F.format_string("| %d | %d | %d | %.6f |", "k", "paths", "table_bytes", "recall")
    head = rows.select("run").distinct().select("run", F.lit(0).alias("k"), F.lit("| k | paths | table_bytes | recall |").alias("text"))
    by_run = F.array_sort(F.collect_list(F.struct("run", F.format_string("%.6f", "recall").alias("r"))))
    matrix = rows.groupBy("k").agg(by_run.alias("c")).select(F.lit("recall, K by run").alias("run"), "k", F.concat(F.lit("| "), F.col("k").cast("string"), F.lit(" | "), F.array_join("c.r", " | "), F.lit(" |")).alias("text"))
    return head.unionByName(rows.select("run", "k", cell.alias("text"))).unionByName(matrix).withColumnRenamed("run", "section").withColumnRenamed("k", "line")


def v07_run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the benchmark file side by side by K: ratios and differences."""
    rows = _bench_file(spark, sf_dir)
    side = lambda run, p: rows.where(F.col("run") == run).select("k", *[F.col(c).alias(p + c) for c in ("paths", "table_bytes", "recall")])
    old, new = RUNS
    both = side(old, "old_").join(side(new, "new_"), "k")
    growth = F.round(F.col("new_table_bytes") / F.first("new_table_bytes").over(W.orderBy("k")), 6).alias("growth")  # as many rows as there are Ks
    return both.select("k", F.round(F.try_divide("new_paths", "old_paths"), 6).alias("paths_ratio"), F.round(F.col("new_recall") - F.col("old_recall"), 6).alias("recall_gain"), growth)


# -- documents, files, datasets ------------------------------------------------------------------


def s25_document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph documents compressed into a store by number, and read back."""
    folder = S.scratch(spark, "documents")
    nodes, edges = base(spark, sf_dir)
    n = nodes.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), F.col("topo_level").alias("level"), F.col("is_gold").alias("gold")))).alias("nodes"))
    e = edges.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("edges"))
    S.write_documents(n.join(e, "sentence_id", "left").select(F.col("sentence_id").alias("idx"), F.to_json(F.struct("nodes", "edges")).alias("text")), folder)
    return S.read_documents(spark, folder).select("idx", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def _file_set(spark: SparkSession, sf_dir: str) -> str:
    folder = S.scratch(spark, "files")
    rows = table(spark, sf_dir, "lemma_map").select(F.concat(F.col("map_id").cast("string"), F.lit(".txt")).alias("name"), "map_key")
    S.write_files(rows, "name", "map_key", folder)
    return folder


def s04_sorted_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred file names of a folder: the limit is the feature."""
    return S.stems(spark, _file_set(spark, sf_dir), 100)


def s27_file_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty files chosen by a seed, copied whole: a sampling operator."""
    ensure_checkpoint_dir(spark)
    target = S.scratch(spark, "sample")
    copied = S.copy_sample(spark, _file_set(spark, sf_dir), target, 50, 7)
    return copied.join(S.stems(spark, target), "stem").select("stem", "bytes")


def s28_remote_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The train split of a Parquet dataset, by the address of its folder."""
    folder = S.scratch(spark, "dataset")
    rows = table(spark, sf_dir, "lemma_list").select("lemma_id", "lemma")
    S_, part = S.scratch(spark, "dataset-parts"), F.when(F.col("lemma_id") % 10 == 0, "test").otherwise("train")
    rows.withColumn("split", part).write.partitionBy("split").parquet(S_)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs.mkdirs(at(folder))
    for split in ("train", "test"):
        for i, status in enumerate(fs.globStatus(at(f"{S_}/split={split}/*.parquet"))):
            fs.rename(status.getPath(), at(f"{folder}/{split}-{i:05d}.parquet"))
    return S.read_dataset(spark, folder, "train").select("lemma_id", "lemma")


def s02_graphml_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per chunk from documents whose edges are never built."""
    path = S.scratch(spark, "graphml")
    graphml.write_graphml(*_graph(spark, sf_dir), path)
    words = graphml.parse_words(spark.read.text(path), ["word", "chunk_no"])
    return words.groupBy("stem", F.col("chunk_no").cast("int").alias("chunk_no")).agg(F.count("*").alias("nodes"), F.count_distinct("word").alias("words"))


def s05_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated words from JSON lines of per-chunk lists: one row per word, chunks from 1."""
    path = S.scratch(spark, "annotations")
    g = L.clean_nodes(table(spark, sf_dir, "nodes")).where("is_gold")
    per = g.groupBy("sentence_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("topo_level", "node_id", F.col("lemma_id").cast("string").alias("l"), F.col("tag_id").cast("string").alias("c")))).alias("x"))
    doc = per.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("x.l").alias("l"), F.col("x.c").alias("c")))).alias("y"))
    doc.select(F.col("sentence_id").cast("string"), F.col("y.l").alias("lemmas"), F.col("y.c").alias("cng")).write.json(path)
    return S.read_annotations(spark, path).select(F.col("stem").cast("long").alias("sentence_id"), "chunk", "place", "lemma", "code")


# -- runs, guards, choices -----------------------------------------------------------------------


def s32_sharded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards of work: two are done, the run is taken up again, and the outputs are merged."""
    folder = S.scratch(spark, "shards")
    nodes = table(spark, sf_dir, "nodes").where("sentence_id is not null and node_id is not null").select("sentence_id", "node_id", "is_gold")
    work = lambda rows: rows.distinct().groupBy("sentence_id").agg(F.count("*").alias("nodes"), F.count_if("is_gold").alias("gold"))
    first = runs.run_shards(nodes, "sentence_id", 4, folder, work, max_new=2)
    again = runs.run_shards(nodes, "sentence_id", 4, folder, work)
    new = F.col("shard").isin(first) if first else F.lit(False)
    merged = runs.merge(spark, folder, 4).groupBy("shard").agg(F.count("*").alias("sentences"), F.sum("nodes").alias("nodes"), F.sum("gold").alias("gold"))
    return merged.select("shard", "sentences", "nodes", "gold", F.when(new, "first").when(F.col("shard").isin(again), "again").alias("run"))


def filter_p10_leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splits by MD5 are disjoint, or the query fails and says what leaks."""
    ids = table(spark, sf_dir, "sentences").select("sentence_id").where("sentence_id is not null")
    side = lambda name: ids.where(split_name(F.col("sentence_id")) == name)
    return maps.require_disjoint(side("train"), side("test"), "sentence_id", "train and test")


def filter_p13_gold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explicit gold path where there is one (here: even sentences), else the walk by the mask, if it is unique."""
    raw = table(spark, sf_dir, "nodes")
    gold = gold_paths(raw)
    explicit = gold.where("sentence_id % 2 = 0").select("sentence_id", F.col("nodes").alias("explicit"))
    # the mask is a walk if each gold node but the last has one gold successor: one per level, no level left out
    levels = raw.where("is_gold and node_id is not null").select("sentence_id", "node_id", "topo_level").distinct().groupBy("sentence_id")
    walks = levels.agg((F.count_distinct("topo_level") == F.count("*")).alias("one"), (F.max("topo_level") - F.min("topo_level") + 1 == F.count("*")).alias("dense")).where("one and dense")
    legacy = gold.join(walks, "sentence_id", "left_semi").select("sentence_id", F.col("nodes").alias("legacy"))
    kind = F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("legacy").isNotNull(), "legacy").otherwise("none")
    path = F.array_join(F.transform(F.coalesce("explicit", "legacy", F.array().cast("array<int>")), lambda n: n.cast("string")), "-")
    return gold.select("sentence_id").join(explicit, "sentence_id", "left").join(legacy, "sentence_id", "left").select("sentence_id", kind.alias("kind"), path.alias("path"))


def f07_devanagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lemma_list").select("lemma_id", translit.slp1_to_devanagari_column(F.col("lemma")).alias("devanagari"))


QUERIES = {
    f.__name__: f
    for f in (
        s02_graphml_words, s04_sorted_stems, s05_annotations, s09_raw_archive, s11_cache_scan, s13_weight_file, s14_archive_edges, s15_feature_archive, s16_split_cache,
        s21_benchmark_csv, s24_repack, s25_document_store, s27_file_sample, s28_remote_dataset, s32_sharded_run, v06_benchmark_tables, v07_run_comparison,
        filter_p10_leakage_guard, filter_p13_gold_choice, f07_devanagari,
    )
}

_LOCAL = "ln as (select *, row_number() over (partition by sentence_id order by node_id) - 1 as node from n)"


def _bench_sql() -> str:
    from .ladder import _STEPS, _best

    parts = []
    for name in RUNS:
        w = _STEPS[name]
        rows = " union all ".join(
            f"select {k} as k, count(*) filter (where rank < {k}) as paths, round(count(distinct case when rank < {k} and p = g then sentence_id end) / (select count(*) from gp), 6) as recall, count(distinct sentence_id) as sentences from pp left join gp using (sentence_id)" for k in KS
        )
        parts.append(f"select * from ({_best(w, max(KS))}, gp as (select sentence_id, list(node_id order by topo_level, node_id) as g from n where is_gold group by sentence_id), b as ({rows}) select '{name}' as run, k, sentences, paths, (select count(*) from n) * k * 12 as table_bytes, recall from b)")
    return " union all ".join(parts)


_BENCH = f"bf as materialized ({_bench_sql()})"
_V04 = f"""{EDGES}, x as (select sentence_id, '[' || string_agg('{{"id":' || node_id || ',"level":' || topo_level || ',"gold":' || is_gold || '}}', ',' order by node_id) || ']' as ns from n group by 1),
y as (select sentence_id, '[' || string_agg('{{"source":' || src || ',"target":' || dst || '}}', ',' order by src, dst) || ']' as es from e group by 1)"""
_MEMBERS = {**dict.fromkeys(["node_features", "node_word_length", "node_position", "node_chunk", "node_form_id", "node_lemma_id", "node_preverb_id", "node_char_start", "topo_level", "gold_path_mask", "row_ptr"], "n"),
            **dict.fromkeys(["sentence_offsets", "gold_path_offsets", "surface_text_offsets", "sentence_ids"], "s"), "col_idx": "e", "gold_path_nodes": "g", "surface_text": "b"}
_MARKS = {"e": "(select count(*) from e)", "n": "(select count(*) from n)", "s": "(select count(distinct sentence_id) from n)", "g": "(select count(*) from n where is_gold)",
          "b": "(select coalesce(sum(strlen(surface_text)), 0)::bigint from t semi join n using (sentence_id))"}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(d: dict[str, str]) -> str:
    return f"map({_list(list(d))}, {_list(list(d.values()))})"


SQL = {
    "s02_graphml_words": f"with {NODES} select sentence_id::varchar as stem, chunk as chunk_no, count(*) as nodes, count(distinct nullif(f.token, '')) as words from n left join vocab f on f.kind = 'form' and f.id = n.form_id group by 1, 2",
    "s04_sorted_stems": "select map_id::varchar as stem from lemma_map order by 1 limit 100",
    "s05_annotations": f"with {NODES} select sentence_id, dense_rank() over (partition by sentence_id order by chunk) as chunk, row_number() over (partition by sentence_id, chunk order by topo_level, node_id) - 1 as place, lemma_id::varchar as lemma, tag_id::varchar as code from n where is_gold",
    "s09_raw_archive": f"with {NODES}, {_LOCAL} select sentence_id, node, is_gold as gold, tag_id, length, position, chunk, form_id, lemma_id, preverb_id, char_start, topo_level from ln",
    "s11_cache_scan": f"with {NODES}, {_LOCAL} select sentence_id, node, form_id, length from ln",
    "s13_weight_file": _LATTICE_SQL["m04_biaffine"],
    "s14_archive_edges": f"with {EDGES}, {_LOCAL} select e.sentence_id, a.node as src, b.node as dst from e join ln a on a.sentence_id = e.sentence_id and a.node_id = e.src join ln b on b.sentence_id = e.sentence_id and b.node_id = e.dst",
    "s15_feature_archive": f"""with {NODES}, q as (select id, len(list_filter({X.TAG_TOKENS!r}, lambda k: list_contains(string_split_regex(replace(token, '.', ' '), '\\s+'), k))) + (token = 'UNKNOWN')::int as k from vocab where kind = 'tag')
select sentence_id, node_id, 'morph43' as featurizer_name, 64 as width, case when chunk < 0 then 0 else coalesce(q.k, 0) end::double as ones from n left join q on q.id = n.tag_id""",
    "s16_split_cache": f"with {EDGES}, {_TEXT} " + " union all ".join(f"select '{m}' as member, {_MARKS[k]} as entries" for m, k in _MEMBERS.items()),
    "s21_benchmark_csv": f"with {_BENCH} select * from bf",
    "s24_repack": f"with {EDGES} select (select count(*) from n) as nodes, (select count(*) from e) as edges, (select count(distinct sentence_id) from n) as sentences, count(*) as read, count(*) filter (where is_gold) as gold, sum(length)::bigint as letters from n",
    "s25_document_store": f"""with {_V04} select sentence_id as idx, md5('{{"nodes":' || ns || case when es is not null then ',"edges":' || es else '' end || '}}') as digest from x left join y using (sentence_id)""",
    "s27_file_sample": "select map_id::varchar as stem, strlen(coalesce(map_key, ''))::bigint as bytes from lemma_map order by md5('7-' || map_id), map_id::varchar limit 50",
    "s28_remote_dataset": "select lemma_id, lemma from lemma_list where lemma_id % 10 <> 0",
    "s32_sharded_run": f"with {NODES}, b as (select sentence_id, (('0x' || substr(md5(sentence_id::varchar), 1, 8))::bigint % 4)::int as shard, count(*) as nodes, count(*) filter (where is_gold) as gold from n group by 1) select shard, count(*) as sentences, sum(nodes)::bigint as nodes, sum(gold)::bigint as gold, case when shard < 2 then 'first' else 'again' end as run from b group by shard",
    "v06_benchmark_tables": f"""with {_BENCH} select distinct run as section, 0 as line, '| k | paths | table_bytes | recall |' as text from bf union all select run, k, printf('| %d | %d | %d | %.6f |', k, paths, table_bytes, recall) from bf
union all select 'recall, K by run', k, '| ' || k || ' | ' || string_agg(printf('%.6f', recall), ' | ' order by run) || ' |' from bf group by k""",
    "v07_run_comparison": f"with {_BENCH} select a.k, round(b.paths / a.paths, 6) as paths_ratio, round(b.recall - a.recall, 6) as recall_gain, round(b.table_bytes / first_value(b.table_bytes) over (order by a.k), 6) as growth from bf a join bf b on a.k = b.k where a.run = 'length' and b.run = 'length and form'",
    "filter_p10_leakage_guard": "select 0::bigint as shared",
    "filter_p13_gold_choice": f"with {NODES}, g as (select sentence_id, string_agg(node_id::varchar, '-' order by topo_level, node_id) as p, count(distinct topo_level) = count(*) and max(topo_level) - min(topo_level) + 1 = count(*) as walk from n where is_gold group by 1) select sentence_id, case when sentence_id % 2 = 0 then 'explicit' when walk then 'legacy' else 'none' end as kind, case when sentence_id % 2 = 0 or walk then p else '' end as path from g",
    "f07_devanagari": f"""with m as (select {_map(translit.DEVANAGARI_CONSONANTS)} as c, {_map({k: v[0] for k, v in translit.DEVANAGARI_VOWELS.items()})} as v, {_map({k: v[1] for k, v in translit.DEVANAGARI_VOWELS.items()})} as a, {_map(translit.DEVANAGARI_SIGNS)} as s)
select lemma_id, array_to_string(list_transform(range(1, length(lemma) + 1), lambda i: case when c[lemma[i]] is not null then c[lemma[i]] || coalesce(a[lemma[i + 1]], '{translit.VIRAMA}') when v[lemma[i]] is not null then case when i > 1 and c[lemma[i - 1]] is not null then '' else v[lemma[i]] end else coalesce(s[lemma[i]], lemma[i]) end), '') as devanagari from lemma_list, m""",
}
