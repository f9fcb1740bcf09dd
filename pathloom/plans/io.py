"""Round trips through the sources and sinks: what is read back must be what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sweep import kbest, keep_histogram, path_counts
from ..sources import graphml
from ..sources import tables as S
from ..tables import table
from .features import train_sentences
from .lattice import _BEAMS, _COUNTS, _ENDS, EDGES, NODES, base, integer_weights


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "vocab")
    name = lambda kind, key: v.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("token").alias(key))
    nodes, edges = base(spark, sf_dir)
    rich = nodes.join(name("form", "word"), "form_id", "left").join(name("lemma", "lemma"), "lemma_id", "left").join(name("tag", "morph"), "tag_id", "left").join(name("preverb", "pre_verb"), "preverb_id", "left")
    rich = rich.select(F.col("sentence_id").cast("string").alias("stem"), "node_id", "word", "lemma", "morph", "pre_verb", F.col("tag_id").alias("cng"), F.col("chunk").alias("chunk_no"), "position", F.col("length").alias("length_word"))
    return rich, edges.select(F.col("sentence_id").cast("string").alias("stem"), "src", "dst", F.lit(1).alias("key"))


def s01_graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "graphml")
    graphml.write_graphml(*_graph(spark, sf_dir), path)
    n = graphml.parse_words(spark.read.text(path), graphml.NODE_FIELDS)
    return n.select("stem", "node_id", "word", "lemma", "morph", *[F.col(c).cast("int").alias(c) for c in ("cng", "chunk_no", "position", "length_word")])


def s01_graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "graphml")
    graphml.write_graphml(*_graph(spark, sf_dir), path)
    return graphml.graph_edges(graphml.parse_graphml(spark.read.text(path)))


def s03_single_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "graphml")
    graphml.write_graphml(*_graph(spark, sf_dir), path)
    n = graphml.parse_words(spark.read.text(path), ["cng"])
    return n.groupBy(F.col("cng").cast("int").alias("cng")).agg(F.count("*").alias("nodes"))


def s07_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "tsv")
    rows = table(spark, sf_dir, "lemma_list").select(F.col("lemma_id").cast("string"), "lemma", F.coalesce("word_class", F.lit("-")).alias("word_class"))
    # every file of the set has the header, with a byte order mark before its first name
    rows.toDF("\ufeffDCS-ID", "input", "output").write.csv(path, sep="\t", header=True, quote="", encoding="UTF-8")
    got = S.read_tsv(spark, path)
    return got.select(F.col("`DCS-ID`").cast("int").alias("lemma_id"), F.col("input").alias("lemma"), F.col("output").alias("word_class"))


def s08_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "jsonl")
    rows = table(spark, sf_dir, "lemma_map").select(F.col("map_id").cast("string").alias("id"), F.lit("m").alias("mode"), F.array("map_key").alias("words"), F.array("map_value").alias("lemmas"), F.array().cast("array<string>").alias("tags"), F.col("map_value").alias("raw"))
    rows.write.json(path)
    return S.read_predictions(spark, path).select("id", F.col("words")[0].alias("word"), F.col("lemmas")[0].alias("lemma"))


def s10_checked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("node_id", "topo_level", "length", "surface_id")])
    return S.require(table(spark, sf_dir, "nodes"), schema, {"surface_id": F.lit(-1)}).groupBy("surface_id").agg(F.count("*").alias("rows"), F.sum("length").alias("letters"))


def s12_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "vocab")
    S.write_vocabulary(table(spark, sf_dir, "vocab").where("kind = 'lemma'"), path)
    return S.read_vocabulary(spark, path, "lemma")


def s14_lattice_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "lattice")
    S.write_lattice(base(spark, sf_dir)[1], path)
    return spark.read.parquet(path).select("sentence_id", "edge_id", "src", "dst")


def s19_golden_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    return S.golden_json(kbest(nodes, integer_weights(nodes, edges), 4))


def s20_keep_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "keep")
    S.write_csv(keep_histogram(path_counts(*base(spark, sf_dir), 8), 8), path)
    return spark.read.option("header", True).schema("keep int, num_nodes long").csv(path)


def s22_candidates_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "candidates")
    nodes, edges = base(spark, sf_dir)
    w = integer_weights(nodes, edges)
    for k in (1, 4):
        S.write_candidates(kbest(nodes, w, k), k, path)
    return spark.read.parquet(path).groupBy("K").agg(F.count("*").alias("paths"), F.countDistinct("sentence_id").alias("sentences"))


def s26_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "swap")
    ids = train_sentences(spark, sf_dir)
    S.swap_in(spark, ids, path)
    S.swap_in(spark, spark.read.parquet(path).where("sentence_id % 2 = 0"), path)
    return spark.read.parquet(path).select("sentence_id", F.lit("new").alias("side")).unionByName(spark.read.parquet(path + ".bak").select("sentence_id", F.lit("old").alias("side")))


def s29_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "manifest")
    S.write_manifest(table(spark, sf_dir, "lemma_list"), "lemma", "lemma_id", path)
    return spark.read.parquet(f"{path}/manifest")


QUERIES = {
    f.__name__: f
    for f in (
        s01_graphml_nodes, s01_graphml_edges, s03_single_attribute, s07_tsv, s08_json_lines, s10_checked_scan, s12_vocabulary, s14_lattice_parquet, s19_golden_json,
        s20_keep_csv, s22_candidates_by_k, s26_swap, s29_manifest,
    )
}

_SPLIT = "('0x' || substr(md5(sentence_id::varchar), 1, 8))::bigint % 100 >= 10"
SQL = {
    "s01_graphml_nodes": f"with {NODES} select n.sentence_id::varchar as stem, n.node_id::bigint as node_id, nullif(f.token, '') as word, nullif(l.token, '') as lemma, t.token as morph, n.tag_id as cng, n.chunk as chunk_no, n.position, n.length as length_word from n left join vocab f on f.kind = 'form' and f.id = n.form_id left join vocab l on l.kind = 'lemma' and l.id = n.lemma_id left join vocab t on t.kind = 'tag' and t.id = n.tag_id",
    "s01_graphml_edges": f"with {EDGES} select sentence_id::varchar as stem, src::bigint as src, dst::bigint as dst, 1 as key from e",
    "s03_single_attribute": f"with {NODES} select tag_id as cng, count(*) as nodes from n group by 1",
    "s07_tsv": "select lemma_id, lemma, coalesce(word_class, '-') as word_class from lemma_list",
    "s08_json_lines": "select map_id::varchar as id, map_key as word, map_value as lemma from lemma_map",
    "s10_checked_scan": "select -1 as surface_id, count(*) as rows, sum(length)::bigint as letters from nodes",
    "s12_vocabulary": "select kind, id, token from vocab where kind = 'lemma'",
    "s14_lattice_parquet": f"with {EDGES} select sentence_id, edge_id, src, dst from e",
    "s19_golden_json": _BEAMS.format(edges=EDGES, nodes="n", level="topo_level", first=0, k=4) + "," + _ENDS + """select sentence_id, '{"sentence_id":' || sentence_id || ',"paths":[' || string_agg('{"score":' || printf('%.9g', score::double) || ',"nodes":[' || replace(path, '-', ',') || ']}', ',' order by place) || ']}' as value from fin where place < 4 group by sentence_id""",
    "s22_candidates_by_k": " union all ".join(f"""select * from ({_BEAMS.format(edges=EDGES, nodes="n", level="topo_level", first=0, k=k)}, {_ENDS} select {k} as "K", count(*) as paths, count(distinct sentence_id) as sentences from fin where place < {k})""" for k in (1, 4)),
    "s20_keep_csv": _COUNTS.format(k=8) + "select r.keep, count(p.paths) as num_nodes from range(0, 9) r(keep) left join paths p on p.paths = r.keep group by r.keep",
    "s26_swap": f"select distinct sentence_id, 'old' as side from sentences where {_SPLIT} union all select distinct sentence_id, 'new' from sentences where {_SPLIT} and sentence_id % 2 = 0",
    "s29_manifest": "select row_number() over (order by lemma_id) - 1 as row, lemma_id from lemma_list",
}
