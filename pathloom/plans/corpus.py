"""Joins, sets, limits, statistics and serving queries over the tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import translit
from ..functions.features import global_rank, split_name
from ..operators import lattice as L
from ..operators import stats
from ..operators.sweep import level_sweep
from ..tables import table
from .features import _iast, texts
from .lattice import EDGES, NODES, base


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clean_nodes(table(spark, sf_dir, "nodes"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence once, as its latest delivery has it."""
    s = table(spark, sf_dir, "sentences").where("sentence_id is not null")
    return s.groupBy("sentence_id").agg(F.max("stem").alias("stem"), F.max("surface_text").alias("surface_text"), F.max("source").alias("source"), F.max("loaded_at").alias("loaded_at"))


def p04_safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(F.trim("expected_cng").try_cast("int"), F.lit(-1))
    return table(spark, sf_dir, "gold_diagnosis").select("diag_id", "expected_cng").distinct().select("diag_id", code.alias("code"))


def p03_node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _nodes(spark, sf_dir).select("sentence_id", F.concat(F.when(F.col("node_id") % 2 == 0, F.lit("n")).otherwise(F.lit("")), F.col("node_id").cast("string")).alias("name"))
    return named.select("sentence_id", "name", F.regexp_replace("name", "^n", "").cast("long").alias("node_id"))


def p05_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where(L.is_boundary()).select("sentence_id", "node_id")


def p06_trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _nodes(spark, sf_dir).where("is_gold").groupBy("sentence_id").agg(F.count("*").alias("gold_nodes"))
    return gold.where(split_name(F.col("sentence_id")) == "train")


def p09_wired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.endpoints(*base(spark, sf_dir)).where("is_wired").groupBy("sentence_id").agg(F.count("*").alias("wired"))


def p11_round_trip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that survive SLP1 to IAST and back unchanged."""
    back = translit.iast_to_slp1_column(translit.slp1_to_iast_column(F.col("surface_text")))
    return texts(spark, sf_dir).where("surface_text is not null").where(back == F.col("surface_text")).select("sentence_id")


def j01_left_join_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sentences(spark, sf_dir).select("sentence_id", "stem")
    d = table(spark, sf_dir, "gold_diagnosis").select("diag_id", F.col("sent_id").alias("stem")).distinct().groupBy("stem").agg(F.count("*").alias("diagnoses"))
    return s.join(d, "stem", "left").select("sentence_id", "stem", "diagnoses")


def j04_edges_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    u = nodes.select("sentence_id", F.col("node_id").alias("src"), F.col("form_id").alias("src_form"), F.col("length").alias("src_length"))
    v = nodes.select("sentence_id", F.col("node_id").alias("dst"), F.col("form_id").alias("dst_form"), F.col("length").alias("dst_length"))
    return edges.join(u, ["sentence_id", "src"]).join(v, ["sentence_id", "dst"]).groupBy("src_form", "dst_form").agg(F.count("*").alias("edges"), F.sum(F.col("src_length") + F.col("dst_length")).alias("letters"))


def j05_gold_pairs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scorers import gold_pairs

    nodes, edges = base(spark, sf_dir)
    linked = gold_pairs(nodes).join(edges.select("sentence_id", "src", "dst", "edge_id"), ["sentence_id", "src", "dst"], "left")
    return linked.groupBy("sentence_id").agg(F.count("*").alias("pairs"), F.count("edge_id").alias("edges"), F.bool_and(F.col("edge_id").isNotNull()).alias("whole"))


def j06_edge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of an edge id, by the range of ids that each node's out-edges have."""
    nodes, edges = base(spark, sf_dir)
    ranges = L.edge_offsets(nodes, edges).where("stop > start").select("sentence_id", F.col("node_id").alias("by_range"), F.explode(F.sequence("start", F.col("stop") - 1)).alias("edge_id"))
    return edges.join(ranges, ["sentence_id", "edge_id"]).select("sentence_id", "edge_id", "src", "by_range")


def j08_sentence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).groupBy("sentence_id").agg(F.min("node_id").alias("first"), F.max("node_id").alias("last"), F.count("*").alias("nodes"))


def j09_ids_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vocab")
    name = lambda kind: v.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("token").alias(kind))
    n = _nodes(spark, sf_dir)
    out = n.join(name("form"), "form_id", "left").join(name("lemma"), "lemma_id", "left").join(name("tag"), "tag_id", "left").join(name("preverb"), "preverb_id", "left")
    return out.groupBy("form", "lemma", "tag", "preverb").agg(F.count("*").alias("n"))


def j10_remap_through_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards' own vocabularies against their union: ids by token, first seen over both."""
    v = table(spark, sf_dir, "vocab").where("kind = 'form' and id > 0").select("id", "token")
    union = stats.first_seen_vocabulary(v, "token", ["id"]).withColumnRenamed("id", "union_id")
    placed = global_rank(v.withColumn("shard", F.col("id") % 2), [F.asc("shard"), F.asc("id")], "place")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard").join(union, "token").select("shard", (F.col("place") - F.col("first") + 1).alias("local_id"), "union_id")


def j11_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sentences").select("sentence_id").distinct()
    p = table(spark, sf_dir, "splits").select("sentence_id").distinct()
    return s.join(p, "sentence_id", "left_anti").select("sentence_id", F.lit("unsplit").alias("side")).unionByName(p.join(s, "sentence_id", "left_anti").select("sentence_id", F.lit("unknown").alias("side")))


def j13_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and lemmas of a sentence zipped by place; sentences of unequal length are left out."""
    s = table(spark, sf_dir, "sentences").where("node_form_id is not null and node_lemma_id is not null").dropDuplicates(["sentence_id"])
    zipped = s.where(F.size("node_form_id") == F.size("node_lemma_id")).select("sentence_id", F.posexplode(F.arrays_zip("node_form_id", "node_lemma_id")).alias("place", "z"))
    return zipped.select("sentence_id", "place", F.col("z.node_form_id").alias("form_id"), F.col("z.node_lemma_id").alias("lemma_id"))


def j18_runs_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' saturated path totals joined by K: over all nodes, and over gold nodes and boundaries only.

    Counts saturated at the greatest K give those of every smaller one. A node that the second run
    leaves out stands alone there, with one path.
    """
    ks, raw = (1, 4, 16), table(spark, sf_dir, "nodes")
    kept = raw.where("is_gold or chunk < 0")
    left_out = _nodes(spark, sf_dir).where("not (coalesce(is_gold, false) or coalesce(chunk < 0, false))").agg(F.count("*").alias("n"))

    def totals(nodes: DataFrame, name: str) -> DataFrame:
        sums = level_sweep(nodes, F.lit(0), "counts", max(ks)).agg(*[F.sum(F.least("paths", F.lit(k))).alias(f"k{k}") for k in ks])
        return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias(name)) for k in ks])).alias("x")).select("x.*")

    runs = totals(raw, "old").join(totals(kept, "new"), "k").select("k", "old", (F.col("new") + left_out.scalar()).alias("new"))
    return runs.withColumn("ratio", F.round(F.col("old") / F.col("new"), 6))


def j19_text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised sentence texts of even ids that are also texts of odd ids, and both differences."""
    t = texts(spark, sf_dir).select("sentence_id", F.trim(F.regexp_replace("surface_text", r"[ \t\r\n]+", " ")).alias("t")).where("t <> ''")
    a, b = t.where("sentence_id % 2 = 0").select("t"), t.where("sentence_id % 2 = 1").select("t")
    parts = [(a.intersect(b), "both"), (a.subtract(b), "even only"), (b.subtract(a), "odd only")]
    out = None
    for df, name in parts:
        row = df.agg(F.count("*").alias("texts")).select(F.lit(name).alias("side"), "texts")
        out = row if out is None else out.unionByName(row)
    return out


def u01_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "sentences").select(F.col("stem").alias("stem"))
    return a.intersect(table(spark, sf_dir, "gold_diagnosis").select(F.col("sent_id").alias("stem")))


def u03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sentences").select("stem").subtract(table(spark, sf_dir, "gold_diagnosis").select("sent_id"))


def u04_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards of the sentences by name, one with its columns in another order."""
    s = _sentences(spark, sf_dir)
    a = s.where("sentence_id % 2 = 0").select("sentence_id", "stem", "source")
    return a.unionByName(s.where("sentence_id % 2 = 1").select("source", "stem", "sentence_id"))


def u05_array_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sentences").dropDuplicates(["sentence_id"]).where("node_form_id is not null and node_lemma_id is not null")
    x = F.array_sort(F.array_union("node_form_id", "node_lemma_id"))
    return s.select("sentence_id", F.array_join(F.transform(x, lambda v: v.cast("string")), ",", "null").alias("ids"))


def u07_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sentences").dropDuplicates(["sentence_id"]).where("node_form_id is not null and node_lemma_id is not null")
    same = F.array_sort(F.array_distinct("node_form_id")) == F.array_sort(F.array_distinct("node_lemma_id"))
    return s.groupBy(same.alias("same")).agg(F.count("*").alias("sentences"))


def u08_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that were ever assigned to two splits, per pair of names; none where splits are disjoint."""
    name = F.lower(F.regexp_replace("splits", r"[\s\u00a0]+", ""))
    rows = table(spark, sf_dir, "splits").where("sentence_id is not null and splits is not null").groupBy("sentence_id").agg(F.array_sort(F.collect_set(name)).alias("names"))
    pairs = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return rows.where(F.size("names") > 1).select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("sentences"))


def t05_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the first 500 sentences of a golden output."""
    return _sentences(spark, sf_dir).select("sentence_id", "stem").orderBy("sentence_id").limit(500)


def t06_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 50 sentences by a hash of id and seed."""
    return stats.seeded_sample(_sentences(spark, sf_dir).select("sentence_id"), "sentence_id", 50, 7)


def t07_permutation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded permutation of the dev sentences; its first half moves to train."""
    dev = table(spark, sf_dir, "sentences").select("sentence_id").distinct().where(split_name(F.col("sentence_id")) == "dev")
    half = dev.select(F.floor(F.count("*") / 2)).scalar()
    placed = global_rank(dev.withColumn("h", F.md5(F.concat(F.lit("7-"), F.col("sentence_id").cast("string")))), [F.asc("h"), F.asc("sentence_id")], "place")
    return placed.select("sentence_id", F.when(F.col("place") < half, "train").otherwise("dev").alias("split"))


def a07_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    per = nodes.where("chunk >= 0").groupBy("sentence_id").agg(F.count("*").alias("n"))
    out = L.degrees(nodes, edges).where("out_degree > 0")
    gold = nodes.where("is_gold").groupBy("sentence_id").agg(F.count("*").alias("n"))
    return (
        stats.distribution(per, F.col("n"), "nodes per sentence")
        .unionByName(stats.distribution(out, F.col("out_degree"), "branching"))
        .unionByName(stats.distribution(gold, F.col("n"), "gold length"))
    )


def v08_statistics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus statistics as lines of a report."""
    cells = F.format_string("| %s | %d | %.6f | %.6f | %.6f | %.6f | %.0f |", "name", "n", "mean", "median", "p95", "p99", "most")
    return a07_corpus_statistics(spark, sf_dir).select(cells.alias("text"))


def a08_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _nodes(spark, sf_dir).groupBy("sentence_id").agg(F.count("*").alias("n"))
    return stats.histogram(per, F.least(F.col("n"), F.lit(299)), [0, 10, 20, 30, 40, 60, 100, 300])


def a24_first_seen_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = table(spark, sf_dir, "vocab").where("kind = 'form'").select(F.col("id").alias("form_id"), "token")
    seen = _nodes(spark, sf_dir).join(forms, "form_id")
    return stats.first_seen_vocabulary(seen, "token", ["sentence_id", "node_id"])


def a20_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the gold word against those of its competitors at the same place."""
    from ..functions.tokens import roles

    tags = table(spark, sf_dir, "vocab").where("kind = 'tag'").select(F.col("id").alias("tag_id"), roles(F.col("token"))["case_name"].alias("case"))
    n = _nodes(spark, sf_dir).where("chunk >= 0").join(tags, "tag_id")
    keys = ["sentence_id", "topo_level"]
    g = n.where("is_gold").select(*keys, F.col("case").alias("gold_case"))
    o = n.where("not is_gold").select(*keys, F.col("case").alias("other_case"))
    return g.join(o, keys).where("gold_case <> '' and other_case <> ''").groupBy("gold_case", "other_case").agg(F.count("*").alias("n"))


def v01_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = _nodes(spark, sf_dir).groupBy("sentence_id").agg(F.bool_or("is_gold").alias("has_gold"))
    return has.agg(F.count("*").alias("sentences"), F.min("sentence_id").alias("first"), F.max("sentence_id").alias("last"), F.count_if("has_gold").alias("with_gold"))


def v02_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup of one sentence; the filter reaches the scan."""
    return L.clean_nodes(table(spark, sf_dir, "nodes").where("sentence_id = 17")).select("node_id", "topo_level", "form_id", "is_gold")


def v03_stem_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sentences").where("stem = '1000033'").select("sentence_id", "stem").distinct()


def v04_graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sentence a nested document of its nodes and edges, as JSON."""
    nodes, edges = base(spark, sf_dir)
    n = nodes.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), F.col("topo_level").alias("level"), F.col("is_gold").alias("gold")))).alias("nodes"))
    e = edges.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("edges"))
    doc = F.to_json(F.struct("nodes", "edges"))
    return n.join(e, "sentence_id", "left").select("sentence_id", F.md5(F.encode(doc, "UTF-8")).alias("digest"), F.size("nodes").alias("n_nodes"), F.size(F.coalesce("edges", F.array())).alias("n_edges"))


def v05_gold_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scorers import gold_pairs

    nodes, edges = base(spark, sf_dir)
    pairs = gold_pairs(nodes).withColumn("gold", F.lit(True))
    return edges.join(pairs, ["sentence_id", "src", "dst"], "left").select("sentence_id", "edge_id", F.coalesce("gold", F.lit(False)).alias("gold"))


def v06_level_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per chunk and gold flag, as a table of columns: one per chunk there is, and one for boundaries."""
    chunks = table(spark, sf_dir, "nodes").where("sentence_id is not null and node_id is not null").select("chunk").distinct().collect()
    known = sorted({r.chunk for r in chunks if r.chunk is not None and r.chunk >= 0})
    names = ["boundary"] * any(r.chunk is not None and r.chunk < 0 for r in chunks) + [f"chunk_{i}" for i in known] + ["no_chunk"] * any(r.chunk is None for r in chunks)
    column = F.when(F.col("chunk").isNull(), "no_chunk").when(L.is_boundary(), "boundary").otherwise(F.concat(F.lit("chunk_"), F.col("chunk").cast("string")))
    n = _nodes(spark, sf_dir).select(F.when(F.col("is_gold"), "gold").otherwise("other").alias("side"), column.alias("column"))
    return n.groupBy("side").pivot("column", names).agg(F.count("side")).na.fill(0)


def v06_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per chunk and gold flag, all chunks and boundaries, in long form."""
    side = F.when(F.col("is_gold"), "gold").otherwise("other").alias("side")
    return _nodes(spark, sf_dir).groupBy(side, F.when(~L.is_boundary(), F.col("chunk")).alias("chunk")).agg(F.count("*").alias("n"))


def j07_node_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each node by its number in the whole corpus: a lookup in the ranges of the offsets.

    Numbers and ranges meet in cells of 256 numbers, so the range join is an equi-join.
    """
    placed = global_rank(_nodes(spark, sf_dir).select("sentence_id", "node_id"), [F.asc("sentence_id"), F.asc("node_id")], "number")
    ranges = placed.groupBy("sentence_id").agg(F.min("number").alias("start"), F.max("number").alias("stop"))
    cells = ranges.select(F.col("sentence_id").alias("found"), "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / 256), F.floor(F.col("stop") / 256))).alias("cell"))
    hit = placed.withColumn("cell", F.floor(F.col("number") / 256)).join(cells, "cell").where("number between start and stop")
    return hit.select("number", "sentence_id", "found")


QUERIES = {
    f.__name__: f
    for f in (
        j01_left_join_by_stem, j04_edges_with_ends, j05_gold_pairs_left, j06_edge_sources, j08_sentence_bounds, j09_ids_to_tokens, j10_remap_through_union,
        j11_semi_anti, j13_positional_zip, j18_runs_by_k, j19_text_overlap, u01_intersection, u03_difference, u04_concatenation, u05_array_union, u07_set_equality,
        u08_disjoint, t05_first_sentences, t06_seeded_sample, t07_permutation_prefix, a07_corpus_statistics, v08_statistics_report, a08_histogram, a20_confusion,
        a24_first_seen_vocabulary, v01_index, v02_sentence, v03_stem_lookup, v04_graph_documents, v05_gold_highlight, v06_chunk_counts, j07_node_sentences,
    )
}
# the predicates' names would read like those of the numbered problems
QUERIES |= {"filter_" + f.__name__: f for f in (p03_node_names, p04_safe_cast, p05_boundaries, p06_trainable, p09_wired, p11_round_trip_filter)}

_SENT = "s as (select sentence_id, max(stem) as stem, max(surface_text) as surface_text, max(source) as source, max(loaded_at) as loaded_at from sentences where sentence_id is not null group by sentence_id)"
_SPLIT = "case when ('0x' || substr(md5(sentence_id::varchar), 1, 8))::bigint % 100 < 5 then 'dev' when ('0x' || substr(md5(sentence_id::varchar), 1, 8))::bigint % 100 < 10 then 'test' else 'train' end"
_ONE = "o as (select sentence_id, any_value(node_form_id) as f, any_value(node_lemma_id) as l from sentences where node_form_id is not null and node_lemma_id is not null group by sentence_id)"
_PAIRS = "g as (select sentence_id, node_id as src, lead(node_id) over (partition by sentence_id order by topo_level, node_id) as dst from n where is_gold), gg as (select * from g where dst is not null)"
_TXT = "t as (select sentence_id, trim(regexp_replace(surface_text, '[ \\t\\r\\n]+', ' ', 'g')) as t from (select sentence_id, min(surface_text) as surface_text from sentences group by 1)), a as (select distinct t from t where t <> '' and sentence_id % 2 = 0), b as (select distinct t from t where t <> '' and sentence_id % 2 = 1)"


def _dist(sql: str, x: str, name: str) -> str:
    return f"select '{name}' as name, count(*) as n, round(avg({x}), 6) as mean, round(quantile_cont({x}, 0.5), 6)::double as median, round(quantile_cont({x}, 0.95), 6)::double as p95, round(quantile_cont({x}, 0.99), 6)::double as p99, max({x})::double as most from ({sql})"


def _back(x: str) -> str:
    """IAST to SLP1 by replacement, longest first: no sequence ends as another begins, so the order within a length is free."""
    table = {v: k for k, v in translit.SLP1_TO_IAST.items() if v != k} | translit.IAST_VARIANTS
    for a, b in sorted(table.items(), key=lambda t: -len(t[0])):
        x = f"replace({x}, '{a}', '{b}')"
    return x


SQL = {
    "filter_p03_node_names": f"with {NODES} select sentence_id, case when node_id % 2 = 0 then 'n' else '' end || node_id as name, node_id::bigint as node_id from n",
    "filter_p04_safe_cast": "select diag_id, coalesce(case when regexp_matches(trim(expected_cng), '^[+-]?[0-9]+$') then trim(expected_cng)::int end, -1) as code from (select distinct diag_id, expected_cng from gold_diagnosis)",
    "filter_p05_boundaries": f"with {NODES} select sentence_id, node_id from n where chunk < 0",
    "filter_p06_trainable": f"with {NODES} select sentence_id, count(*) as gold_nodes from n where is_gold and {_SPLIT} = 'train' group by 1",
    "filter_p11_round_trip_filter": f"select sentence_id from (select sentence_id, min(surface_text) as x from sentences group by 1) where x is not null and {_back(_iast('x'))} = x",
    "filter_p09_wired": f"with {EDGES} select sentence_id, count(*) as wired from (select sentence_id, src from e union select sentence_id, dst from e) group by 1",
    "j01_left_join_by_stem": f"with {_SENT}, d as (select stem, count(*) as diagnoses from (select distinct diag_id, sent_id as stem from gold_diagnosis) group by 1) select sentence_id, s.stem, diagnoses from s left join d using (stem)",
    "j04_edges_with_ends": f"with {EDGES} select u.form_id as src_form, v.form_id as dst_form, count(*) as edges, sum(u.length + v.length)::bigint as letters from e join n u on u.sentence_id = e.sentence_id and u.node_id = e.src join n v on v.sentence_id = e.sentence_id and v.node_id = e.dst group by 1, 2",
    "j05_gold_pairs_left": f"with {EDGES}, {_PAIRS} select gg.sentence_id, count(*) as pairs, count(e.edge_id) as edges, bool_and(e.edge_id is not null) as whole from gg left join e on e.sentence_id = gg.sentence_id and e.src = gg.src and e.dst = gg.dst group by 1",
    "j06_edge_sources": f"with {EDGES} select sentence_id, edge_id, src, src as by_range from e",
    "j08_sentence_bounds": f"with {NODES} select sentence_id, min(node_id) as first, max(node_id) as last, count(*) as nodes from n group by 1",
    "j09_ids_to_tokens": f"with {NODES} select f.token as form, l.token as lemma, t.token as tag, p.token as preverb, count(*) as n from n left join vocab f on f.kind = 'form' and f.id = n.form_id left join vocab l on l.kind = 'lemma' and l.id = n.lemma_id left join vocab t on t.kind = 'tag' and t.id = n.tag_id left join vocab p on p.kind = 'preverb' and p.id = n.preverb_id group by 1, 2, 3, 4",
    "j10_remap_through_union": """with v as (select id, token from vocab where kind = 'form' and id > 0 and token <> ''), u as (select token, row_number() over (order by id, token) as union_id from (select token, min(id) as id from v group by 1)),
w as (select id, token from vocab where kind = 'form' and id > 0) select w.shard, w.local_id, u.union_id from (select *, id % 2 as shard, row_number() over (partition by id % 2 order by id) as local_id from w) w join u using (token)""",
    "j11_semi_anti": "select distinct sentence_id, 'unsplit' as side from sentences where sentence_id not in (select sentence_id from splits where sentence_id is not null) union all select distinct sentence_id, 'unknown' from splits where sentence_id not in (select sentence_id from sentences where sentence_id is not null)",
    "j13_positional_zip": f"with {_ONE} select sentence_id, i - 1 as place, f[i] as form_id, l[i] as lemma_id from (select *, unnest(range(1, len(f) + 1)) as i from o where len(f) = len(l))",
    "j19_text_overlap": f"with {_TXT} select 'both' as side, count(*) as texts from (select t from a intersect select t from b) union all select 'even only', count(*) from (select t from a except select t from b) union all select 'odd only', count(*) from (select t from b except select t from a)",
    "u01_intersection": "select stem from sentences intersect select sent_id from gold_diagnosis",
    "u03_difference": "select stem from sentences except select sent_id from gold_diagnosis",
    "u04_concatenation": f"with {_SENT} select sentence_id, stem, source from s",
    "u05_array_union": f"with {_ONE} select sentence_id, array_to_string(list_transform(list_sort(list_distinct(list_filter(f || l, lambda x: x is not null)), 'ASC'), lambda x: x::varchar) || case when list_bool_or(list_transform(f || l, lambda x: x is null)) then ['null'] else []::varchar[] end, ',') as ids from o",
    "u07_set_equality": f"with {_ONE} select list_sort(list_distinct(list_filter(f, lambda x: x is not null))) = list_sort(list_distinct(list_filter(l, lambda x: x is not null))) and list_bool_or([false] || list_transform(f, lambda x: x is null)) = list_bool_or([false] || list_transform(l, lambda x: x is null)) as same, count(*) as sentences from o group by 1",
    "u08_disjoint": "with s as (select distinct sentence_id, lower(regexp_replace(splits, '[\\s\u00a0]+', '', 'g')) as s from splits where sentence_id is not null and splits is not null) select a.s as first, b.s as second, count(*) as sentences from s a join s b on a.sentence_id = b.sentence_id and a.s < b.s group by 1, 2",
    "t05_first_sentences": f"with {_SENT} select sentence_id, stem from s order by sentence_id limit 500",
    "t07_permutation_prefix": f"with d as (select distinct sentence_id from sentences where {_SPLIT} = 'dev') select sentence_id, case when row_number() over (order by md5('7-' || sentence_id), sentence_id) <= floor(count(*) over () / 2) then 'train' else 'dev' end as split from d",
    "a07_corpus_statistics": f"with {EDGES} " + _dist("select count(*) as x from n where chunk >= 0 group by sentence_id", "x", "nodes per sentence") + " union all " + _dist("select count(*) as x from e group by sentence_id, src", "x", "branching") + " union all " + _dist("select count(*) as x from n where is_gold group by sentence_id", "x", "gold length"),
    "a08_histogram": f"""with {NODES}, c as (select least(count(*), 299) as x from n group by sentence_id), b(low, high) as (values (0, 10), (10, 20), (20, 30), (30, 40), (40, 60), (60, 100), (100, 300))
select low, high, count(x) as n, round(count(x) / (high - low), 6) as density from b left join c on x >= low and x < high group by low, high""",
    "a24_first_seen_vocabulary": f"with {NODES}, s as (select v.token, min((n.sentence_id, n.node_id)) as seen from n join vocab v on v.kind = 'form' and v.id = n.form_id where v.token <> '' group by 1) select token, row_number() over (order by seen, token) as id from s",
    "v01_index": f"with {NODES} select count(distinct sentence_id) as sentences, min(sentence_id) as first, max(sentence_id) as last, count(distinct sentence_id) filter (where is_gold) as with_gold from n",
    "v02_sentence": f"with {NODES} select node_id, topo_level, form_id, is_gold from n where sentence_id = 17",
    "v03_stem_lookup": "select distinct sentence_id, stem from sentences where stem = '1000033'",
    "v05_gold_highlight": f"with {EDGES}, {_PAIRS} select e.sentence_id, e.edge_id, gg.src is not null as gold from e left join gg on gg.sentence_id = e.sentence_id and gg.src = e.src and gg.dst = e.dst",
    "v06_chunk_counts": f"with {NODES} select case when is_gold then 'gold' else 'other' end as side, case when chunk >= 0 then chunk end as chunk, count(*) as n from n group by 1, 2",
    "j07_node_sentences": f"with {NODES} select row_number() over (order by sentence_id, node_id) - 1 as number, sentence_id, sentence_id as found from n",
    "t06_seeded_sample": f"with {_SENT} select sentence_id from s order by md5('7-' || sentence_id), sentence_id limit 50",
    "v04_graph_documents": f"""with {EDGES}, x as (select sentence_id, '[' || string_agg('{{"id":' || node_id || ',"level":' || topo_level || ',"gold":' || is_gold || '}}', ',' order by node_id) || ']' as ns, count(*)::int as n_nodes from n group by 1),
y as (select sentence_id, '[' || string_agg('{{"source":' || src || ',"target":' || dst || '}}', ',' order by src, dst) || ']' as es, count(*)::int as n_edges from e group by 1)
select sentence_id, md5('{{"nodes":' || ns || case when es is not null then ',"edges":' || es else '' end || '}}') as digest, n_nodes, coalesce(n_edges, 0) as n_edges from x left join y using (sentence_id)""",
}
SQL["a20_confusion"] = f"""with {NODES}, q as (select id, coalesce(list_filter(['nom', 'acc', 'dat', 'abl', 'g', 'loc', 'voc', 'i'], lambda c: list_contains(string_split_regex(replace(token, '.', ' '), '\\s+'), c))[1], '') as c from vocab where kind = 'tag'),
m as (select n.*, q.c from n join q on q.id = n.tag_id where chunk >= 0) select a.c as gold_case, b.c as other_case, count(*) as n from m a join m b on a.sentence_id = b.sentence_id and a.topo_level = b.topo_level where a.is_gold and not b.is_gold and a.c <> '' and b.c <> '' group by 1, 2"""
SQL["v08_statistics_report"] = f"select printf('| %s | %d | %.6f | %.6f | %.6f | %.6f | %.0f |', name, n, mean, median, p95, p99, most) as text from ({SQL['a07_corpus_statistics']})"
