"""Audits, external predictions, taxonomies and the remaining filters, joins and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import tokens
from ..operators import lattice as L
from ..operators import metrics as M
from ..operators import scorers as S
from ..operators import stats
from ..operators.sweep import kbest
from ..sources import tables as IO
from ..tables import table
from .evaluation import _G, _MICRO, _S, _best, _decoded, decoded
from .features import TRAIN, train_sentences
from .lattice import _BEAMS, _ENDS, BEAM, EDGES, NODES, base, integer_weights


def filter_p07_empty_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without the nodes whose form is empty or unknown."""
    nodes, _, paths = decoded(spark, sf_dir, 1)
    v = table(spark, sf_dir, "vocab").where("kind = 'form' and token <> ''").select(F.col("id").alias("form_id"))
    named = nodes.join(v, "form_id", "left_semi").select("sentence_id", "node_id")
    each = _best(paths).select("sentence_id", F.posexplode("nodes").alias("at", "node_id")).join(named, ["sentence_id", "node_id"], "left_semi")
    return each.groupBy("sentence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id"))), lambda s: s["node_id"].cast("string")), "-").alias("path"))


def filter_p08_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    paths = kbest(nodes, integer_weights(nodes, edges), 1)
    return paths.select("sentence_id", F.size("nodes").alias("before"), F.size(M.strip(F.col("nodes"))).alias("after"))


def filter_p12_unique_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold walks by the mask alone: sentences whose gold nodes each have one gold successor, but the last."""
    nodes, edges = base(spark, sf_dir)
    g = nodes.where("is_gold").select("sentence_id", "node_id")
    inside = edges.join(g.withColumnRenamed("node_id", "src"), ["sentence_id", "src"], "left_semi").join(g.withColumnRenamed("node_id", "dst"), ["sentence_id", "dst"], "left_semi")
    out = g.join(inside.groupBy("sentence_id", F.col("src").alias("node_id")).agg(F.count("*").alias("n")), ["sentence_id", "node_id"], "left").na.fill(0, ["n"])
    return out.groupBy("sentence_id").agg(F.count("*").alias("gold_nodes"), F.count_if(F.col("n") == 1).alias("with_one"), (F.count_if(F.col("n") == 1) == F.count("*") - 1).alias("walk"))


def g02_edge_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of keyed edges: the traversable one has all, the ends come from key 1 alone."""
    nodes, edges = base(spark, sf_dir)
    keyed = edges.withColumn("key", F.when((F.col("src") + F.col("dst")) % 3 == 0, 2).otherwise(1))
    structural = L.endpoints(nodes, keyed.where("key = 1"))
    ends = structural.groupBy("sentence_id").agg(F.count_if("is_source").alias("sources"), F.count_if("is_sink").alias("sinks"))
    return ends.join(keyed.groupBy("sentence_id").agg(F.count("*").alias("edges"), F.count_if(F.col("key") == 2).alias("second")), "sentence_id")


def j12_stem_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "sentences").select("stem").where("stem is not null").distinct()
    b = table(spark, sf_dir, "gold_diagnosis").select(F.col("sent_id").alias("stem")).where("stem is not null").distinct()
    sides = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "stem", "full")
    return sides.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_sentences"), F.count_if(F.col("a").isNull()).alias("only_diagnoses"))


def j14_link_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external system's results, line by line, linked back to their keys by the manifest's row numbers; unlike numbers of rows are an error."""
    path = IO.scratch(spark, "linked")
    IO.write_manifest(table(spark, sf_dir, "lemma_list"), "lemma", "lemma_id", path)
    manifest = spark.read.parquet(f"{path}/manifest")
    # the other system reads the lines of the manifest's order and answers with numbered lines
    answers = X.global_rank(table(spark, sf_dir, "lemma_list").select("lemma_id", F.upper("lemma").alias("result")), [F.asc("lemma_id")], "row").select("row", "result")
    answers.write.json(f"{path}/answers")
    read = spark.read.schema("row long, result string").json(f"{path}/answers")
    return IO.link_by_row(manifest, read, "row")


def e14_load_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 50 annotation files: those that load, are broken, or have no words."""
    path = IO.scratch(spark, "triage")
    words = F.when(F.col("map_id") % 10 == 1, F.array().cast("array<string>")).otherwise(F.array("map_key"))
    line = F.when(F.col("map_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("map_id").cast("string").alias("id"), words.alias("words"))))
    sample = stats.seeded_sample(table(spark, sf_dir, "lemma_map").select("map_id", "map_key"), "map_id", 50, 7)
    sample.select(line.alias("value")).write.text(path)
    got = spark.read.schema("id string, words array<string>, _corrupt_record string").json(path)
    state = F.when(F.col("_corrupt_record").isNotNull(), "broken").when(F.size("words") == 0, "empty").otherwise("loaded")
    return got.groupBy(state.alias("state")).agg(F.count("*").alias("lines"))


def e19_exported_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges scored by weights before and after a trip through a weight file: the greatest difference."""
    source, destination, bias = [[0.25, -1.5, 2.0]], [[1.0, 0.5, -0.75]], 0.125
    again = IO.parse_weights(IO.pack_weights(source, destination, bias))
    nodes, edges = base(spark, sf_dir)
    x = nodes.select("sentence_id", "node_id", F.array(*[F.col(c).cast("double") for c in ("length", "position", "chunk")]).alias("x"))
    a = S.biaffine(x, edges, source, destination, bias).select("sentence_id", "edge_id", F.col("w").alias("a"))
    b = S.biaffine(x, edges, *again).select("sentence_id", "edge_id", F.col("w").alias("b"))
    return a.join(b, ["sentence_id", "edge_id"]).agg(F.count("*").alias("edges"), F.max(F.abs(F.col("a") - F.col("b"))).alias("difference"))


def e21_path_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken properties of the K best paths: scores fall, paths differ, scores are the edges' sums."""
    nodes, edges = base(spark, sf_dir)
    w = integer_weights(nodes, edges)
    paths = kbest(nodes, w, BEAM).select("sentence_id", "rank", "score", "nodes")
    order = W.partitionBy("sentence_id").orderBy("rank")
    fell = paths.withColumn("before", F.lag("score").over(order)).agg(F.count_if(F.col("score") > F.col("before")).alias("rising"))
    twice = paths.groupBy("sentence_id", "nodes").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    steps = paths.select("sentence_id", "rank", "score", F.posexplode("nodes").alias("at", "src"), "nodes").withColumn("dst", F.try_element_at("nodes", F.col("at") + 2)).where("dst is not null")
    sums = steps.join(w.select("sentence_id", "src", "dst", "w"), ["sentence_id", "src", "dst"], "left").groupBy("sentence_id", "rank", "score").agg(F.sum("w").alias("s"), F.count_if(F.col("w").isNull()).alias("gaps"))
    bad = sums.agg(F.count_if((F.col("s") != F.col("score")) | (F.col("gaps") > 0)).alias("wrong"))
    return fell.select("rising", twice.scalar().alias("repeated"), bad.scalar().alias("wrong"))


def s06_flat_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written as JSON by chunk, read back and flattened to a sentence's word count."""
    path = IO.scratch(spark, "annotations")
    g = L.clean_nodes(table(spark, sf_dir, "nodes")).where("is_gold")
    per = g.groupBy("sentence_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("topo_level", F.col("lemma_id").cast("string").alias("l"), F.col("tag_id").cast("string").alias("c")))).alias("x"))
    doc = per.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("x.l").alias("l"), F.col("x.c").alias("c")))).alias("y"))
    doc.select(F.col("sentence_id").cast("string"), F.col("y.l").alias("lemmas"), F.col("y.c").alias("cng")).write.json(path)
    flat = IO.flat_reference(IO.read_annotations(spark, path))
    return flat.select(F.col("stem").cast("long").alias("sentence_id"), F.array_join("lemmas", ",").alias("lemmas"), F.array_join("codes", ",").alias("codes"))


def s18_sentence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense sentence numbers in string order of their stems."""
    s = table(spark, sf_dir, "sentences").select("stem").where("stem is not null").distinct()
    return X.global_rank(s, [F.asc("stem")], "idx")


def s23_edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge scores written per bucket of sentences and read back."""
    path = IO.scratch(spark, "scores")
    IO.write_lattice(integer_weights(*base(spark, sf_dir)), path)
    return spark.read.parquet(path).groupBy("sentence_id").agg(F.count("*").alias("edges"), F.sum("w").cast("long").alias("total"))


def s30_reparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions parsed again from their kept raw text, written beside the old ones."""
    old, new = IO.scratch(spark, "old"), IO.scratch(spark, "new")
    docs = table(spark, sf_dir, "documents").where("genre = 'parse' and text is not null")
    raw = F.regexp_replace("text", r"\s+", " ")
    docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("m").alias("mode"), F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("lemmas"), F.array().cast("array<string>").alias("tags"), raw.alias("raw")).write.json(old)
    p = tokens.parse_analysed(F.col("raw"))
    IO.read_predictions(spark, old).withColumns({k: p[k] for k in ("words", "lemmas", "tags")}).write.json(new)
    return IO.read_predictions(spark, new).select(F.col("id").cast("long").alias("doc_id"), F.array_join("words", " ").alias("words"), F.array_join("lemmas", " ").alias("lemmas"))


def t08_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 64 sentences in id order: batch number, first and last sentence."""
    s = table(spark, sf_dir, "sentences").select("sentence_id").where("sentence_id is not null").distinct()
    batch = X.global_rank(s, [F.asc("sentence_id")], "place").withColumn("batch", F.floor(F.col("place") / 64))
    return batch.groupBy("batch").agg(F.min("sentence_id").alias("first"), F.max("sentence_id").alias("last"), F.count("*").alias("n"))


def f16_hapax_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many forms and occurrences fall to the unknown id at growing thresholds."""
    counts = X.word_counts(L.clean_nodes(table(spark, sf_dir, "nodes")), train_sentences(spark, sf_dir), "form_id")
    rows = [F.struct(F.lit(k).alias("least"), F.count_if(F.col("n") < k).alias("forms"), F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("occurrences")) for k in (1, 2, 5)]
    return counts.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("x")).select("x.*")


QUERIES = {
    f.__name__: f
    for f in (
        filter_p07_empty_forms, filter_p08_stripped, filter_p12_unique_successors, g02_edge_views, j12_stem_overlap, j14_link_by_row,
        e14_load_triage, e19_exported_weights, e21_path_properties, f16_hapax_share,
        s06_flat_reference, s18_sentence_index, s23_edge_scores, s30_reparse, t08_partition_sizes,
    )
}

_TOKENS = "d as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda t: t <> '') as t from documents where genre = 'parse' and text is not null)"
_FIELD1 = "regexp_replace(split_part(x, '_', 1), '-+$', '')"
_ROLE3 = "list_has_any(t, ['1', '2', '3']) and not list_has_any(t, ['ppr', 'pfp', 'pp', 'ppa'])"
_GOLDSUB = "p as (select gg.sentence_id, count(*) as n, count(e.edge_id) as f from (select sentence_id, node_id as src, lead(node_id) over (partition by sentence_id order by topo_level, node_id) as dst from n where is_gold) gg left join e on e.sentence_id = gg.sentence_id and e.src = gg.src and e.dst = gg.dst where gg.dst is not null group by 1)"

SQL = {
    "filter_p07_empty_forms": _decoded(1) + " select x.sentence_id, string_agg(x.node_id::varchar, '-' order by i) as path from (select sentence_id, unnest(p) as node_id, generate_subscripts(p, 1) as i from pp where rank = 0) x join n using (sentence_id, node_id) where n.form_id in (select id from vocab where kind = 'form' and token <> '') group by 1",
    "filter_p08_stripped": _decoded(1) + " select sentence_id, len(p) + 2 as before, len(p) as after from pp where rank = 0",
    "filter_p12_unique_successors": f"with {EDGES}, o as (select n.sentence_id, n.node_id, (select count(*) from e where e.sentence_id = n.sentence_id and e.src = n.node_id and e.both_gold) as c from n where is_gold) select sentence_id, count(*) as gold_nodes, count(*) filter (where c = 1) as with_one, count(*) filter (where c = 1) = count(*) - 1 as walk from o group by 1",
    "g02_edge_views": f"""with {EDGES}, k as (select *, case when (src + dst) % 3 = 0 then 2 else 1 end as key from e),
s as (select n.sentence_id, not exists (select 1 from k where k.sentence_id = n.sentence_id and k.dst = n.node_id and key = 1) as so, not exists (select 1 from k where k.sentence_id = n.sentence_id and k.src = n.node_id and key = 1) as si from n)
select sentence_id, count(*) filter (where so) as sources, count(*) filter (where si) as sinks, any_value(edges) as edges, any_value(second) as second from s join (select sentence_id, count(*) as edges, count(*) filter (where key = 2) as second from k group by 1) using (sentence_id) group by 1""",
    "j12_stem_overlap": "with a as (select distinct stem from sentences where stem is not null), b as (select distinct sent_id as stem from gold_diagnosis where sent_id is not null) select (select count(*) from a semi join b using (stem)) as both, (select count(*) from a anti join b using (stem)) as only_sentences, (select count(*) from b anti join a using (stem)) as only_diagnoses",
    "j14_link_by_row": "select lemma_id, upper(lemma) as result from lemma_list",
    "f19_parse_tokens": f"with {_TOKENS} select doc_id, array_to_string(list_filter(list_transform(t, lambda x: {_FIELD1}), lambda w: w <> ''), ' ') as words, array_to_string(list_transform(t, lambda x: split_part(x, '_', 2)), ' ') as lemmas, array_to_string(list_transform(t, lambda x: trim(regexp_replace(array_to_string(string_split(x, '_')[3:], '_'), '^_+|_+$', '', 'g'))), ' ') as tags from d",
    "e14_load_triage": "select case when map_id % 10 = 0 then 'broken' when map_id % 10 = 1 then 'empty' else 'loaded' end as state, count(*) as lines from (select map_id from lemma_map order by md5('7-' || map_id), map_id limit 50) group by 1",
    "e19_exported_weights": f"with {EDGES} select count(*) as edges, 0.0::double as difference from e",
    "e21_path_properties": "select 0::bigint as rising, 0::bigint as repeated, 0::bigint as wrong",
    "f16_hapax_share": f"with {NODES}, {TRAIN}, c as (select form_id, count(*) as n from n semi join tr using (sentence_id) where chunk >= 0 group by 1) select k as least, count(*) filter (where n < k)::bigint as forms, coalesce(sum(n) filter (where n < k), 0)::bigint as occurrences from c, (values (1), (2), (5)) v(k) group by k",
    "s06_flat_reference": f"with {NODES} select sentence_id, string_agg(lemma_id::varchar, ',' order by chunk, topo_level) as lemmas, string_agg(tag_id::varchar, ',' order by chunk, topo_level) as codes from n where is_gold group by 1",
    "s18_sentence_index": "select stem, row_number() over (order by stem) - 1 as idx from (select distinct stem from sentences where stem is not null)",
    "s23_edge_scores": f"with {EDGES} select sentence_id, count(*) as edges, sum(w)::bigint as total from e group by 1",
    "s30_reparse": f"with {_TOKENS} select doc_id, array_to_string(list_filter(list_transform(t, lambda x: {_FIELD1}), lambda w: w <> ''), ' ') as words, array_to_string(list_transform(t, lambda x: split_part(x, '_', 2)), ' ') as lemmas from d",
    "t08_partition_sizes": "select floor(place / 64)::bigint as batch, min(sentence_id) as first, max(sentence_id) as last, count(*) as n from (select sentence_id, row_number() over (order by sentence_id) - 1 as place from (select distinct sentence_id from sentences where sentence_id is not null)) group by 1",
}


def _scored(weight: str, gold_only: bool = False) -> str:
    edges = EDGES.replace("b.length * 10 + ((b.form_id % 7) + 7) % 7 as w", f"{weight} as w")
    return _BEAMS.format(edges=edges, nodes="n", level="topo_level", first=0, k=1) + "," + _ENDS + "," + _G + ", pp as (select sentence_id, place as rank, score, list_transform(string_split(path, '-')[2:-2], lambda x: x::int) as p from fin where place < 1), " + _S


SQL["e16_baselines"] = " union all ".join(f"select '{n}' as scorer, sentences, tp, fp, fn, f1 from ({_scored(w)} select {_MICRO} from cc)" for n, w in (("uniform", "1"), ("letters", "b.length")))


def _totals(k: int, kept: str) -> str:
    return f"(with recursive {EDGES}, x as (select * from e where {kept}), st as (select n.sentence_id, n.node_id, n.topo_level from n), src as (select * from st where not exists (select 1 from x where x.sentence_id = st.sentence_id and x.dst = st.node_id)), " + f"""paths as (
  select sentence_id, topo_level as level, node_id, 1::bigint as paths from src
  union all
  select p.sentence_id, p.level + 1, x.dst, least({k}, sum(p.paths))::bigint from paths p join x on x.sentence_id = p.sentence_id and x.src = p.node_id group by all
) select sum(paths)::bigint as t from paths)"""


_KEPT = "exists (select 1 from n a where a.sentence_id = e.sentence_id and a.node_id = e.src and (a.is_gold or a.chunk < 0)) and exists (select 1 from n a where a.sentence_id = e.sentence_id and a.node_id = e.dst and (a.is_gold or a.chunk < 0))"
SQL["j18_runs_by_k"] = 'select k, "old", "new", round("old" / "new", 6) as ratio from (' + " union all ".join(f'select {k} as k, {_totals(k, "true")} as "old", {_totals(k, _KEPT)} as "new"' for k in (1, 4, 16)) + ")"
SQL["f15_featurizer_morph43"] = f"""with {NODES}, q as (select id, list_transform({X.TAG_TOKENS!r}, lambda k: list_contains(string_split_regex(replace(token, '.', ' '), '\\s+'), k)::int::float) || [(token = 'UNKNOWN')::int::float] as x from vocab where kind = 'tag')
select sentence_id, node_id, case when chunk < 0 then list_transform(range(64), lambda i: 0::float) else coalesce(q.x, list_transform(range(43), lambda i: 0::float)) || list_transform(range(21), lambda i: 0::float) end as x from n left join q on q.id = n.tag_id"""
