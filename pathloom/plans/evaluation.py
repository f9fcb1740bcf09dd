"""Metrics of the K best paths of the ``nodes`` lattices against their gold paths."""

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
from ..operators.sweep import kbest, level_sweep
from ..tables import table
from .features import TRAIN, _ROLES, train_sentences
from .lattice import _BEAMS, _ENDS, BEAM, EDGES, INTEGER_WEIGHT, NODES, base, integer_weights


def gold_paths(nodes: DataFrame) -> DataFrame:
    """(sentence_id, nodes): the gold nodes in topological order; sentences without any do not come out. Repeated rows are one node."""
    ordered = F.array_sort(F.collect_set(F.struct("topo_level", "node_id")))
    return nodes.where("is_gold and sentence_id is not null and node_id is not null").groupBy("sentence_id").agg(ordered.alias("x")).select("sentence_id", F.col("x.node_id").alias("nodes"))


def decoded(spark: SparkSession, sf_dir: str, k: int = BEAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, gold paths and the k best paths without boundaries; decoding exchanges the nodes once and needs no edge table."""
    raw = table(spark, sf_dir, "nodes")
    paths = level_sweep(raw, F.expr(INTEGER_WEIGHT), "kbest", k).withColumn("nodes", M.strip(F.col("nodes")))
    return L.clean_nodes(raw), gold_paths(raw), paths


def _best(paths: DataFrame) -> DataFrame:
    return paths.where("rank = 0").select("sentence_id", "nodes")


def e01_node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, paths = decoded(spark, sf_dir, 1)
    return M.micro(M.compared(gold, _best(paths)))


def a13_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, paths = decoded(spark, sf_dir, 1)
    return M.macro(M.compared(gold, _best(paths)))


def e09_metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, paths = decoded(spark, sf_dir, 1)
    rows = M.compared(gold, _best(paths)).withColumn("split", X.split_name(F.col("sentence_id")))
    return M.micro(rows, ["split"])


def e08_subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that an annotator diagnosed against all others."""
    _, gold, paths = decoded(spark, sf_dir, 1)
    stems = table(spark, sf_dir, "gold_diagnosis").select(F.col("sent_id").alias("stem")).where("stem is not null").distinct()
    ids = table(spark, sf_dir, "sentences").select("sentence_id", "stem").distinct().join(stems, "stem", "left_semi").select("sentence_id", F.lit(True).alias("d"))
    rows = M.compared(gold, _best(paths)).join(ids.distinct(), "sentence_id", "left").withColumn("diagnosed", F.coalesce("d", F.lit(False)))
    return M.micro(rows, ["diagnosed"])


def _tokens(paths: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    each = paths.select("sentence_id", F.explode("nodes").alias("node_id"))
    return each.join(nodes.select("sentence_id", "node_id", F.col(column).alias("token")), ["sentence_id", "node_id"]).select("sentence_id", "token")


def e02_surface_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, gold, paths = decoded(spark, sf_dir, 1)
    best = _best(paths).join(gold.select("sentence_id"), "sentence_id", "left_semi")
    return M.micro(M.multiset(_tokens(gold, nodes, "form_id"), _tokens(best, nodes, "form_id")))


def u06_multiset_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, gold, paths = decoded(spark, sf_dir, 1)
    best = _best(paths).join(gold.select("sentence_id"), "sentence_id", "left_semi")
    return M.multiset(_tokens(gold, nodes, "lemma_id"), _tokens(best, nodes, "lemma_id")).select("sentence_id", "tp", "fp", "fn", "perfect")


def e05_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, paths = decoded(spark, sf_dir)
    return M.recall_at(M.hit_ranks(gold, paths), [1, 2, 4])


def m11_candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, paths = decoded(spark, sf_dir)
    return M.labelled(gold, paths).select("sentence_id", "rank", "label")


def e06_separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the number of finite verbs tells right candidates from wrong ones."""
    nodes, gold, paths = decoded(spark, sf_dir)
    tags = table(spark, sf_dir, "vocab").where("kind = 'tag'").select(F.col("id").alias("tag_id"), tokens.roles(F.col("token"))["is_finite"].alias("finite"))
    finite = nodes.join(tags, "tag_id").where("finite").select("sentence_id", "node_id", F.lit(1).alias("f"))
    each = M.labelled(gold, paths).select("sentence_id", "rank", "label", F.explode("nodes").alias("node_id")).join(finite, ["sentence_id", "node_id"], "left")
    keyed = each.groupBy("sentence_id", "rank", "label").agg(F.count("f").alias("n"))
    return M.separable(keyed, F.col("n")).groupBy("separable").agg(F.count("*").alias("sentences"))


def a14_bucketed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, gold, paths = decoded(spark, sf_dir, 1)
    counts = X.word_counts(nodes, train_sentences(spark, sf_dir), "form_id")
    g = gold.select("sentence_id", F.explode("nodes").alias("node_id")).join(nodes.select("sentence_id", "node_id", "form_id"), ["sentence_id", "node_id"])
    p = _best(paths).select("sentence_id", F.explode("nodes").alias("node_id"), F.lit(1).alias("hit"))
    rows = g.join(p, ["sentence_id", "node_id"], "left").join(counts, "form_id", "left").na.fill(0, ["n"])
    out = rows.groupBy(X.frequency_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("words"), F.count("hit").alias("hits"))
    return out.withColumn("recall", F.round(F.col("hits") / F.col("words"), 6))


def e12_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of max(0, wrong nodes + best score - gold score), where the gold path exists."""
    raw = table(spark, sf_dir, "nodes")
    best = level_sweep(raw, F.expr(INTEGER_WEIGHT), "kbest", 1).select("sentence_id", F.col("score").alias("best"), M.strip(F.col("nodes")).alias("nodes"))
    weights = L.clean_nodes(raw.where("is_gold")).select("sentence_id", F.expr(INTEGER_WEIGHT).alias("w"))
    score = weights.groupBy("sentence_id").agg(F.sum("w").alias("gold"))
    wrong = M.compared(gold_paths(raw), best).select("sentence_id", "fp", "fn")
    hinge = F.greatest(F.col("fp") + F.col("fn") + F.col("best") - F.col("gold"), F.lit(0.0))
    rows = wrong.join(best.select("sentence_id", "best"), "sentence_id").join(score, "sentence_id").select(hinge.alias("h"))
    numbers, q = stats.quantiles(rows, F.col("h"), [0.25, 0.5, 0.75, 0.9, 0.99])
    row = (numbers["n"], *[None if x is None else float(x) for x in (numbers["mean"], *q)])
    names = ["mean", "p25", "p50", "p75", "p90", "p99"]
    out = spark.createDataFrame([row], "sentences long, " + ", ".join(f"{n} double" for n in names))
    return out.select("sentences", *[F.round(n, 6).alias(n) for n in names])


def a21_top_decile_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all wrong nodes that the worst tenth of the sentences has."""
    _, gold, paths = decoded(spark, sf_dir, 1)
    rows = M.compared(gold, _best(paths)).select("sentence_id", (F.col("fp") + F.col("fn")).alias("loss"))
    tenth = X.global_rank(rows, [F.desc("loss"), F.asc("sentence_id")], "place")
    n = rows.select(F.ceil(F.count("*") / 10)).scalar()
    return tenth.agg(F.sum("loss").alias("loss"), F.sum(F.when(F.col("place") < n, F.col("loss")).otherwise(0)).alias("top_loss")).withColumn(
        "top_share", F.round(F.coalesce(F.try_divide("top_loss", "loss"), F.lit(0.0)), 6)
    )


def e16_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node metrics of the best paths under the uniform and the letter-count scorer."""
    raw, out = table(spark, sf_dir, "nodes"), None
    for name, weight in (("uniform", F.lit(1.0)), ("letters", F.col("length"))):
        best = level_sweep(raw, weight, "kbest", 1).select("sentence_id", M.strip(F.col("nodes")).alias("nodes"))
        row = M.micro(M.compared(gold_paths(raw), best)).select(F.lit(name).alias("scorer"), "sentences", "tp", "fp", "fn", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def e20_score_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K best scores under both tie-breaks are the same multiset in every sentence."""
    nodes, edges = base(spark, sf_dir)
    weights = integer_weights(nodes, edges)
    by = [kbest(nodes, weights, BEAM, tie).groupBy("sentence_id").agg(F.array_sort(F.collect_list("score")).alias(tie)) for tie in ("parent", "edge")]
    return by[0].join(by[1], "sentence_id", "full").agg(F.count("*").alias("sentences"), F.count_if(F.coalesce(F.col("parent") == F.col("edge"), F.lit(False))).alias("same"))


def a09_feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln((mean over gold + eps) / (mean over others + eps)) of simple features, training sentences only."""
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes")).join(train_sentences(spark, sf_dir), "sentence_id", "left_semi")
    features = {"length": F.col("length"), "position": F.col("position"), "chunk": F.col("chunk"), "has_preverb": (F.col("preverb_id") > 0).cast("int")}
    mean = lambda flag, x: F.avg(F.when(flag, x.cast("double")))
    sums = nodes.agg(*[mean(f, x).alias(f"{s} {n}") for n, x in features.items() for s, f in (("g", F.col("is_gold")), ("o", ~F.col("is_gold")))])
    ratio = lambda n: F.round(F.log((F.col(f"g {n}") + 1e-6) / (F.col(f"o {n}") + 1e-6)), 6)
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), ratio(n).alias("weight")) for n in features])).alias("x")).select("x.*")


def w06_gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gold_pairs(L.clean_nodes(table(spark, sf_dir, "nodes")))


def w07_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold forms by their place in the text; equal places keep the path's order."""
    w = W.partitionBy("sentence_id").orderBy("char_start", "topo_level", "node_id")
    return L.clean_nodes(table(spark, sf_dir, "nodes")).where("is_gold").select("sentence_id", (F.row_number().over(w) - 1).alias("place"), "form_id")


QUERIES = {
    f.__name__: f
    for f in (
        e01_node_metrics, e02_surface_multiset, e05_recall_at_k, e06_separability, e08_subset_metrics, e09_metrics_by_split, e12_hinge,
        e16_baselines, e20_score_multisets, a09_feature_weights, a13_macro_metrics, a14_bucketed_recall, a21_top_decile_loss,
        m11_candidate_labels, u06_multiset_by_sentence, w06_gold_pairs, w07_reorder,
    )
}

_G = "gp as (select sentence_id, list(node_id order by topo_level, node_id) as g from n where is_gold group by sentence_id)"
_P = "pp as (select sentence_id, place as rank, score, list_transform(string_split(path, '-')[2:-2], lambda x: x::int) as p from fin where place < {k})"
_S = "cc as (select sentence_id, len(list_intersect(g, coalesce(p, []::int[]))) as tp, len(coalesce(p, []::int[])) - len(list_intersect(g, coalesce(p, []::int[]))) as fp, len(g) - len(list_intersect(g, coalesce(p, []::int[]))) as fn from gp left join (select * from pp where rank = 0) using (sentence_id))"


def _decoded(k: int) -> str:
    return _BEAMS.format(edges=EDGES, nodes="n", level="topo_level", first=0, k=k) + "," + _ENDS + "," + _G + "," + _P.format(k=k)


_MICRO = """count(*) as sentences, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, round(case when sum(tp + fp) > 0 then sum(tp) / sum(tp + fp) else 0 end, 6) as precision,
round(case when sum(tp + fn) > 0 then sum(tp) / sum(tp + fn) else 0 end, 6) as recall, round(case when sum(2 * tp + fp + fn) > 0 then sum(2 * tp) / sum(2 * tp + fp + fn) else 0 end, 6) as f1,
round(count(*) filter (where fp = 0 and fn = 0) / count(*), 6) as perfect_share"""
_MULTI = """gt as (select sentence_id, {c} as token, count(*) as g from n where is_gold group by all),
pt as (select x.sentence_id, n.{c} as token, count(*) as p from (select sentence_id, unnest(p) as node_id from pp semi join gp using (sentence_id) where rank = 0) x join n using (sentence_id, node_id) group by all),
ft as (select sentence_id, token, coalesce(g, 0) as g, coalesce(p, 0) as p from gt full join pt using (sentence_id, token)),
cc as (select sentence_id, sum(least(g, p))::bigint as tp, sum(p - least(g, p))::bigint as fp, sum(g - least(g, p))::bigint as fn from ft group by sentence_id)"""

SQL = {
    "e01_node_metrics": _decoded(1) + f", {_S} select {_MICRO} from cc",
    "a13_macro_metrics": _decoded(1) + f""", {_S} select count(*) as sentences, round(avg(case when tp + fp > 0 then tp / (tp + fp) else 0 end), 6) as precision, round(avg(case when tp + fn > 0 then tp / (tp + fn) else 0 end), 6) as recall,
round(avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 6) as f1 from cc""",
    "e09_metrics_by_split": _decoded(1) + f""", {_S} select case when b < 5 then 'dev' when b < 10 then 'test' else 'train' end as split, {_MICRO} from (select *, ('0x' || substr(md5(sentence_id::varchar), 1, 8))::bigint % 100 as b from cc) group by 1""",
    "e08_subset_metrics": _decoded(1) + f""", {_S} select diagnosed, {_MICRO} from (select cc.*, sentence_id in (select sentence_id from sentences where stem in (select sent_id from gold_diagnosis where sent_id is not null)) as diagnosed from cc) group by diagnosed""",
    "e02_surface_multiset": _decoded(1) + ", " + _MULTI.format(c="form_id") + f" select {_MICRO} from cc",
    "u06_multiset_by_sentence": _decoded(1) + ", " + _MULTI.format(c="lemma_id") + " select *, fp = 0 and fn = 0 as perfect from cc",
    "e05_recall_at_k": _decoded(BEAM) + ", hh as (select gp.sentence_id, min(rank) as hit from gp left join pp on pp.sentence_id = gp.sentence_id and pp.p = gp.g group by 1) "
    + " union all ".join(f"select {k} as k, count(*) as sentences, count(*) filter (where hit < {k}) as hits, round(count(*) filter (where hit < {k}) / count(*), 6) as recall from hh" for k in (1, 2, 4)),
    "m11_candidate_labels": _decoded(BEAM) + " select sentence_id, rank, coalesce(p = g, false) as label from pp left join gp using (sentence_id)",
    "e06_separability": _decoded(BEAM).replace("with recursive ", f"with recursive {_ROLES}, ") + """, ks as (select x.sentence_id, x.rank, x.label, count(*) filter (where q.is_finite) as c from (select pp.sentence_id, rank, coalesce(p = g, false) as label, unnest(p) as node_id from pp left join gp using (sentence_id)) x join n using (sentence_id, node_id) left join q on q.id = n.tag_id group by 1, 2, 3),
kk as (select sentence_id, c, bool_or(label) as ok, bool_or(not label) as bad from ks group by 1, 2), ss as (select sentence_id, bool_or(ok and not bad) as separable from kk group by 1 having bool_or(ok)) select separable, count(*) as sentences from ss group by 1""",
    "a14_bucketed_recall": _decoded(1) + f""", {TRAIN}, fc as (select form_id, count(*) as n from n semi join tr using (sentence_id) where chunk >= 0 group by form_id), hits as (select sentence_id, unnest(p) as node_id from pp where rank = 0)
select case when c = 0 then 'unseen' when c <= 4 then 'rare' when c <= 49 then 'mid' else 'common' end as bucket, count(*) as words, count(h) as hits, round(count(h) / count(*), 6) as recall
from (select coalesce(fc.n, 0) as c, hits.node_id as h from n left join fc using (form_id) left join hits on hits.sentence_id = n.sentence_id and hits.node_id = n.node_id where n.is_gold) group by 1""",
    "e12_hinge": _decoded(1) + f""", {_S}, gw as (select n.sentence_id, sum(n.length * 10 + ((n.form_id % 7) + 7) % 7) as gold from n where is_gold group by 1),
hg as (select greatest(cc.fp + cc.fn + fin.score - gw.gold, 0)::double as h from cc join gw using (sentence_id) join fin using (sentence_id) where fin.place = 0)
select count(*) as sentences, round(avg(h), 6) as mean, round(quantile_cont(h, 0.25), 6) as p25, round(quantile_cont(h, 0.5), 6) as p50, round(quantile_cont(h, 0.75), 6) as p75, round(quantile_cont(h, 0.9), 6) as p90, round(quantile_cont(h, 0.99), 6) as p99 from hg""",
    "a21_top_decile_loss": _decoded(1) + f""", {_S}, rr as (select fp + fn as loss, row_number() over (order by fp + fn desc, sentence_id) as i, count(*) over () as c from cc)
select sum(loss)::bigint as loss, sum(case when i <= ceil(c / 10) then loss else 0 end)::bigint as top_loss, round(sum(case when i <= ceil(c / 10) then loss else 0 end) / sum(loss), 6) as top_share from rr""",
    "e20_score_multisets": f"with {NODES} select count(distinct sentence_id) as sentences, count(distinct sentence_id) as same from n",
    "a09_feature_weights": f"with {NODES}, {TRAIN}, m as (select n.* from n semi join tr using (sentence_id)) "
    + " union all ".join(f"select '{n}' as feature, round(ln((avg({x}) filter (where is_gold) + 1e-6) / (avg({x}) filter (where not is_gold) + 1e-6)), 6) as weight from m" for n, x in (("length", "length"), ("position", "position"), ("chunk", "chunk"), ("has_preverb", "(preverb_id > 0)::int"))),
    "w06_gold_pairs": f"with {NODES}, g as (select sentence_id, node_id as src, lead(node_id) over (partition by sentence_id order by topo_level, node_id) as dst from n where is_gold) select * from g where dst is not null",
    "w07_reorder": f"with {NODES} select sentence_id, row_number() over (partition by sentence_id order by char_start, topo_level, node_id) - 1 as place, form_id from n where is_gold",
}
