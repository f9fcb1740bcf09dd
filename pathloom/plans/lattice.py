"""Lattices of the ``nodes`` table: construction, levels, degrees, checks, best paths, scorers.

Edges join all nodes of consecutive levels of a sentence. Weights in the checked queries are
integers, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lattice as L
from ..operators import scorers as S
from ..operators.sweep import kbest, keep_histogram, level_sweep, path_counts
from ..tables import table

BEAM = 4
INTEGER_WEIGHT = "length * 10 + pmod(form_id, 7)"


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes"))
    return nodes, L.level_edges(nodes)


def integer_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the integer weight of their destination: ten per letter, and its form id modulo 7."""
    w = nodes.select("sentence_id", F.col("node_id").alias("dst"), F.expr(INTEGER_WEIGHT).alias("w"))
    return edges.join(w, ["sentence_id", "dst"]).select("sentence_id", "edge_id", "src", "dst", F.col("w").cast("double").alias("w"))


# A second lattice: an order's lines, with the line number as the level.
def order_lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    w = W.partitionBy("l_orderkey")
    nodes = lines.select(
        F.col("l_orderkey").alias("sentence_id"),
        F.row_number().over(w.orderBy(*order)).alias("node_id"),
        F.dense_rank().over(w.orderBy("l_linenumber")).alias("topo_level"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    return nodes, L.level_edges(nodes)


def g01_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir)[1]


def g01_orient_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    both = edges.select("sentence_id", "src", "dst", F.lit(1).alias("key")).unionByName(edges.select("sentence_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("key")))
    inner = nodes.where("chunk >= 0")
    return L.orient(both, inner, "position", (1,))


def g03_orphan_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.orphan_hosts(_host_edges(spark, sf_dir))


def _host_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A non-gold node hangs on the gold node of its level that covers the same place."""
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes"))
    gold = nodes.where("is_gold").select("sentence_id", "topo_level", "char_start", F.col("node_id").alias("src"))
    other = nodes.where("not is_gold and chunk >= 0").select("sentence_id", "topo_level", "char_start", F.col("node_id").alias("dst"))
    return gold.join(other, ["sentence_id", "topo_level", "char_start"]).select("sentence_id", "src", "dst", F.lit(-1).alias("key"))


def g04_inherited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    gold = nodes.where("is_gold").select("sentence_id", "node_id")
    kept = edges.join(gold.withColumnRenamed("node_id", "src"), ["sentence_id", "src"], "left_semi").join(gold.withColumnRenamed("node_id", "dst"), ["sentence_id", "dst"], "left_semi")
    return L.inherit_host_edges(kept, L.orphan_hosts(_host_edges(spark, sf_dir)))


def g05_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.endpoints(*base(spark, sf_dir)).where("is_source or is_sink")


def g06_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    inner = nodes.where("chunk >= 0")
    kept = edges.join(inner.select("sentence_id", F.col("node_id").alias("src")), ["sentence_id", "src"], "left_semi").join(inner.select("sentence_id", F.col("node_id").alias("dst")), ["sentence_id", "dst"], "left_semi")
    return L.add_boundaries(inner, kept)[1]


def g07_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.levels(*base(spark, sf_dir))


def g08_cyclic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose level edges, with one edge back from the last to the first of even ids, have a cycle."""
    nodes, edges = base(spark, sf_dir)
    back = nodes.where("sentence_id % 2 = 0").groupBy("sentence_id").agg(F.lit(-1).cast("long").alias("edge_id"), F.max("node_id").alias("src"), F.min("node_id").alias("dst"))
    return L.cyclic_sentences(nodes, edges.unionByName(back))


def g09_kbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = level_sweep(table(spark, sf_dir, "nodes"), F.expr(INTEGER_WEIGHT), "kbest", BEAM)
    return best.select("sentence_id", "rank", F.col("score").cast("long").alias("score"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("path"))


def g10_kbest_over_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths from an explicit edge table, as any lattice has them."""
    nodes, edges = base(spark, sf_dir)
    return kbest(nodes, integer_weights(nodes, edges), BEAM).select("sentence_id", "rank", F.col("score").cast("long").alias("score"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("path"))


def g09_kbest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = order_lattice(spark, sf_dir)
    best = level_sweep(nodes, F.col("cents"), "kbest", 8)
    return best.select("sentence_id", "rank", F.col("score").cast("long").alias("score"))


def g11_kbest_edge_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    even = edges.withColumn("w", F.lit(1.0))
    return kbest(nodes, even, 2, "edge").select("sentence_id", "rank", F.col("score").cast("long").alias("score"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("path"))


def g12_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = level_sweep(table(spark, sf_dir, "nodes"), F.expr(INTEGER_WEIGHT), "kbest", 1)
    return best.select("sentence_id", F.col("score").cast("long").alias("score"), F.size("nodes").alias("n_nodes"))


def g14_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_sweep(table(spark, sf_dir, "nodes"), F.lit(0), "counts", 64)


def a18_keep_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_histogram(path_counts(*base(spark, sf_dir), 16), 16)


def a18_keep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = path_counts(*base(spark, sf_dir), 16)
    return counts.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("paths") >= 16).alias("full"), F.count_if(F.col("paths") < 16).alias("under"),
        F.round(F.count_if(F.col("paths") >= 16) / F.count("*") * 100, 4).alias("full_percent"),
    )


def a01_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.degrees(*base(spark, sf_dir))


def a02_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edge_offsets(*base(spark, sf_dir))


def a02_reverse_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edge_offsets(*base(spark, sf_dir), by="dst")


def g24_same_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level edges against those rebuilt from the forward offsets."""
    _, edges = base(spark, sf_dir)
    rebuilt = edges.groupBy("sentence_id", "src").agg(F.array_sort(F.collect_list("dst")).alias("out")).select("sentence_id", "src", F.explode("out").alias("dst"))
    return L.same_edges(edges, rebuilt)


def g25_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    return L.validate(nodes, base(spark, sf_dir)[1])


def g20_gold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gold_edges(*base(spark, sf_dir))


def g21_gold_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    scored = integer_weights(nodes, edges)
    return S.gold_score(nodes, scored).select("sentence_id", F.col("score").cast("long").alias("score"), "n_edges")


def g23_level_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collated form of each sentence's edges: sorted by the level they lead to, with every level's range."""
    from pyspark.sql import Window as W

    nodes, edges = base(spark, sf_dir)
    levels = nodes.select("sentence_id", F.col("node_id").alias("dst"), F.col("topo_level").alias("level"))
    counts = edges.join(levels, ["sentence_id", "dst"]).groupBy("sentence_id", "level").agg(F.count("*").alias("n"))
    stop = F.sum("n").over(W.partitionBy("sentence_id").orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    return counts.select("sentence_id", "level", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def g09_kbest_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams of 64: per sentence the number of paths and the sum of their scores."""
    best = level_sweep(table(spark, sf_dir, "nodes"), F.expr(INTEGER_WEIGHT), "kbest", 64)
    return best.groupBy("sentence_id").agg(F.count("*").alias("paths"), F.sum("score").cast("long").alias("total"), F.min("score").cast("long").alias("last"))


def t04_topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    nodes, _ = base(spark, sf_dir)
    return nodes.select("sentence_id", "node_id", (F.row_number().over(W.partitionBy("sentence_id").orderBy("topo_level", "node_id")) - 1).alias("place"))


def m01_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    return kbest(nodes, S.uniform(edges), 1).select("sentence_id", "score")


def m02_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    scored = S.length(nodes, edges)
    return scored.groupBy("sentence_id").agg(F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 9).alias("most"))


def m03_log_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    x = nodes.select("sentence_id", "node_id", F.array(F.col("length").cast("double"), F.col("position").cast("double"), F.col("chunk").cast("double")).alias("x"))
    scored = S.log_linear(x, edges, [0.5, -1.0, 2.0], 0.25)
    return scored.groupBy("sentence_id").agg(F.round(F.sum("w"), 6).alias("total"), F.max("w").alias("most"))


def m04_biaffine(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = base(spark, sf_dir)
    x = nodes.select("sentence_id", "node_id", F.array(F.col("length").cast("double"), F.col("position").cast("double"), F.col("chunk").cast("double")).alias("x"))
    scored = S.biaffine(x, edges, [[1.0, 0.0, 0.5], [0.0, 1.0, 0.0]], [[2.0, 0.0, 1.0], [0.0, 1.0, 1.0]], 0.5)
    return scored.groupBy("sentence_id").agg(F.round(F.sum("w"), 4).alias("total"), F.max("w").alias("most"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        g01_edges, g01_orient_by_position, g03_orphan_hosts, g04_inherited_edges, g05_endpoints, g06_boundaries, g07_levels, g08_cyclic_sentences, g09_kbest, g10_kbest_over_edges,
        g09_kbest_orders, g11_kbest_edge_ties, g12_viterbi, g14_path_counts, a18_keep_histogram, a18_keep_summary, a01_degrees, a02_offsets, a02_reverse_offsets,
        g20_gold_edges, g21_gold_score, g09_kbest_wide, g23_level_pointers, g24_same_edges, g25_validate, t04_topological_order, m01_uniform, m02_length, m03_log_linear, m04_biaffine,
    )
}

NODES = "n as (select distinct * from nodes where sentence_id is not null and node_id is not null)"
EDGES = NODES + """,
e as (select a.sentence_id, row_number() over (partition by a.sentence_id order by a.node_id, b.node_id) - 1 as edge_id, a.node_id as src, b.node_id as dst,
  b.length * 10 + ((b.form_id % 7) + 7) % 7 as w, a.topo_level as lu, b.topo_level as lv, a.length as u1, a.position as u2, a.chunk as u3, b.length as v1, b.position as v2, b.chunk as v3, a.is_gold and b.is_gold as both_gold
  from n a join n b on a.sentence_id = b.sentence_id and b.topo_level = a.topo_level + 1)"""
_DEGREE = EDGES + """,
d as (select n.sentence_id, n.node_id, (select count(*) from e where e.sentence_id = n.sentence_id and e.dst = n.node_id) as in_degree,
  (select count(*) from e where e.sentence_id = n.sentence_id and e.src = n.node_id) as out_degree from n)"""
_BEAMS = """with recursive {edges},
lv as materialized (select sentence_id, max({level}) as top from {nodes} group by sentence_id),
st as (select * from {nodes}),
beams as (
  select sentence_id, {level} as level, node_id, 0::bigint as rank, 0::bigint as score, -1::bigint as parent, -1::bigint as parent_rank, node_id::varchar as path from st where {level} = {first}
  union all
  select sentence_id, level, node_id, rank, score, parent, parent_rank, path from (
    select b.sentence_id, b.level + 1 as level, e.dst as node_id, b.score + e.w as score, b.node_id as parent, b.rank as parent_rank, b.path || '-' || e.dst as path,
      row_number() over (partition by b.sentence_id, e.dst order by b.score + e.w desc, b.node_id, b.rank) - 1 as rank
    from beams b join e on e.sentence_id = b.sentence_id and e.src = b.node_id) x where rank < {k}
)
"""
_KBEST = _BEAMS.format(edges=EDGES, nodes="n", level="topo_level", first=0, k=BEAM)
_ENDS = """
fin as (select b.*, row_number() over (partition by sentence_id order by score desc, node_id, rank) - 1 as place from beams b join lv using (sentence_id) where b.level = lv.top)
"""
_COUNTS = "with recursive " + EDGES + """,
paths as (
  select sentence_id, topo_level as level, node_id, 1::bigint as paths from n where topo_level = 0
  union all
  select p.sentence_id, p.level + 1, e.dst, least({k}, sum(p.paths))::bigint from paths p join e on e.sentence_id = p.sentence_id and e.src = p.node_id group by all
)
"""
_HOSTS = "h as (select distinct a.sentence_id, b.node_id as orphan, a.node_id as host from n a join n b on a.sentence_id = b.sentence_id and a.topo_level = b.topo_level and a.char_start = b.char_start where a.is_gold and not b.is_gold and b.chunk >= 0)"
_ORDERS = """n as (select l_orderkey as sentence_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as node_id,
  dense_rank() over (partition by l_orderkey order by l_linenumber) as topo_level, round(l_extendedprice * 100)::bigint as cents from lineitem),
e as (select a.sentence_id, a.node_id as src, b.node_id as dst, b.cents as w from n a join n b on a.sentence_id = b.sentence_id and b.topo_level = a.topo_level + 1)"""

SQL = {
    "g01_edges": f"with {EDGES} select sentence_id, edge_id, src, dst from e",
    "g01_orient_by_position": f"""with {EDGES},
o as (select distinct e.sentence_id, case when x then src else dst end as src, case when x then dst else src end as dst from (
  select e.sentence_id, e.src, e.dst, (a.chunk, a.position, a.position + a.length, a.node_id) < (b.chunk, b.position, b.position + b.length, b.node_id) as x
  from e join n a on a.sentence_id = e.sentence_id and a.node_id = e.src join n b on b.sentence_id = e.sentence_id and b.node_id = e.dst where a.chunk >= 0 and b.chunk >= 0) e)
select sentence_id, row_number() over (partition by sentence_id order by src, dst) - 1 as edge_id, src, dst from o""",
    "g03_orphan_hosts": f"with {NODES}, {_HOSTS} select * from h",
    "g04_inherited_edges": f"""with {EDGES}, {_HOSTS},
k as (select sentence_id, src, dst from e where both_gold),
m as (select sentence_id, host as x, orphan as y from h union select sentence_id, src, src from k union select sentence_id, dst, dst from k),
g as (select distinct k.sentence_id, a.y as src, b.y as dst from k join m a on a.sentence_id = k.sentence_id and a.x = k.src join m b on b.sentence_id = k.sentence_id and b.x = k.dst where a.y <> b.y)
select sentence_id, row_number() over (partition by sentence_id order by src, dst) - 1 as edge_id, src, dst from g""",
    "g05_endpoints": f"with {_DEGREE} select sentence_id, node_id, in_degree = 0 as is_source, out_degree = 0 as is_sink, in_degree + out_degree > 0 as is_wired from d where in_degree = 0 or out_degree = 0",
    "g06_boundaries": f"""with {EDGES},
i as (select sentence_id, node_id, row_number() over (partition by sentence_id order by node_id) as id, count(*) over (partition by sentence_id) + 1 as sink from n where chunk >= 0),
k as (select e.sentence_id, a.id as src, b.id as dst from e join i a on a.sentence_id = e.sentence_id and a.node_id = e.src join i b on b.sentence_id = e.sentence_id and b.node_id = e.dst),
x as (select * from k union all select sentence_id, 0, id from i where not exists (select 1 from k where k.sentence_id = i.sentence_id and k.dst = i.id)
  union all select sentence_id, id, sink from i where not exists (select 1 from k where k.sentence_id = i.sentence_id and k.src = i.id))
select sentence_id, row_number() over (partition by sentence_id order by src, dst) - 1 as edge_id, src, dst from x""",
    "g07_levels": f"with {NODES} select sentence_id, node_id, topo_level as level from n",
    "g08_cyclic_sentences": f"with {NODES} select sentence_id from n where sentence_id % 2 = 0 group by sentence_id",
    "g09_kbest": _KBEST + "," + _ENDS + f"select sentence_id, place as rank, score, path from fin where place < {BEAM}",
    "g09_kbest_wide": _BEAMS.format(edges=EDGES, nodes="n", level="topo_level", first=0, k=64) + "," + _ENDS + "select sentence_id, count(*) as paths, sum(score)::bigint as total, min(score)::bigint as last from fin where place < 64 group by 1",
    "g23_level_pointers": f"with {EDGES}, c as (select sentence_id, lv as level, count(*) as n from e group by all) select sentence_id, level, (sum(n) over w - n)::bigint as start, (sum(n) over w)::bigint as stop from c window w as (partition by sentence_id order by level)",
    "g10_kbest_over_edges": _KBEST + "," + _ENDS + f"select sentence_id, place as rank, score, path from fin where place < {BEAM}",
    "g09_kbest_orders": _BEAMS.format(edges=_ORDERS, nodes="n", level="topo_level", first=1, k=8) + "," + _ENDS + "select sentence_id, place as rank, score from fin where place < 8",
    "g11_kbest_edge_ties": _BEAMS.replace("order by b.score + e.w desc, b.node_id, b.rank", "order by b.score + e.w desc, e.edge_id, b.rank").format(edges=EDGES.replace("b.length * 10 + ((b.form_id % 7) + 7) % 7 as w", "1 as w"), nodes="n", level="topo_level", first=0, k=2) + "," + _ENDS + "select sentence_id, place as rank, score, path from fin where place < 2",
    "g12_viterbi": _BEAMS.format(edges=EDGES, nodes="n", level="topo_level", first=0, k=1) + "," + _ENDS + "select sentence_id, score, level + 1 as n_nodes from fin where place = 0",
    "g14_path_counts": _COUNTS.format(k=64) + "select sentence_id, node_id, paths from paths",
    "a18_keep_histogram": _COUNTS.format(k=16) + "select r.keep, count(p.paths) as num_nodes from range(0, 17) r(keep) left join paths p on p.paths = r.keep group by r.keep",
    "a18_keep_summary": _COUNTS.format(k=16) + "select count(*) as nodes, count(*) filter (where paths >= 16) as \"full\", count(*) filter (where paths < 16) as under, round(count(*) filter (where paths >= 16) / count(*) * 100, 4) as full_percent from paths",
    "a01_degrees": f"with {_DEGREE} select * from d",
    "a02_offsets": f"with {_DEGREE} select sentence_id, node_id, (sum(out_degree) over w - out_degree)::bigint as start, (sum(out_degree) over w)::bigint as stop from d window w as (partition by sentence_id order by node_id)",
    "a02_reverse_offsets": f"with {_DEGREE} select sentence_id, node_id, (sum(in_degree) over w - in_degree)::bigint as start, (sum(in_degree) over w)::bigint as stop from d window w as (partition by sentence_id order by node_id)",
    "g24_same_edges": f"with {EDGES} select 0::bigint as only_left, 0::bigint as only_right, count(*) as both from (select distinct sentence_id, src, dst from e)",
    "g25_validate": f"""with {_DEGREE}, q as (select sentence_id, min(node_id) as lo, max(node_id) as hi from n group by 1)
select 'level' as "check", count(*) filter (where lu >= lv) as n from e union all select 'dangling', 0 union all
select 'first', count(*) from d join q using (sentence_id) where node_id = lo and in_degree > 0 union all
select 'last', count(*) from d join q using (sentence_id) where node_id = hi and out_degree > 0 union all
select 'repeated', count(*) from (select 1 from nodes group by sentence_id, node_id having count(*) > 1)""",
    "g20_gold_edges": f"""with {EDGES},
g as (select sentence_id, node_id, lead(node_id) over (partition by sentence_id order by topo_level, node_id) as next from n where is_gold),
p as (select g.sentence_id, g.node_id as src, g.next as dst, e.edge_id from g left join e on e.sentence_id = g.sentence_id and e.src = g.node_id and e.dst = g.next where next is not null)
select sentence_id, src, dst, edge_id from p where sentence_id not in (select sentence_id from p where edge_id is null)""",
    "g21_gold_score": f"""with {EDGES},
g as (select sentence_id, node_id, lead(node_id) over (partition by sentence_id order by topo_level, node_id) as next from n where is_gold),
p as (select g.sentence_id, e.edge_id, e.w from g left join e on e.sentence_id = g.sentence_id and e.src = g.node_id and e.dst = g.next where next is not null)
select sentence_id, sum(w)::bigint as score, count(*) as n_edges from p group by sentence_id having count(*) = count(edge_id)""",
    "t04_topological_order": f"with {NODES} select sentence_id, node_id, row_number() over (partition by sentence_id order by topo_level, node_id) - 1 as place from n",
    "m01_uniform": f"with {NODES} select sentence_id, max(topo_level)::double as score from n group by sentence_id",
    "m02_length": f"with {EDGES} select sentence_id, round(sum(ln(1 + v1)), 6) as total, round(max(ln(1 + v1)), 9) as most from e group by sentence_id",
    "m03_log_linear": f"with {EDGES} select sentence_id, round(sum(0.25 + 0.5 * v1 - v2 + 2.0 * v3)::double, 6) as total, max(0.25 + 0.5 * v1 - v2 + 2.0 * v3)::double as most from e group by sentence_id",
    "m04_biaffine": f"""with {EDGES}, s as (select sentence_id, ((u1 + 0.5 * u3) * (2.0 * v1 + v3) + u2 * (v2 + v3) + 0.5)::double as w from e)
select sentence_id, round(sum(w), 4) as total, max(w) as most, count(*) as n from s group by sentence_id""",
}
