"""Lattices: cleaning, orientation, levels, wiring, degrees and checks.

A lattice table has one row per node or edge and carries ``sentence_id`` in every row. Sentences
are small (hundreds of nodes) and many, so the plan is one exchange on the sentence and local work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sweep import sweep


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Each (sentence_id, node_id) once; rows without either are no nodes. Repeated rows are equal."""
    return nodes.where("sentence_id is not null and node_id is not null").repartition("sentence_id").dropDuplicates(["sentence_id", "node_id"])


def is_boundary(chunk: Column | str = "chunk") -> Column:
    """Whether a node is the super-source or super-sink; a null chunk is none."""
    return F.coalesce((F.col(chunk) if isinstance(chunk, str) else chunk) < 0, F.lit(False))


def level_edges(nodes: DataFrame) -> DataFrame:
    """Edges (sentence_id, edge_id, src, dst) between all nodes of consecutive topological levels.

    Edge ids count from 0 in the order (src, dst) of the sentence. Nodes with a null level have
    no edges; a level that no node has separates the lattice.
    """
    n = nodes.select("sentence_id", "node_id", "topo_level")
    a = n.select("sentence_id", F.col("node_id").alias("src"), (F.col("topo_level") + 1).alias("level"))
    b = n.select("sentence_id", F.col("node_id").alias("dst"), F.col("topo_level").alias("level"))
    return with_edge_ids(a.join(b, ["sentence_id", "level"]).drop("level"))


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Number the edges of each sentence from 0 in the order (src, dst)."""
    number = F.row_number().over(W.partitionBy("sentence_id").orderBy("src", "dst")) - 1
    return edges.select("sentence_id", number.cast("long").alias("edge_id"), "src", "dst")


def orientation_key(order: str = "id") -> list[str]:
    """The columns of the strict order along which edges point: by id, or by position."""
    if order == "id":
        return ["node_id"]
    if order == "position":
        return ["chunk", "position", "reach", "node_id"]
    raise ValueError(f"unknown edge order {order!r}; known: id, position")


def orient(adjacency: DataFrame, nodes: DataFrame, order: str = "id", keys: tuple[int, ...] = (1,)) -> DataFrame:
    """Keep the direction of a symmetric relation that goes up the order, for the kept edge keys.

    ``adjacency`` has (sentence_id, src, dst, key), ``nodes`` (sentence_id, node_id, chunk,
    position, length). Edges to unknown nodes and loops fall away; both directions of a pair, or
    a repeated pair, leave one edge. Null order columns sort first.
    """
    names = orientation_key(order)
    place = nodes.withColumn("reach", F.col("position") + F.col("length")).select("sentence_id", "node_id", F.struct(*[F.col(c) for c in names]).alias("at"))
    left = place.select("sentence_id", F.col("node_id").alias("src"), F.col("at").alias("src_at"))
    right = place.select("sentence_id", F.col("node_id").alias("dst"), F.col("at").alias("dst_at"))
    kept = adjacency.where(F.col("key").isin(*keys)).select("sentence_id", "src", "dst")
    up = kept.join(left, ["sentence_id", "src"]).join(right, ["sentence_id", "dst"]).where("src_at < dst_at")
    return with_edge_ids(up.select("sentence_id", "src", "dst").distinct())


def orphan_hosts(adjacency: DataFrame) -> DataFrame:
    """(sentence_id, orphan, host) from the directed edges with key -1, host to orphan."""
    return adjacency.where("key = -1").select("sentence_id", F.col("dst").alias("orphan"), F.col("src").alias("host")).distinct()


def inherit_host_edges(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """Add, for every edge, the edges between its ends' orphans and the ends or their orphans.

    Inheritance is over the given edges only, so it does not chain. Loops fall away.
    """
    ends = edges.select("sentence_id", "src", "dst")
    names = hosts.select("sentence_id", F.col("host").alias("end"), F.col("orphan").alias("name"))
    own = ends.select("sentence_id", F.explode(F.array("src", "dst")).alias("end")).distinct().withColumn("name", F.col("end"))
    names = names.unionByName(own)
    left = names.select("sentence_id", F.col("end").alias("src"), F.col("name").alias("u"))
    right = names.select("sentence_id", F.col("end").alias("dst"), F.col("name").alias("v"))
    grown = ends.join(left, ["sentence_id", "src"]).join(right, ["sentence_id", "dst"]).where("u <> v")
    return with_edge_ids(grown.select("sentence_id", F.col("u").alias("src"), F.col("v").alias("dst")).distinct())


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sentence_id, node_id, is_source, is_sink, is_wired) of every node."""
    degree = degrees(nodes, edges)
    return degree.select(
        "sentence_id", "node_id", (F.col("in_degree") == 0).alias("is_source"), (F.col("out_degree") == 0).alias("is_sink"),
        (F.col("in_degree") + F.col("out_degree") > 0).alias("is_wired"),
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sentence_id, node_id, in_degree, out_degree): one exchange for both, zero where none."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    counted = edges.select("sentence_id", ends.alias("x")).select("sentence_id", "x.node_id", "x.i", "x.o")
    spine = nodes.select("sentence_id", "node_id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return counted.unionByName(spine).repartition("sentence_id").groupBy("sentence_id", "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def edge_offsets(nodes: DataFrame, edges: DataFrame, by: str = "src") -> DataFrame:
    """Offsets of a node's edges in the sentence's list sorted by ``src`` (or ``dst``: reverse)."""
    count = "out_degree" if by == "src" else "in_degree"
    w = W.partitionBy("sentence_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    d = degrees(nodes, edges)
    total = F.sum(count).over(w)
    return d.select("sentence_id", "node_id", (total - F.col(count)).alias("start"), total.alias("stop"))


def add_boundaries(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local ids 1..n in node order, a super-source 0 and a super-sink n + 1, wired to all ends.

    Returns nodes (sentence_id, node_id, local_id) and edges on local ids. The sources and sinks
    are those of the given edges; a lone node is both.
    """
    w = W.partitionBy("sentence_id").orderBy("node_id")
    ends = endpoints(nodes, edges).withColumn("local_id", F.row_number().over(w))
    size = ends.groupBy("sentence_id").agg((F.max("local_id") + 1).alias("sink"))
    names = ends.select("sentence_id", "node_id", "local_id")
    inner = (
        edges.join(names.withColumnsRenamed({"node_id": "src", "local_id": "s"}), ["sentence_id", "src"])
        .join(names.withColumnsRenamed({"node_id": "dst", "local_id": "d"}), ["sentence_id", "dst"])
        .select("sentence_id", F.col("s").alias("src"), F.col("d").alias("dst"))
    )
    first = ends.where("is_source").select("sentence_id", F.lit(0).alias("src"), F.col("local_id").alias("dst"))
    last = ends.where("is_sink").join(size, "sentence_id").select("sentence_id", F.col("local_id").alias("src"), F.col("sink").alias("dst"))
    outer = size.select("sentence_id", F.explode(F.array(F.lit(0), F.col("sink"))).alias("local_id"), F.lit(None).cast("int").alias("node_id"))
    return names.unionByName(outer), with_edge_ids(inner.unionByName(first).unionByName(last))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sentence_id, node_id, level): the longest path from a source; null for a sentence with a cycle."""
    return sweep(nodes, edges.withColumn("w", F.lit(0.0)), "levels")


def cyclic_sentences(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The sentences whose edges have a cycle; they have no levels."""
    return levels(nodes, edges).where("level is null").select("sentence_id").distinct()


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per check the number of rows that break it (zero rows of a broken table break nothing).

    level: an edge does not go up. dangling: an end of it is no node. first, last: the first node
    has an in-edge, the last an out-edge. repeated: a node comes twice (it is then one node, of the
    least level, for the other checks).
    """
    lv = nodes.groupBy("sentence_id", "node_id").agg(F.min("topo_level").alias("topo_level"), F.count("*").alias("times"))
    repeated = lv.agg(F.count_if(F.col("times") > 1).alias("n")).withColumn("check", F.lit("repeated"))
    lv = lv.drop("times")
    e = (
        edges.join(lv.withColumnsRenamed({"node_id": "src", "topo_level": "ls"}), ["sentence_id", "src"], "left")
        .join(lv.withColumnsRenamed({"node_id": "dst", "topo_level": "ld"}), ["sentence_id", "dst"], "left")
    )
    ends = lv.groupBy("sentence_id").agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    d = degrees(lv, edges).join(ends, "sentence_id")
    parts = [
        e.agg(F.count_if(F.col("ls") >= F.col("ld")).alias("n")).withColumn("check", F.lit("level")),
        e.agg(F.count_if(F.col("ls").isNull() | F.col("ld").isNull()).alias("n")).withColumn("check", F.lit("dangling")),
        d.agg(F.count_if((F.col("node_id") == F.col("lo")) & (F.col("in_degree") > 0)).alias("n")).withColumn("check", F.lit("first")),
        d.agg(F.count_if((F.col("node_id") == F.col("hi")) & (F.col("out_degree") > 0)).alias("n")).withColumn("check", F.lit("last")),
        repeated,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("check", "n")


def same_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right, both): counts of distinct (sentence_id, src, dst) of two edge tables."""
    a = left.select("sentence_id", "src", "dst", F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select("sentence_id", "src", "dst", F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).groupBy("sentence_id", "src", "dst").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"), F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"))
