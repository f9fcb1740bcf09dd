"""GraphML lattices: reading with the XML source, and writing.

A document has key declarations (key id to attribute name), nodes and edges with data elements.
The schema is given, so nothing is inferred; a document that cannot be read has its text in
``_corrupt_record`` and no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATA = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())]))
_NODE = T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", _DATA)])
_EDGE = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), T.StructField("data", _DATA)])
_KEY = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_attr.name", T.StringType()), T.StructField("_for", T.StringType())])
SCHEMA = T.StructType(
    [
        T.StructField("_corrupt_record", T.StringType()),
        T.StructField("_stem", T.StringType()),
        T.StructField("key", T.ArrayType(_KEY)),
        T.StructField("graph", T.StructType([T.StructField("node", T.ArrayType(_NODE)), T.StructField("edge", T.ArrayType(_EDGE))])),
    ]
)
# The attributes of nodes, in the order in which they are written.
NODE_FIELDS = ["word", "lemma", "morph", "pre_verb", "cng", "chunk_no", "position", "length_word"]


def _columns(stem: Column, corrupt: Column, doc: str = "", edges: bool = True) -> list[Column]:
    key = F.col(f"{doc}key")
    names = F.map_from_entries(F.transform(F.coalesce(key, F.array().cast(SCHEMA["key"].dataType)), lambda k: F.struct(k["_id"], k["_attr.name"])))
    return [stem.alias("stem"), names.alias("names"), F.col(f"{doc}graph.node").alias("nodes"), *([F.col(f"{doc}graph.edge").alias("edges")] if edges else []), corrupt.alias("corrupt")]


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(stem, names, nodes, edges, corrupt): one row per file below ``path``, one document each.

    The stem is the document's own ``stem`` attribute, else the file's name without its ending.
    ``names`` maps key ids to attribute names.
    """
    raw = spark.read.format("xml").option("rowTag", "graphml").option("mode", "PERMISSIVE").schema(SCHEMA).load(path)
    file = F.regexp_replace(F.col("_metadata.file_name"), r"\.graphml$", "")
    return raw.select(*_columns(F.coalesce("_stem", file), F.col("_corrupt_record")))


def _once(document: Column) -> Column:
    """A parsed document as a generator's row: a plain column would be parsed again by every filter and projection that is merged with it."""
    return F.explode(F.array(document))


def parse_graphml(lines: DataFrame, value: str = "value") -> DataFrame:
    """The same rows from a column of documents; the stem is their ``stem`` attribute."""
    schema = T.StructType([f for f in SCHEMA if f.name != "_corrupt_record"])
    parsed = lines.select(_once(F.from_xml(F.col(value), schema, {"rowTag": "graphml", "mode": "PERMISSIVE"})).alias("d"), F.col(value).alias("v"))
    broken = F.when(F.col("d.graph").isNull(), F.col("v"))
    return parsed.select(*_columns(F.col("d._stem"), broken, "d."))


def parse_words(lines: DataFrame, fields: list[str], value: str = "value") -> DataFrame:
    """(stem, node_id, fields...) straight from a column of documents: edges are never built."""
    graph = T.StructType([T.StructField("node", T.ArrayType(_NODE))])
    schema = T.StructType([T.StructField("graph", graph) if f.name == "graph" else f for f in SCHEMA if f.name != "_corrupt_record"])
    parsed = lines.select(_once(F.from_xml(F.col(value), schema, {"rowTag": "graphml", "mode": "PERMISSIVE"})).alias("d"))
    documents = parsed.select(*_columns(F.col("d._stem"), F.lit(None).cast("string"), "d.", edges=False))
    return graph_nodes(documents, fields)


def node_id(name: Column) -> Column:
    """The number of a node name, with or without a leading n; null if it is none."""
    return F.regexp_replace(name, "^n", "").try_cast("long")


def _attribute(data: Column, key: str) -> Column:
    """A node's or edge's value of an attribute by the column that holds its key id; a repeated key has its last value.

    Each asked attribute is one pass over the few data elements, and no map is built.
    """
    own = F.filter(data, lambda d: d["_key"] == F.col(key))
    return F.when(F.size(own) > 0, F.element_at(own, -1)["_VALUE"])


def _asked(documents: DataFrame, fields: list[str], each: str) -> DataFrame:
    """(stem, x, k_<field>...): the exploded elements with the key ids of the asked attributes, looked up once per document."""
    ids = [F.coalesce(F.try_element_at("keys", F.lit(f)), F.lit(f)).alias(f"k_{f}") for f in fields]
    return _keys(documents.where(F.col(each).isNotNull())).select("stem", each, *ids).select("stem", F.explode(each).alias("x"), *[f"k_{f}" for f in fields])


def _keys(documents: DataFrame) -> DataFrame:
    """The documents with ``keys``: attribute names to key ids."""
    entries = F.transform(F.map_entries("names"), lambda e: F.struct(e["value"], e["key"]))
    return documents.withColumn("keys", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def graph_nodes(documents: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(stem, node_id, fields...) of all nodes; only the asked attributes are taken out, missing ones are null."""
    asked = fields or NODE_FIELDS
    each = _asked(documents, asked, "nodes")
    return each.select("stem", node_id(F.col("x._id")).alias("node_id"), *[_attribute(F.col("x.data"), f"k_{f}").alias(f) for f in asked])


def graph_edges(documents: DataFrame) -> DataFrame:
    """(stem, src, dst, key) of all edges; an edge without a readable key has null."""
    each = _asked(documents, ["key"], "edges")
    return each.select("stem", node_id(F.col("x._source")).alias("src"), node_id(F.col("x._target")).alias("dst"), _attribute(F.col("x.data"), "k_key").try_cast("int").alias("key"))


def _escaped(col: Column) -> Column:
    out = F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def graphml_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(stem, value): one GraphML document per stem, on one line.

    nodes (stem, node_id, NODE_FIELDS...), edges (stem, src, dst, key). Null attributes are left out.
    """
    datum = lambda key, col: F.coalesce(F.concat(F.lit(f'<data key="{key}">'), _escaped(col.cast("string")), F.lit("</data>")), F.lit(""))
    node = F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('">'), *[datum(f"d{i}", F.col(f)) for i, f in enumerate(NODE_FIELDS)], F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('">'), datum(f"d{len(NODE_FIELDS)}", F.col("key")), F.lit("</edge>"))
    keys = "".join(f'<key id="d{i}" for="node" attr.name="{f}" attr.type="string"/>' for i, f in enumerate(NODE_FIELDS)) + f'<key id="d{len(NODE_FIELDS)}" for="edge" attr.name="key" attr.type="long"/>'
    n = nodes.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", node.alias("x")))), lambda s: s["x"]), "").alias("n"))
    e = edges.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", edge.alias("x")))), lambda s: s["x"]), "").alias("e"))
    text = F.concat(F.lit('<graphml stem="'), _escaped(F.col("stem")), F.lit(f'">{keys}<graph edgedefault="directed">'), "n", F.coalesce("e", F.lit("")), F.lit("</graph></graphml>"))
    return n.join(e, "stem", "left").select("stem", text.alias("value"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write the documents as lines of text files."""
    graphml_documents(nodes, edges).select("value").write.mode("overwrite").text(path)
