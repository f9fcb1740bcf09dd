"""K best paths, levels and counts against exhaustive enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import lattice as L
from pathloom.operators import scorers as S
from pathloom.operators.sweep import kbest, keep_histogram, level_sweep, path_counts, row_sweep, sweep

NODES, EDGES = "sentence_id long, node_id int", "sentence_id long, edge_id long, src int, dst int, w double"


def enumerate_paths(nodes, edges):
    """All source to sink paths as (score, nodes)."""
    out = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
    targets = {v for _, v, _ in edges}
    found = []

    def walk(path, score):
        if path[-1] not in out:
            found.append((score, path))
        for v, w in out.get(path[-1], ()):
            walk([*path, v], score + w)

    for n in nodes:
        if n not in targets:
            walk([n], 0.0)
    return found


def tables(spark, graphs):
    n = [(s, i) for s, (nodes, _) in graphs.items() for i in nodes]
    e = [(s, k, u, v, float(w)) for s, (_, edges) in graphs.items() for k, (u, v, w) in enumerate(edges)]
    return spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)


DIAMOND = ([0, 1, 2, 3], [(0, 1, 5), (0, 2, 1), (1, 3, 2), (2, 3, 2)])


def decoded(df):
    return [(r["rank"], r["score"], list(r["nodes"])) for r in df.orderBy("sentence_id", "rank").collect()]


def test_single_node_has_one_empty_path(spark):
    n, e = tables(spark, {1: ([0], [])})
    assert decoded(kbest(n, e, 5)) == [(0, 0.0, [0])]


def test_diamond_order_and_prefix_property(spark):
    n, e = tables(spark, {1: DIAMOND})
    two = decoded(kbest(n, e, 2))
    assert two == [(0, 7.0, [0, 1, 3]), (1, 3.0, [0, 2, 3])]
    assert decoded(kbest(n, e, 1)) == two[:1]
    assert decoded(kbest(n, e, 9)) == two


def test_equal_scores_go_to_the_smaller_parent(spark):
    n, e = tables(spark, {1: ([0, 1, 2, 3], [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)])})
    assert [p for _, _, p in decoded(kbest(n, e, 2))] == [[0, 1, 3], [0, 2, 3]]


def test_edge_tie_break_follows_edge_ids(spark):
    n, e = tables(spark, {1: ([0, 1, 2, 3], [(0, 1, 1), (0, 2, 1), (2, 3, 1), (1, 3, 1)])})
    assert [p for _, _, p in decoded(kbest(n, e, 2, "edge"))] == [[0, 2, 3], [0, 1, 3]]


def test_ties_at_the_truncation_keep_the_smallest_parents(spark):
    parents = list(range(1, 9))
    n, e = tables(spark, {1: ([0, *parents, 9], [(0, p, 5) for p in parents] + [(p, 9, 0) for p in reversed(parents)])})
    assert [p[1] for _, _, p in decoded(kbest(n, e, 3))] == [1, 2, 3]


def test_fan_of_twenty(spark):
    n, e = tables(spark, {1: (list(range(22)), [(0, i, i) for i in range(1, 21)] + [(i, 21, 0) for i in range(1, 21)])})
    got = decoded(kbest(n, e, 32))
    assert [p[1] for _, _, p in got] == list(range(20, 0, -1))


def test_several_sentences_negative_weights_and_interleaved_ids(spark):
    graphs = {s: ([7, 3, 5, 1], [(7, 3, -2 - s), (7, 5, -1), (3, 1, 0), (5, 1, -3)]) for s in range(5)}
    n, e = tables(spark, graphs)
    for s, (nodes, edges) in graphs.items():
        want = sorted((-sc, p) for sc, p in enumerate_paths(nodes, edges))
        got = decoded(kbest(n.where(F.col("sentence_id") == s), e.where(F.col("sentence_id") == s), 9))
        assert [(-sc) for _, sc, _ in got] == [w[0] for w in want]


def test_a_chain_of_fifty(spark):
    n, e = tables(spark, {1: (list(range(51)), [(i, i + 1, 1) for i in range(50)])})
    assert decoded(kbest(n, e, 5)) == [(0, 50.0, list(range(51)))]


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_against_enumeration(spark, seed):
    rng = random.Random(seed)
    graphs = {}
    for s in range(12):
        size = rng.randint(2, 9)
        edges = [(u, v, rng.randint(-3, 3)) for u, v in itertools.combinations(range(size), 2) if rng.random() < 0.5]
        graphs[s] = (list(range(size)), edges)
    n, e = tables(spark, graphs)
    k = 6
    got = {s: [] for s in graphs}
    for r in kbest(n, e, k).orderBy("sentence_id", "rank").collect():
        got[r["sentence_id"]].append((r["score"], list(r["nodes"])))
    counts = {(r["sentence_id"], r["node_id"]): r["paths"] for r in path_counts(n, e, 10**6).collect()}
    levels = {(r["sentence_id"], r["node_id"]): r["level"] for r in L.levels(n, e).collect()}
    for s, (nodes, edges) in graphs.items():
        paths = enumerate_paths(nodes, edges)
        assert [x for x, _ in got[s]] == sorted((x for x, _ in paths), reverse=True)[:k]
        assert all((x, p) in [(y, q) for y, q in paths] for x, p in got[s])
        assert len({tuple(p) for _, p in got[s]}) == len(got[s])
        sinks = {p[-1] for _, p in paths}
        assert sum(counts[s, v] for v in sinks) == len(paths)
        for u, v, _ in edges:
            assert levels[s, u] < levels[s, v]


def test_a_cycle_has_no_levels_and_no_paths(spark):
    n, e = tables(spark, {1: ([0, 1, 2], [(0, 1, 1), (1, 2, 1), (2, 1, 1)]), 2: DIAMOND})
    assert {r["sentence_id"] for r in L.cyclic_sentences(n, e).collect()} == {1}
    assert {r["sentence_id"] for r in kbest(n, e, 1).collect()} == {2}


def test_empty_tables_nulls_and_extra_columns(spark):
    n, e = tables(spark, {})
    assert kbest(n, e, 2).count() == 0
    n, e = tables(spark, {1: DIAMOND})
    odd = n.unionByName(spark.createDataFrame([(None, 1), (1, None), (1, 0)], NODES)).withColumn("w", F.lit(9.0)).withColumn("rank", F.lit(1))
    gone = e.unionByName(spark.createDataFrame([(1, 9, 0, 77, 1.0), (None, 9, 0, 1, 1.0)], EDGES)).withColumn("node_id", F.lit(3))
    assert decoded(kbest(odd, gone, 2)) == [(0, 7.0, [0, 1, 3]), (1, 3.0, [0, 2, 3])]


def test_a_lattice_joined_with_itself_keeps_its_scores(spark):
    n, e = tables(spark, {s: DIAMOND for s in range(50)})
    n = n.repartition("sentence_id").dropDuplicates()
    best = kbest(n, e, 1).select("sentence_id", "score")
    assert best.join(best.withColumnRenamed("score", "other"), "sentence_id").where("score <> other").count() == 0


def test_keep_histogram_has_zeros(spark, rows):
    n, e = tables(spark, {1: DIAMOND})
    assert rows(keep_histogram(path_counts(n, e, 3), 3)) == [(0, 0), (1, 3), (2, 1), (3, 0)]


def test_unknown_tie_break_and_k_are_errors(spark):
    n, e = tables(spark, {1: DIAMOND})
    with pytest.raises(ValueError):
        kbest(n, e, 0)
    with pytest.raises(ValueError):
        kbest(n, e, 1, "other")


def test_scorers(spark, rows):
    e = spark.createDataFrame([(1, 0, 0, 1)], "sentence_id long, edge_id long, src int, dst int")
    x = spark.createDataFrame([(1, 0, [1.0, 0.0, 2.0]), (1, 1, [0.0, 3.0, 1.0])], "sentence_id long, node_id int, x array<double>")
    assert S.biaffine(x, e, [[1, 0, 0.5], [0, 1, 0]], [[2, 0, 1], [0, 1, 1]], 0.5).first()["w"] == pytest.approx(2.5)
    y = spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0])], "sentence_id long, node_id int, x array<double>")
    assert S.log_linear(y, e, [0.5, -1, 2], 0.25).first()["w"] == pytest.approx(4.75)
    with pytest.raises(Exception, match="width"):
        S.log_linear(y, e, [0.5, -1], 0.25).collect()


def test_orientation_by_position_and_inheritance(spark, rows):
    nodes = spark.createDataFrame([(1, 1, 1, 5, 3), (1, 2, 1, 0, 4), (1, 3, 2, 0, 2)], "sentence_id long, node_id int, chunk int, position int, length int")
    pairs = spark.createDataFrame([(1, a, b, k) for a, b, k in [(1, 2, 1), (2, 1, 1), (1, 3, 1), (3, 1, 1), (2, 3, 2), (3, 2, 2), (1, 1, 1)]], "sentence_id long, src int, dst int, key int")
    assert rows(L.orient(pairs, nodes, "position", (1,)), "src", "dst") == [(1, 3), (2, 1)]
    assert rows(L.orient(pairs, nodes, "id", (1, 2)), "src", "dst") == [(1, 2), (1, 3), (2, 3)]
    with pytest.raises(ValueError):
        L.orient(pairs, nodes, "size")
    edges = spark.createDataFrame([(1, 0, 1, 2)], "sentence_id long, edge_id long, src int, dst int")
    hosts = spark.createDataFrame([(1, 9, 1)], "sentence_id long, orphan int, host int")
    assert rows(L.inherit_host_edges(edges, hosts), "src", "dst") == [(1, 2), (9, 2)]


def test_validation_counts(spark, rows):
    nodes = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (1, 2, 0), (1, 2, 0)], "sentence_id long, node_id int, topo_level int")
    edges = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 7)], "sentence_id long, edge_id long, src int, dst int")
    assert dict(rows(L.validate(nodes, edges))) == {"level": 1, "dangling": 1, "first": 0, "last": 1, "repeated": 1}


def test_level_sweep_equals_the_sweep_over_level_edges(spark):
    rng = random.Random(9)
    rows = [(s, i, rng.choice([None, *range(6)]), rng.randint(-3, 3)) for s in range(30) for i in rng.sample(range(20), rng.randint(1, 12))]
    nodes = spark.createDataFrame(rows + rows[:9] + [(None, 1, 1, 1), (1, None, 1, 1)], "sentence_id long, node_id int, topo_level int, c int")
    clean = L.clean_nodes(nodes)
    w = clean.select("sentence_id", F.col("node_id").alias("dst"), F.col("c").cast("double").alias("w"))
    edges = L.level_edges(clean)
    for program, k in (("kbest", 3), ("counts", 5), ("levels", 1)):
        a = sweep(clean, edges.join(w, ["sentence_id", "dst"]), program, k)
        b = level_sweep(nodes, F.col("c"), program, k)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_edges_scored_where_nodes_lie_equal_the_joined_ones(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice([None, *range(5)]), [float(rng.randint(-3, 3)) for _ in range(3)]) for s in range(30) for i in rng.sample(range(20), rng.randint(1, 12))]
    nodes = L.clean_nodes(spark.createDataFrame(rows + rows[:9] + [(None, 1, 1, [0.0] * 3)], "sentence_id long, node_id int, topo_level int, x array<double>"))
    weights = [[1, 0, 0.5], [0, 1, 0]], [[2, 0, 1], [0, 1, 1]], 0.5
    joined = S.biaffine(nodes, L.level_edges(nodes), *weights)
    lying = S.biaffine_levels(nodes, *weights)
    names = ["sentence_id", "src", "dst", "w"]
    assert sorted(map(str, lying.where("dst is not null").collect())) == sorted(map(str, joined.select(names).collect()))
    assert sorted(lying.where("dst is null").select("sentence_id", "src").collect()) == sorted(nodes.select("sentence_id", "node_id").collect())
    assert sorted(map(str, row_sweep(lying, "kbest", 3).collect())) == sorted(map(str, kbest(nodes, joined, 3).collect()))
    with pytest.raises(ValueError):
        S.biaffine_levels(nodes, weights[0], weights[1][:1])
