"""The pivot over chunks holds every node."""

from pathloom.plans.corpus import v06_level_pivot


def test_the_columns_sum_to_all_nodes(spark, tmp_path):
    nodes = [(1, i, c, g) for i, (c, g) in enumerate([(-1, False), (0, True), (1, True), (1, True), (4, False), (5, False), (11, True), (None, None), (-1, False)])]
    spark.createDataFrame([*nodes, nodes[2], (None, 1, 7, True)], "sentence_id long, node_id int, chunk int, is_gold boolean").write.parquet(str(tmp_path / "nodes.parquet"))
    got = {r.side: r.asDict() for r in v06_level_pivot(spark, str(tmp_path)).collect()}
    names = ["side", "boundary", "chunk_0", "chunk_1", "chunk_4", "chunk_5", "chunk_11", "no_chunk"]
    assert got == {"gold": dict(zip(names, ["gold", 0, 1, 2, 0, 0, 1, 0])), "other": dict(zip(names, ["other", 2, 0, 0, 1, 1, 0, 1]))}
