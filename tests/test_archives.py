"""Archives, caches, stores and sharded runs: round trips on odd data, and errors that name the fault."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import align, ladder, lattice, maps, runs, stats
from pathloom.sources import archive
from pathloom.sources import tables as S

NODES = "sentence_id long, node_id int, topo_level int, tag_id int, length int, position int, chunk int, form_id int, lemma_id int, preverb_id int, char_start int, is_gold boolean"


def lattices(spark):
    nodes = [(7, 4, 0, 1, 2, 0, 1, 5, 6, 0, 0, True), (7, 9, 1, 2, 3, None, 1, 7, 8, 0, 2, True), (7, 6, 1, 3, 1, 2, 1, 9, 9, -1, 2, False), (3, 0, 0, 1, 1, 0, 1, 5, 6, 0, 0, False)]
    n = spark.createDataFrame(nodes, NODES)
    return archive.gathered(n, lattice.level_edges(n), spark.createDataFrame([(7, "rāma"), (3, None)], "sentence_id long, text string"))


@pytest.mark.parametrize("raw", [True, False])
def test_archives_give_back_what_was_written(spark, rows, tmp_path, raw):
    folder = str(tmp_path / "a")
    archive.write_archives(lattices(spark), folder, raw, per_archive=1)
    assert rows(archive.read_archives(spark, folder, "nodes", ["length", "position"]).drop("file")) == [(3, 0, False, 1, 0), (7, 0, True, 2, 0), (7, 1, False, 1, 2), (7, 2, True, 3, -1)]
    assert rows(archive.read_archives(spark, folder, "edges").drop("file")) == [(7, 0, 1), (7, 0, 2)]
    cache = str(tmp_path / "cache")
    archive.extract(spark, folder, cache)
    assert rows(archive.scan_cache(spark, cache, ["form_id"], rows_per_task=2)) == [(3, 0, 5), (7, 0, 5), (7, 1, 9), (7, 2, 7)]
    assert rows(archive.repack(spark, cache, str(tmp_path / "b")), "nodes", "edges", "sentences") == [(1, 0, 1), (3, 2, 1)]


def test_empty_tables_make_no_archives(spark, tmp_path):
    folder = str(tmp_path / "a")
    archive.write_archives(lattices(spark).where("false"), folder)
    (tmp_path / "a").mkdir(exist_ok=True)
    assert archive.read_archives(spark, folder).count() == 0 and archive.scan_cache(spark, folder, ["length"]).count() == 0


def test_faulty_arrays_are_named():
    good = {"row_ptr": np.array([0, 1, 1], np.int32), "col_idx": np.array([1], np.int32), "topo_level": np.array([0, 1], np.int32), "sentence_offsets": np.array([0, 2], np.int32)}
    assert archive.checked(dict(good)) == good
    for name, value in (("row_ptr", None), ("topo_level", np.array([0, 1], np.int64)), ("sentence_offsets", np.array([0, 1], np.int32)), ("row_ptr", np.array([0, 2, 1], np.int32))):
        bad = {k: v for k, v in good.items() if k != name} | ({} if value is None else {name: value})
        with pytest.raises(ValueError, match=name):
            archive.checked(bad)
    out = io.BytesIO()
    np.savez(out, rowptr=good["row_ptr"], colidx=good["col_idx"], topolevel=good["topo_level"], sentenceoffsets=np.array([0], np.int32))
    assert archive.load(out.getvalue())["sentence_offsets"].tolist() == [0, 2]


def test_features_of_another_width_or_name_are_errors(spark, rows, tmp_path):
    v = spark.createDataFrame([(1, 2, [1.0, 2.0])], "sentence_id long, node_id int, x array<float>")
    folder = str(tmp_path / "f")
    archive.write_features(v, folder, "mine", 2)
    assert rows(archive.read_features(spark, folder, "mine")) == [(1, 2, (1.0, 2.0), "mine")]
    with pytest.raises(Exception, match="asked other"):
        archive.read_features(spark, folder, "other").collect()
    with pytest.raises(Exception, match="has 3"):
        archive.write_features(v, folder, "mine", 3)


def test_guards_raise(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "k long") for x in ([1, 2, 2], [2, 3]))
    assert maps.require_disjoint(a.where("k = 1"), b, "k", "sides").first()[0] == 0
    with pytest.raises(Exception, match="sides: 1 keys in both"):
        maps.require_disjoint(a, b, "k", "sides").collect()
    m, r = (spark.createDataFrame([(i, i) for i in range(n)], f"row long, {c} long") for n, c in ((3, "id"), (2, "result")))
    with pytest.raises(Exception, match="unlike numbers of rows: 3, 2"):
        S.link_by_row(m, r, "row").collect()


def test_shards_go_on_where_they_stopped(spark, rows, tmp_path):
    data, folder = spark.range(50).withColumnRenamed("id", "k"), str(tmp_path / "s")
    work = lambda df: df.groupBy().agg(F.count("*").alias("n"))
    assert runs.run_shards(data, "k", 3, folder, work, max_new=1) == [0]
    with pytest.raises(FileNotFoundError, match=r"\[1, 2\]"):
        runs.merge(spark, folder, 3)
    assert runs.run_shards(data, "k", 3, folder, work) == [1, 2] and runs.run_shards(data, "k", 3, folder, work) == []
    assert runs.merge(spark, folder, 3).agg(F.sum("n")).first()[0] == 50


def test_documents_and_samples(spark, rows, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 50_000), (2, ""), (9, None)], "idx long, text string")
    S.write_documents(docs, str(tmp_path / "d"))
    assert rows(S.read_documents(spark, str(tmp_path / "d"))) == rows(docs)
    assert S.read_documents(spark, str(tmp_path / "d"), 2).count() == 1 and S.read_documents(spark, str(tmp_path / "d"), 10).count() == 0
    S.write_files(spark.createDataFrame([("a.txt", "é"), ("b.txt", None), (None, "x")], "name string, content string"), "name", "content", str(tmp_path / "f"))
    assert rows(S.copy_sample(spark, str(tmp_path / "f"), str(tmp_path / "g"), 5, 1)) == [("a", 2), ("b", 0)]
    assert rows(S.stems(spark, str(tmp_path / "g"), 1)) == [("a",)]


def test_quantiles_are_those_of_sorted_values(spark):
    values = [3.0, 1.0, 1.0, None, 10.0, 2.5]
    numbers, q = stats.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v"), [0, 0.25, 0.5, 0.99, 1])
    assert numbers["n"] == 5 and np.allclose(q, np.quantile([v for v in values if v is not None], [0, 0.25, 0.5, 0.99, 1]))
    assert stats.quantiles(spark.createDataFrame([], "v double"), F.col("v"), [0.5]) == ({"n": 0, "mean": None, "most": None}, [None])


def test_resolution_of_empty_and_odd_tables(spark, rows):
    gold = spark.createDataFrame([(1, 0), (None, 0), (2, 0)], "sentence_id long, place int")
    cands = spark.createDataFrame([(1, 0, 5, True), (2, 0, 99, True), (3, 0, 1, True)], "sentence_id long, place int, node int, exact boolean")
    nodes = spark.createDataFrame([(1, 5, 1, None), (2, 4, None, "x")], "sentence_id long, node int, chunk int, surface string")
    edges = spark.createDataFrame([(1, 5, 77)], "sentence_id long, src int, dst int")
    assert rows(align.resolve(gold, cands, nodes, edges), "sentence_id", "resolved_by", "nodes") == [(1, "exact", (5,)), (2, "none", ())]
    assert align.resolve(gold.where("false"), cands, nodes, edges).count() == 0


def test_ladder_of_one_sentence(spark, rows):
    g = spark.createDataFrame([(1, ["a", "b"], ["x", "y"], [["x", "z"], ["y"]], ["1", "2"]), (2, ["a"], ["x"], [["x"]], ["1"])], "sentence_id long, form array<string>, strict array<string>, tolerant array<array<string>>, code array<string>")
    p = spark.createDataFrame([(1, ["a", "b"], ["z", "y"], ["1", "2"])], "sentence_id long, form array<string>, lemma array<string>, code array<string>")
    assert dict(rows(ladder.ladder(g, p), "level", "hits")) == {"S": 1, "L": 0, "L(tol)": 1, "S+M": 1, "L+M": 0, "L+M(tol)": 1, "S+L+M": 0, "S+L+M(tol)": 1}
