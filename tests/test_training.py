"""Trained scorers: gradients against differences, learning, averaging of tasks, resuming, frozen features."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.operators import training as T

NODE = pa.struct([("node", pa.int32()), ("level", pa.int32()), ("gold", pa.bool_()), ("inner", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32()), *((c, pa.int32()) for c in T.IDS), ("x", pa.list_(pa.float32()))])


def lattices(sentences, levels=4, width=3, seed=1, dense=3):
    """Rows of lattices in which the first feature and tag 2 mark the gold node of each level."""
    rng, rows = np.random.default_rng(seed), []
    for s in range(sentences):
        nodes = [{"node": 0, "level": 0, "gold": False, "inner": False, "start": 0, "stop": 0, **dict.fromkeys(T.IDS, 0), "x": [0.0] * dense}]
        for level in range(1, levels + 1):
            good = int(rng.integers(0, width))
            for j in range(width):
                x = rng.normal(0, 0.3, dense)
                x[0] += j == good
                ids = {c: int(rng.integers(2, 6)) for c in T.IDS} | {"tag": 2 if j == good else 3}
                nodes.append({"node": len(nodes), "level": level, "gold": j == good, "inner": True, "start": 2 * level, "stop": 2 * level + 1, **ids, "x": x.astype(np.float32).tolist()})
        nodes.append({"node": len(nodes), "level": levels + 1, "gold": False, "inner": False, "start": 0, "stop": 0, **dict.fromkeys(T.IDS, 0), "x": [0.0] * dense})
        rows.append((s, "train" if s % 4 else "dev", "abc abd ab"[: int(rng.integers(6, 11))], nodes))
    return rows


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.list_(NODE))], names=["sentence_id", "split", "text", "nodes"])


MODEL = T.Model(dense=3, skip=1, tables={"form": (6, 2), "tag": (5, 2)}, project=4, alphabet="ab", chars=(2, 3, 2), rank=3)


def numeric(value, p, name, eps=1e-6):
    out = np.zeros_like(p[name])
    for i in np.ndindex(*p[name].shape):
        old = p[name][i]
        p[name][i] = old + eps
        up = value(p)
        p[name][i] = old - eps
        out[i] = (up - value(p)) / (2 * eps)
        p[name][i] = old
    return out


def test_gradients_of_the_scorer_with_all_its_parts():
    s = T.Sentences(batch(lattices(3)))
    p = MODEL.start(3)
    loss, taught, grads = MODEL.loss(p, s, 1.0)
    assert taught == 3 and loss > 0 and set(grads) == set(p)
    for name in p:
        want = numeric(lambda q: MODEL.loss(q, s, 1.0)[0], p, name)
        if name.startswith("table.") or name == "letters":
            want[0] = 0  # row 0 pads and is not learned
        assert np.allclose(grads[name], want, atol=1e-5), name


def candidates(rows, seed=2):
    rng, out = np.random.default_rng(seed), []
    for sid, split, text, nodes in rows:
        gold = [n["node"] for n in nodes if n["gold"]]
        paths = [{"rank": k, "score": float(-k), "nodes": [int(rng.choice([n["node"] for n in nodes if n["level"] == lv])) for lv in range(1, 5)], "label": False} for k in range(3)]
        paths.append({"rank": 3, "score": -3.0, "nodes": gold, "label": True})
        for path in paths:
            path["label"] = path["nodes"] == gold
        out.append((sid, split, text, nodes, paths))
    return out


PATH = pa.struct([("rank", pa.int32()), ("score", pa.float64()), ("nodes", pa.list_(pa.int32())), ("label", pa.bool_())])


def test_gradients_of_the_reranker():
    rows = candidates(lattices(3))
    c = T.Candidates(pa.RecordBatch.from_arrays([*batch(rows).columns, pa.array([r[4] for r in rows], pa.list_(PATH))], names=["sentence_id", "split", "text", "nodes", "paths"]))
    ranker = T.PathRanker(3, 2)
    p = ranker.start(1)
    assert np.array_equal(ranker.scores(p, c.x, c.lengths)[0], np.zeros(len(c.base)))
    p["out"] = np.random.default_rng(1).normal(size=4)
    _, taught, grads = ranker.loss(p, c)
    assert taught == 3 and set(grads) == set(p)
    for name in p:
        assert np.allclose(grads[name], numeric(lambda q: ranker.loss(q, c)[0], p, name), atol=1e-5), name


@pytest.fixture(scope="module")
def stored(spark):
    schema = "sentence_id long, split string, text string, nodes array<struct<node int, level int, gold boolean, inner boolean, start int, stop int, form int, lemma int, preverb int, tag int, x array<float>>>"
    return spark.createDataFrame([(s, k, t, [tuple(n.values()) for n in nodes]) for s, k, t, nodes in lattices(160)], schema).repartition(3, "sentence_id").cache()


def test_training_learns_and_a_resumed_run_is_the_same(spark, stored, tmp_path):
    model = T.Model(dense=3, rank=3)
    train, dev = stored.where("split = 'train'"), stored.where("split = 'dev'")
    score = lambda p: T.evaluate(dev, model, p)["f1"]
    first = model.start(1)
    first["source"] *= -1  # a start that prefers wrong nodes
    p, log = T.train(train, model, first, score, epochs=4, batch=16, rate=0.05)
    assert score(p) > 0.85 > 0.6 > score(first) and log[0]["taught"] == 120 and log[-1]["loss"] < log[0]["loss"]
    folder = str(tmp_path / "run")
    T.train(train, model, first, score, epochs=2, batch=16, rate=0.05, folder=folder)
    again, more = T.train(train, model, first, score, epochs=4, batch=16, rate=0.05, folder=folder)
    assert [r["epoch"] for r in more] == [2, 3] and all(np.allclose(again[k], p[k]) for k in p)
    from pathloom.operators import runs

    assert runs.read_log(spark, f"{folder}/log").where("name = 'loss'").count() == 4


def test_frozen_features_score_the_same_and_no_rows_change_nothing(spark, stored):
    model = T.Model(dense=3, tables={"form": (6, 2)}, alphabet="abc", chars=(2, 3, 2), rank=2)
    p = model.start(5)
    frozen = T.materialize(stored, model, p).groupBy("sentence_id", "node_id").agg(F.first("x").alias("x"))
    nodes = stored.select("sentence_id", "split", "text", F.explode("nodes").alias("n")).join(frozen.withColumnRenamed("node_id", "node"), "sentence_id").where("n.node = node")
    rows = nodes.groupBy("sentence_id", "split", "text").agg(F.collect_list(F.struct(*[F.col(f"n.{c}").alias(c) for c in ("node", "level", "gold", "inner", "start", "stop", *T.IDS)], "x")).alias("nodes"))
    plain = T.Model(dense=model.width, rank=2)
    q = {k: p[k] for k in ("source", "destination", "bias")}
    paths = lambda df: {r["sentence_id"]: (r["nodes"], round(r["score"], 4)) for r in df.collect()}
    assert paths(T.predict(stored, model, p)) == paths(T.predict(rows, plain, q))
    same, log = T.train(stored.where("false"), model, p, epochs=1)
    assert all(np.array_equal(same[k], p[k]) for k in p) and log[0]["taught"] == 0
    warm = T.Model(dense=3, tables={"form": (6, 2), "tag": (5, 2)}, rank=2).start(9, p)
    assert np.array_equal(warm["table.form"], p["table.form"])


def test_fused_scoring_broadcasts_nothing_whatever_size_spark_expects(spark, tmp_path):
    from pathloom.plans import models

    rows = [(s, i, level, length, i, 0) for s in range(20) for i, (level, length) in enumerate([(0, 0), (1, 2 + s), (1, 3), (2, 4), (4, 9)])]
    rows += [(30, 0, None, 5, 1, 0), (30, 1, 0, 5, 1, 0), (None, 0, 0, 1, 1, 0), rows[0]]
    columns = "sentence_id long, node_id int, topo_level int, length int, position int, chunk int"
    nodes = spark.createDataFrame(rows, columns).selectExpr("*", "false as is_gold", "0 as char_start", "0 as form_id", "0 as lemma_id", "0 as preverb_id", "0 as tag_id")
    nodes.write.parquet(f"{tmp_path}/nodes.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        df = models.m05_fused_scoring(spark, str(tmp_path))
        found = {r["sentence_id"]: (r["fused"], r["two_pass"]) for r in df.collect()}
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # no length and place at the source; then the longer node of level 1, to the one of level 2
    score = lambda n, i: 0.5 + n * 8.0 + i * 3.0 + 0.5
    assert found == {**{s: (max(score(2 + s, 1), score(3, 2)),) * 2 for s in range(20)}, 30: (0.0, 0.0)}
