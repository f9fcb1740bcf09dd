"""Learned scorers over the ``nodes`` lattices. Each trains on the training split and reports on held-out sentences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.translit import SLP1_TO_IAST
from ..operators import lattice as L
from ..operators import metrics as M
from ..operators import scorers as SC
from ..operators import training
from ..operators.sweep import row_sweep
from ..sources import tables as S
from ..tables import ensure_checkpoint_dir, table
from .features import texts
from .lattice import NODES

ALPHABET = "".join(SLP1_TO_IAST) + " "
TAG_BITS = 43
#: sizes of the tables of embeddings; ids beyond them are unknown words
TABLES = {"form": (8_192, 12), "lemma": (4_096, 8), "preverb": (64, 4)}
TAGS = (1_024, 12)
EPOCHS = 2


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their split and ids counted down.

    In these tables the gold node has the least id of its level, so a tie that goes to the least id
    would give the gold path away to a scorer that knows nothing.
    """
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes"))
    return nodes.withColumn("node_id", -F.col("node_id")).withColumn("split", X.split_name(F.col("sentence_id")))


def _rows(spark: SparkSession, sf_dir: str, featurizer: str = "scalars64", words: bool = False) -> DataFrame:
    """Packed lattices with the features of a featurizer, stored once: every epoch reads them again."""
    ensure_checkpoint_dir(spark)
    nodes, text = _nodes(spark, sf_dir), texts(spark, sf_dir)
    fitted = X.fit(nodes, nodes.where("split = 'train'").select("sentence_id")) if featurizer != "morph43" else {}
    vectors = X.featurize(featurizer, nodes.join(text.select("sentence_id", "text_length"), "sentence_id", "left"), table(spark, sf_dir, "vocab"), fitted)
    named = text.select("sentence_id", F.col("surface_text").alias("text")) if words else None
    return training.packed(nodes, vectors, named).checkpoint()


def _fit(rows: DataFrame, model: training.Model, first: training.Params, epochs: int = EPOCHS) -> training.Params:
    dev = rows.where("split = 'dev'")
    return training.train(rows.where("split = 'train'"), model, first, lambda p: training.evaluate(dev, model, p)["f1"], epochs=epochs)[0]


def _report(spark: SparkSession, rows: DataFrame, made: list[tuple[str, training.Model, training.Params]]) -> DataFrame:
    held = rows.where("split = 'test'")
    out = []
    for name, model, params in made:
        e = training.evaluate(held, model, params)
        out.append((name, model.width, int(e["sentences"]), round(e["f1"], 6), round(e["perfect"], 6)))
    return spark.createDataFrame(out, "scorer string, width int, sentences long, f1 double, perfect_share double")


def m05_fused_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores of the bilinear scorer, fused (edges scored inside the batch that decodes) and in two passes (scored edge rows)."""
    source, destination, bias = [[1.0, 0.0, 0.5], [0.0, 1.0, 0.0]], [[2.0, 0.0, 1.0], [0.0, 1.0, 1.0]], 0.5
    x = F.array(*[F.col(c).cast("double") for c in ("length", "position", "chunk")])
    nodes = L.clean_nodes(table(spark, sf_dir, "nodes")).select("sentence_id", "node_id", "topo_level", x.alias("x"))
    # the boundaries have features here, so no node counts as one; what this scorer does not read is left blank, and both forms share one exchange
    blank = {c: F.lit(0) for c in ("chunk", "char_start", "length", "form_id", "lemma_id", "preverb_id", "tag_id")}
    rows = training.packed(nodes.withColumns(blank | {"split": F.lit(""), "is_gold": F.lit(False)}))
    params = {"source": np.array(source), "destination": np.array(destination), "bias": np.array([bias])}
    fused = training.predict(rows, training.Model(dense=3, rank=2), params).select("sentence_id", F.col("score").alias("fused"))
    two = row_sweep(SC.biaffine_levels(nodes, source, destination, bias), "kbest").select("sentence_id", F.col("score").alias("two_pass"))
    # Spark expects sizes from packed columns, many times too small: it shall broadcast neither side
    return fused.join(two.hint("merge"), "sentence_id")


def m06_hybrid_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ways to join embeddings and features, the later ones started from the first one's tables.

    hybrid: words beside all features; hybrid_tag: tags too; hybrid_tag_only: tags instead of their
    bits; hybrid_tag_full: all of it without a mixing projection. Words drop out in training.
    """
    rows = _rows(spark, sf_dir)
    kinds = {
        "hybrid": training.Model(64, 0, TABLES, 32, word_dropout=0.1), "hybrid_tag": training.Model(64, 0, TABLES | {"tag": TAGS}, 32, word_dropout=0.1),
        "hybrid_tag_only": training.Model(64, TAG_BITS, TABLES | {"tag": TAGS}, 32, word_dropout=0.1), "hybrid_tag_full": training.Model(64, 0, TABLES | {"tag": TAGS}, word_dropout=0.1),
    }
    made, warm = [], None
    for name, model in kinds.items():
        params = _fit(rows, model, model.start(1, warm), 1)
        warm = warm or {k: v for k, v in params.items() if k.startswith("table.")}
        made.append((name, model, params))
    return _report(spark, rows, made)


def m07_character_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bidirectional encoder of the sentence's letters under the scorer, trained with it: before and after."""
    rows = _rows(spark, sf_dir, "morph43", words=True)
    model = training.Model(64, 0, alphabet=ALPHABET, chars=(8, 12, 16), rank=16)
    first = model.start(1)
    return _report(spark, rows, [("untrained", model, first), ("trained", model, _fit(rows, model, first, 1))])


def m08_materialized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trained features frozen to Parquet and read back; paths decoded from them, beside those of the whole model."""
    rows = _rows(spark, sf_dir, "morph43")
    model = training.Model(64, 0, {"form": (8_192, 8)}, 16, rank=8)
    params = _fit(rows, model, model.start(1), 1)
    path = S.scratch(spark, "frozen")
    training.materialize(rows, model, params).write.parquet(path)
    frozen = training.packed(_nodes(spark, sf_dir), spark.read.parquet(path))
    scorer = {k: params[k] for k in ("source", "destination", "bias")}
    a = training.predict(rows, model, params).select("sentence_id", F.col("nodes").alias("a"))
    b = training.predict(frozen, training.Model(16, rank=8), scorer).select("sentence_id", F.col("nodes").alias("b"))
    return a.join(b, "sentence_id", "full").agg(F.count("*").alias("sentences"), F.count_if(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("same"))


def m09_structured_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bilinear scorer by cost-augmented decoding: held-out figures of the untrained and the trained one."""
    rows = _rows(spark, sf_dir)
    model = training.Model(64, rank=16)
    first = model.start(1)
    return _report(spark, rows, [("untrained", model, first), ("trained", model, _fit(rows, model, first))])


def m10_path_reranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-place accuracy on held-out sentences before and after a recurrent reranker of the eight best paths."""
    rows = _rows(spark, sf_dir)
    model = training.Model(64, rank=16)
    base_params = _fit(rows, model, model.start(1), 1)
    paths = training.predict(rows, model, base_params, 8).withColumn("nodes", M.strip(F.col("nodes")))
    gold = F.array_sort(F.transform(F.filter("nodes", lambda n: n["gold"]), lambda n: F.struct(n["level"], n["node"])))
    cands = paths.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "nodes"))).alias("c"))
    labelled = rows.join(cands, "sentence_id").withColumn("g", F.transform(gold, lambda x: x["node"]))
    label = lambda p: F.struct(p["rank"].alias("rank"), p["score"].alias("score"), p["nodes"].alias("nodes"), (p["nodes"] == F.col("g")).alias("label"))
    stored = labelled.select("sentence_id", "split", "text", "nodes", F.transform("c", label).alias("paths")).checkpoint()
    ranker = training.PathRanker(64, 12)
    dev = lambda p: _first_right(training.rescored(stored.where("split = 'dev'"), ranker, p)).select("right_after").first()[0]
    params, _ = training.train(stored.where("split = 'train'"), ranker, ranker.start(1), dev, training.Candidates, epochs=1, batch=32)
    return _first_right(training.rescored(stored.where("split = 'test'"), ranker, params))


def _first_right(scored: DataFrame) -> DataFrame:
    pick = lambda s: F.max_by(F.struct("rank", "label"), F.struct(F.col(s), -F.col("rank"))).alias(s)
    per = scored.groupBy("sentence_id").agg(pick("score"), pick("new_score"))
    return per.agg(
        F.count("*").alias("sentences"), F.count_if("score.label").alias("right_before"), F.count_if("new_score.label").alias("right_after"),
        F.count_if(F.col("new_score.rank") != F.col("score.rank")).alias("moved"),
    )


def s31_training_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs, stopped and taken up again to four, against four at once: logged epochs and the greatest difference of weights."""
    from ..operators import runs

    rows = _rows(spark, sf_dir, "morph43")
    model, train, folder = training.Model(64, rank=4), rows.where("split = 'train'"), S.scratch(spark, "run")
    first = model.start(1)
    whole, _ = training.train(train, model, first, epochs=4)
    training.train(train, model, first, epochs=2, folder=folder)
    again, _ = training.train(train, model, first, epochs=4, folder=folder)
    gap = max(float(np.abs(whole[k] - again[k]).max()) for k in whole)
    log = runs.read_log(spark, f"{folder}/log").where("name = 'loss'").agg(F.count("*").alias("epochs"))
    return log.select("epochs", F.lit(round(gap, 9)).alias("difference"))


QUERIES = {
    f.__name__: f
    for f in (m05_fused_scoring, m06_hybrid_embeddings, m07_character_encoder, m08_materialized_vectors, m09_structured_training, m10_path_reranker, s31_training_resume)
}


def _fused_sql() -> str:
    from .ladder import _best

    weight = "((a.length + 0.5 * a.chunk) * (2.0 * b.length + b.chunk) * 2 + a.position * (b.position + b.chunk) * 2 + 1)::bigint"
    return _best(weight) + " select sentence_id, score / 2 as fused, score / 2 as two_pass from pp where rank = 0"


SQL: dict[str, str] = {
    "m05_fused_scoring": _fused_sql(),
    "m08_materialized_vectors": f"with {NODES} select count(distinct sentence_id) as sentences, count(distinct sentence_id) as same from n",
    "s31_training_resume": "select 4::bigint as epochs, 0.0::double as difference",
}
