"""Scalar functions, features, maps, alignment, surface and sources on small fixtures."""

import itertools
import json
import zlib

import numpy as np
import plain_alignment
import pytest
from pyspark.sql import functions as F

from pathloom.functions import features as X
from pathloom.functions import lemmas, tokens, translit
from pathloom.operators import align, maps, metrics, models, stats, surface
from pathloom.sources import graphml
from pathloom.sources import tables as S


def test_transliteration_round_trip_and_normal_forms():
    slp = "kfzRaH SAstrANi jYAna vEdya gOrI bfhat kxpta"
    assert translit.iast_to_slp1(translit.slp1_to_iast(slp)) == slp
    import unicodedata

    iast = "kṛṣṇaḥ śāstrāṅi jñāna"
    assert translit.slp1_letters(iast) == translit.slp1_letters(unicodedata.normalize("NFD", iast)) == translit.slp1_letters(iast.upper())
    assert translit.slp1_letters("kfzRaH, SAstrA'Ni | jYAna 12") == translit.slp1_letters(iast)
    assert translit.slp1_letters(None) == translit.slp1_letters(" 12 ?") == ""
    assert translit.hk_to_slp1("kRSNaH zAstra") == "kfzRaH SAstra"


def test_md5_split_is_the_public_definition(spark):
    import hashlib

    got = {r["id"]: r["b"] for r in spark.range(300).select("id", X.md5_bucket(F.col("id")).alias("b")).collect()}
    assert all(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 100 == b for i, b in got.items())


def test_ngram_buckets_are_crc32(spark):
    words = ["", "a", "kfzRa", "aaaaaa", None, "x" * 3000]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.ngram_features(F.col("w"), 16).alias("x"))
    for r in df.collect():
        w = r["w"] or ""
        grams = [w[i : i + n] for n in (2, 3) for i in range(max(len(w) - n + 1, 0))]
        want = np.bincount([zlib.crc32(g.encode()) % 16 for g in grams], minlength=16) / max(len(grams), 1)
        assert np.allclose(r["x"], want)


def test_lemma_candidates_hold_base_and_aliases(spark):
    df = spark.createDataFrame([("mahā",), (None,), ("saṃjaya",), ("bhāvay",)], "w string")
    got = {r["w"]: r for r in df.select("w", lemmas.lemma_candidates(F.col("w")).alias("c"), lemmas.lemma_candidates(F.col("w"), True).alias("x"), lemmas.lemma_code_candidates(F.col("w"), F.lit("2")).alias("p")).collect()}
    assert {"mahA", "mahant"} <= set(got["mahā"]["c"]) and ("mahant", "3") in [tuple(p) for p in got["mahā"]["p"]]
    assert got[None]["c"] == [""]
    assert "saYjaya" in got["saṃjaya"]["x"] and "saYjaya" not in got["saṃjaya"]["c"]
    assert {"BAvay", "BAv", "BA"} <= set(got["bhāvay"]["c"])


def test_tag_bits_and_roles(spark):
    df = spark.createDataFrame([("nom. sg. m.",), ("impft. [2] ac. du. 1",), ("pp. nom. sg. n.",), ("UNKNOWN",), (None,)], "t string")
    got = [(r["t"], r["x"], r["fin"], r["part"], r["c"]) for r in df.select("t", X.tag_bits(F.col("t")).alias("x"), *[tokens.roles(F.col("t"))[k].alias(n) for k, n in (("is_finite", "fin"), ("is_participle", "part"), ("case_name", "c"))]).collect()]
    assert all(len(x) == 43 for _, x, *_ in got)
    assert [sum(x) for _, x, *_ in got] == [3, 4, 4, 1, 0]
    assert [(f, p, c) for _, _, f, p, c in got] == [(False, False, "nom"), (True, False, ""), (False, True, "nom"), (False, False, ""), (False, False, "")]


def test_analysed_tokens(spark):
    df = spark.createDataFrame([("cikṣepa_kṣip_Tense=Past|Mood=Ind atha_atha_ saubha-_saubha_Case=Cpd tathā_tathā__ plain _x_Case=Nom",), ("",)], "t string")
    first, empty = df.select(*[c.alias(n) for n, c in tokens.parse_analysed(F.col("t")).items()]).collect()
    assert first["words"] == ["cikṣepa", "atha", "saubha", "tathā", "plain"]
    assert first["lemmas"] == ["kṣip", "atha", "saubha", "tathā", "", "x"]
    assert first["tags"] == ["Tense=Past|Mood=Ind", "", "Case=Cpd", "", "", "Case=Nom"]
    assert empty["words"] == empty["lemmas"] == []


def test_featurizers_have_their_width_and_zero_boundaries(spark):
    nodes = spark.createDataFrame([(1, 0, -1, -1, 0, 0, 0, 0, -1, 9), (1, 1, 1, 0, 4, 1, 1, 2, 0, 9), (1, 2, 1, 5, 4, 2, 7, 99, 5, 9)], "sentence_id long, node_id int, chunk int, position int, length int, form_id int, lemma_id int, tag_id int, char_start int, text_length int")
    vocab = spark.createDataFrame([("form", 1, "rAma"), ("form", 2, None), ("tag", 2, "nom. sg. m.")], "kind string, id int, token string")
    fitted = X.fit(nodes, spark.createDataFrame([(1,)], "sentence_id long"))
    for name, width in (("morph43", 64), ("scalars64", 64), ("ngrams80", 80), ("ngrams96", 96), ("ngrams128", 128)):
        got = {r["node_id"]: r["x"] for r in X.featurize(name, nodes, vocab, fitted).collect()}
        assert {len(x) for x in got.values()} == {width} and not any(got[0]) and any(got[1])
    with pytest.raises(KeyError):
        X.featurize("ngram_split", nodes, vocab, fitted)


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"))
    got = X.global_rank(df, [F.desc("v")], "place").collect()
    assert sorted((r["place"], r["v"]) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert X.global_rank(df.where("v < 0"), [F.asc("v")], "place").count() == 0


def test_dominant_purity_and_backoff(spark, rows):
    pairs = spark.createDataFrame([("a", "b")] * 9 + [("a", "c")] + [("x", "x")] * 5 + [("y", "z")] * 2 + [(None, "q")] * 9, "k string, v string")
    assert rows(maps.dominant(pairs, ["k"], ["v"])) == [("a", "b", 9, 10)]
    assert rows(maps.dominant(pairs, ["k"], ["v"], drop_identity=False), "k", "v") == [("a", "b"), ("x", "x")]
    p = maps.purity(pairs, "k", "v", 5).first()
    assert (p["keys"], p["tokens"], p["low_support_keys"], p["passes"]) == (3, 17, 1, True) and p["solid_purity"] == pytest.approx(14 / 15, abs=1e-6)
    data = spark.createDataFrame([("l", "1"), ("l", "2"), ("m", "1"), (None, None)], "lemma string, tag string")
    rules = spark.createDataFrame([("l", "1", "L", "9")], "lemma string, tag string, to_lemma string, to_tag string")
    single = spark.createDataFrame([("l", "ll")], "lemma string, to string")
    assert rows(maps.apply_with_backoff(data, rules, single), "new_lemma", "new_tag", "rule") == [(None, None, "none"), ("L", "9", "pair"), ("ll", "2", "lemma"), ("m", "1", "none")]
    assert rows(maps.with_sentinel(data.select("tag").distinct(), spark.createDataFrame([("1", 5)], "tag string, c int"), "tag", "c"), "c") == [("5",), ("<unmapped:2>",), ("<unmapped:>",)]


def resolve_many(sentences):
    """(pass, path, redirected, widened) of each (exact, variant, nodes, edges) by the array program."""
    rows, names = [], {}
    for s, (exact, variant, nodes, edges) in enumerate(sentences):
        rows += [(s, align.NODE, n, 0, names.setdefault(k, len(names))) for n, k in nodes.items()]
        rows += [(s, align.EDGE, u, v, 0) for u, v in edges]
        rows += [(s, align.PLACE, i, 0, 0) for i in range(len(variant))]
        rows += [(s, align.CANDIDATE, i, n, int(sure)) for side, sure in ((exact, True), (variant, False)) for i, here in enumerate(side) for n in here]
    by, redirected, widened, size, path = align.Annotations(len(sentences), *np.array(rows).T).resolve()
    ends = np.cumsum(size)
    return [([*align.PASSES, "none"][b], path[e - n : e].tolist(), int(r), int(w)) for b, e, n, r, w in zip(by, ends, size, redirected, widened, strict=True)]


def resolve_one(*sentence):
    return resolve_many([sentence])[0]


def test_the_array_program_resolves_as_the_plain_one():
    rng = np.random.default_rng(2)
    sentences = []
    for _ in range(600):
        n = int(rng.integers(1, 9))
        nodes = {i: (int(rng.integers(0, 2)), "ab"[int(rng.integers(0, 2))]) for i in range(n)}
        edges = [(u, v) for u, v in itertools.combinations(range(n), 2) if rng.random() < 0.35]
        places = [sorted({int(x) for x in rng.integers(0, n, rng.integers(0, 4))}) for _ in range(int(rng.integers(1, 5)))]
        exact = [[x for x in p if rng.random() < 0.6] for p in places]
        sentences.append((exact, places, nodes, edges))
    got = resolve_many(sentences)
    assert got == [plain_alignment.resolve_one(*s) for s in sentences]
    assert {g[0] for g in got} == {"exact", "variant", "widened", "none"} and got[5:8] == [resolve_one(*s) for s in sentences[5:8]]


def test_resolution_passes_against_search():
    nodes = {0: (1, "a"), 1: (1, "b"), 2: (1, "c"), 3: (1, "b")}
    edges = [(0, 1), (1, 2)]
    assert resolve_one([[0], [1], [2]], [[0], [1], [2]], nodes, edges)[:2] == ("exact", [0, 1, 2])
    assert resolve_one([[0], [], [2]], [[0], [1], [2]], nodes, edges)[:2] == ("variant", [0, 1, 2])
    assert resolve_one([[0], [3], [2]], [[0], [3], [2]], nodes, edges) == ("variant", [0, 1, 2], 1, 0)
    assert resolve_one([[0], [9], [2]], [[0], [], [2]], nodes, edges)[0] == "none"
    # a dead end in the middle resolves only when its place is widened
    dead = {**nodes, 4: (1, "b")}
    assert resolve_one([[0], [4], [2]], [[0], [4], [2]], dead, [*edges, (0, 4)])[:2] == ("widened", [0, 1, 2])
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(2, 7))
        links = [(u, v) for u, v in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        places = [sorted({int(x) for x in rng.integers(0, n, rng.integers(1, 4))}) for _ in range(int(rng.integers(1, 4)))]
        out = {u: {v for a, v in links if a == u} for u, _ in links}
        sources, sinks = set(range(n)) - {v for _, v in links}, set(range(n)) - {u for u, _ in links}
        some = [p for p in itertools.product(*places) if p[0] in sources and p[-1] in sinks and all(b in out.get(a, ()) for a, b in zip(p, p[1:], strict=False))]
        by, got, *_ = resolve_one(places, places, {i: (0, i) for i in range(n)}, links)
        got = got if by == "exact" else []
        assert (tuple(got) in some) if some else got == []


def test_resolve_over_tables(spark, rows):
    gold = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "sentence_id long, place int")
    cands = spark.createDataFrame([(1, 0, 5, True), (1, 1, 6, True), (1, 1, 6, True)], "sentence_id long, place int, node int, exact boolean")
    nodes = spark.createDataFrame([(1, 5, 1, 1), (1, 6, 1, 2)], "sentence_id long, node int, chunk int, surface int")
    edges = spark.createDataFrame([(1, 5, 6)], "sentence_id long, src int, dst int")
    assert rows(align.resolve(gold, cands, nodes, edges), "sentence_id", "resolved_by", "nodes") == [(1, "exact", (5, 6)), (2, "none", ())]


def test_surface_votes_and_holes(spark, rows):
    nodes = spark.createDataFrame([(1, 0, 1, 0, 4, "rAma"), (1, 1, 1, 0, 4, "rAmas"), (1, 2, 1, 5, 3, "go"), (1, 3, 2, 0, 2, None), (1, 4, 1, None, 2, "x")], "sentence_id long, node_id int, chunk int, position int, length int, word string")
    assert rows(surface.chunk_texts(nodes)) == [(1, 1, "rAma?go?"), (1, 2, "??")]
    assert rows(surface.chunk_starts(surface.chunk_texts(nodes))) == [(1, 1, 0), (1, 2, 9)]
    # of equal weights the first seen character holds
    tie = spark.createDataFrame([(1, 0, 1, 0, 1, "b"), (1, 1, 1, 0, 1, "a")], nodes.schema)
    assert rows(surface.chunk_texts(tie), "text") == [("b",)]


def test_metrics(spark, rows):
    gold = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [5])], "sentence_id long, nodes array<int>")
    pred = spark.createDataFrame([(1, [1, 2, 4, 4]), (2, [7])], "sentence_id long, nodes array<int>")
    m = metrics.micro(metrics.compared(gold, pred)).first()
    assert (m["sentences"], m["tp"], m["fp"], m["fn"]) == (2, 2, 1, 2)
    assert metrics.micro(metrics.compared(gold, pred, skip_empty=False)).first()["sentences"] == 3
    assert metrics.micro(metrics.compared(gold.where("false"), pred)).first()["f1"] == 0.0
    paths = spark.createDataFrame([(1, 0, 2.0, [1, 2]), (1, 1, 1.0, [1, 2, 3]), (3, 0, 1.0, [5])], "sentence_id long, rank int, score double, nodes array<int>")
    assert rows(metrics.recall_at(metrics.hit_ranks(gold, paths), [1, 2]), "k", "hits") == [(1, 1), (2, 2)]
    lab = metrics.labelled(gold, paths)
    assert rows(lab, "sentence_id", "rank", "label") == [(1, 0, False), (1, 1, True), (3, 0, True)]
    assert rows(metrics.pick(lab, F.lit(1)), "sentence_id", "rank") == [(1, 0), (3, 0)]
    multi = metrics.multiset(spark.createDataFrame([(1, "a"), (1, "a")], "sentence_id long, token string"), spark.createDataFrame([(1, "a"), (2, "b")], "sentence_id long, token string"))
    assert rows(multi) == [(1, 1, 0, 1, False), (2, 0, 1, 0, False)]


def test_histogram_and_first_seen(spark, rows):
    df = spark.createDataFrame([(0,), (5,), (10,), (99,), (None,)], "v int")
    assert rows(stats.histogram(df, F.col("v"), [0, 10, 20, 50]), "low", "n") == [(0, 2), (10, 1), (20, 1)]
    seen = spark.createDataFrame([(2, "b"), (1, "c"), (3, "b"), (4, "a"), (0, ""), (0, None)], "at int, t string")
    assert rows(stats.first_seen_vocabulary(seen, "t", ["at"])) == [("a", 3), ("b", 2), ("c", 1)]


def test_graphml_files_and_round_trip(spark, rows, tmp_path):
    doc = '<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="word"/><key id="d1" for="edge" attr.name="key"/><graph edgedefault="directed"><node id="n1"><data key="d0">a&amp;b</data></node><node id="2"/><edge source="n1" target="2"><data key="d1">1</data></edge></graph></graphml>'
    (tmp_path / "12.graphml").write_text(doc)
    (tmp_path / "13.graphml").write_text("<graphml><graph><node id=")
    docs = graphml.read_graphml(spark, str(tmp_path))
    assert rows(graphml.graph_nodes(docs, ["word", "lemma"])) == [("12", 1, "a&b", None), ("12", 2, None, None)]
    assert rows(graphml.graph_edges(docs)) == [("12", 1, 2, 1)]
    nodes = spark.createDataFrame([("s", 1, 'x<"y">', "l", None, "", "5", "1", "0", "3")], "stem string, node_id int, word string, lemma string, morph string, pre_verb string, cng string, chunk_no string, position string, length_word string")
    edges = spark.createDataFrame([("s", 1, 1, 2)], "stem string, src int, dst int, key int")
    back = graphml.parse_graphml(graphml.graphml_documents(nodes, edges))
    assert rows(graphml.graph_nodes(back), "stem", "node_id", "word", "morph", "length_word") == [("s", 1, 'x<"y">', None, "3")]
    assert rows(graphml.graph_edges(back)) == [("s", 1, 1, 2)]


def test_text_sources(spark, rows, tmp_path):
    (tmp_path / "b.tsv").write_text("﻿DCS-ID\tinput\n7\tx y\n", encoding="utf-8")
    assert rows(S.read_tsv(spark, str(tmp_path / "b.tsv"))) == [("7", "x y")]
    (tmp_path / "v.txt").write_text("0\t\n1\ta\tb\nbad\n2\n")
    assert rows(S.read_vocabulary(spark, str(tmp_path / "v.txt"), "form"), "id", "token") == [(0, ""), (1, "a\tb"), (2, "")]
    lines = [json.dumps({"id": "1", "mode": "m", "words": ["a"], "lemmas": ["b"], "tags": [], "raw": "a_b_"}), "{broken"]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    assert rows(S.read_predictions(spark, str(tmp_path / "p.jsonl")), "id", "words") == [("1", ("a",))]
    (tmp_path / "g.json").write_text(json.dumps({"sentence_id": "s", "lemmas": [["a", "b"], ["c"]], "cng": [["1"], ["2"]]}))
    a = S.read_annotations(spark, str(tmp_path / "g.json"))
    assert rows(a) == [("s", 1, 0, "a", "1"), ("s", 2, 0, "c", "2")]
    assert rows(S.flat_reference(a)) == [("s", ("a", "c"), ("1", "2"))]
    with pytest.raises(KeyError):
        S.require(a, spark.createDataFrame([], "x int").schema)


def test_weight_files(spark, tmp_path):
    path = str(tmp_path / "w.bin")
    S.write_weights(path, [[1.0, 2.0]], [[0.5, -1.0]], 0.25)
    assert S.read_weights(spark, path) == ([[1.0, 2.0]], [[0.5, -1.0]], 0.25)
    data = open(path, "rb").read()
    for bad in (b"", b"\0" * 32, data[:-1], data + b"\0"):
        with pytest.raises(ValueError):
            S.parse_weights(bad)


def test_nine_digits_as_c_writes_them(spark):
    values = [0.0, 1.0, -1471.0, 0.5, 1 / 3, 123456789.5, 1e9, 1.5e-5, 12345.678901, -2.5e-7, 1e20]
    got = [r["s"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(S.nine_digits(F.col("v")).alias("s")).collect()]
    assert got == ["%.9g" % v for v in values]


def test_training_learns_a_separable_tag(spark):
    rng = np.random.default_rng(4)
    nodes, edges, gold, vectors = [], [], [], []
    for s in range(40):
        ids, path = [[0]], []
        for level in range(1, 6):
            pair = [2 * level - 1, 2 * level]
            good = int(rng.integers(0, 2))
            path.append(pair[good])
            for j, n in enumerate(pair):
                vectors.append((s, n, [1.0 if j == good else 0.0, 1.0 if j != good else 0.0, float(rng.random())]))
            ids.append(pair)
        ids.append([11])
        vectors += [(s, 0, [0.0, 0.0, 0.0]), (s, 11, [0.0, 0.0, 0.0])]
        nodes += [(s, n) for level in ids for n in level]
        k = 0
        for a, b in zip(ids, ids[1:], strict=False):
            for u in a:
                for v in b:
                    edges.append((s, k, u, v))
                    k += 1
        gold.append((s, path))
    n = spark.createDataFrame(nodes, "sentence_id long, node_id int")
    e = spark.createDataFrame(edges, "sentence_id long, edge_id long, src int, dst int")
    g = spark.createDataFrame(gold, "sentence_id long, nodes array<int>")
    v = spark.createDataFrame(vectors, "sentence_id long, node_id int, x array<float>")
    weights, log = models.train_structured(n, e, g, v, 3, epochs=3)
    assert weights[0] > 0 > weights[1] and len(log) == 3


def test_reranker_gradient_and_learning(spark):
    scores, labels = np.array([0.3, -0.2, 0.9]), np.array([False, True, False])
    loss, grad = models.listwise(scores, labels)
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert (models.listwise(scores + step, labels)[0] - loss) / 1e-6 == pytest.approx(grad[i], abs=1e-4)
    rows = [(s, r, 1.0 - r, r == 1, [float(r == 1), 1.0]) for s in range(20) for r in range(3)]
    c = spark.createDataFrame(rows, "sentence_id long, rank int, score double, label boolean, x array<double>")
    weights, losses = models.train_reranker(c, 2, epochs=8)
    assert losses[-1] < losses[0] and weights[0] > 0
    best = models.rerank(c, weights).groupBy("sentence_id").agg(F.max_by("rank", "new_score").alias("r"))
    assert {r["r"] for r in best.collect()} == {1}


def test_lstm_is_independent_of_padding():
    p = models.lstm_parameters(3, 4, 1)
    x = np.random.default_rng(2).normal(size=(2, 6, 3))
    both = models.lstm(x, np.array([6, 4]), p, reverse=True)
    assert np.allclose(both[1, :4], models.lstm(x[1:, :4], np.array([4]), p, reverse=True)[0]) and not both[1, 4:].any()
