"""The segment-tree encoder against the public library, and the packing's invariants."""

import base64
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import bpe, encode, packing

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.default_rank_file()), reason="no rank file")


@pytest.fixture(scope="module")
def public():
    with open(bpe.default_rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    return [np.frombuffer(b, dtype=np.int32).tolist() for b in bpe.encoder().encode_bytes(texts)]


HARD = [
    "", None, " ", "  ", "\n", "\r\n\r\n a", "a  b", "a \n b", "\ta\t\tb ", "it's we'll they've I'd 's'", "don't 'Ll", "x" * 5000, "ab" * 3000,
    "कैणूघेस्मै जकिसै । ८ ॥", "nīñcapaha ṭheṇu", "é é ​﻿", "\U0001f600\U0001f601", "<|endoftext|>", "a\0b \0", "1234567 12,5", "\xa0\xa0x",
]


def test_hard_texts_equal_the_public_encoding(public):
    assert ids(HARD) == [public.encode_ordinary(t or "") for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abst.,1लवṇé"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
def test_any_texts_equal_the_public_encoding(texts):
    with open(bpe.default_rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = _cached.setdefault("e", tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={}))
    assert ids(texts) == [enc.encode_ordinary(t) for t in texts]


_cached: dict = {}


def test_both_trees_agree_and_a_full_memory_changes_nothing(public):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeṇल") for _ in range(rng.randint(2, 40))) for _ in range(300)]
    enc = bpe.BytePairEncoder(cache_pieces=50)
    for word, got in enc.encode_pretokens(words).items():
        assert np.frombuffer(got, np.int32).tolist() == enc.encode_long(word.encode()).tolist() == public.encode_ordinary(word)
    text = " ".join(words)
    assert np.frombuffer(enc.encode_bytes([text])[0], np.int32).tolist() == public.encode_ordinary(text)


def test_operator_rows(spark, public):
    data = [(i, t, 7) for i, t in enumerate(HARD)] + [(0, "", 8)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode.encode_texts(df).collect())
    assert got == sorted((i, public.encode_ordinary(t or "")) for i, t, _ in data)
    counts = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df.where("doc_id > 0")).collect()}
    assert all(counts[i] == len(public.encode_ordinary(t or "")) for i, t, _ in data if i)
    assert encode.encode_texts(df.where("false")).count() == 0


def test_open_bins_take_the_tightest_fit():
    bins = packing.OpenBins(10, 3)
    assert bins.put(6, ["a"]) == [] and bins.put(5, ["b"]) == []
    assert bins.put(4, ["c"]) == [(10, ["a", "c"])]
    assert bins.put(7, ["d"]) == [] and bins.put(8, ["e"]) == []
    # three are open: the fullest closes for a new one
    assert bins.put(9, ["f"]) == [(8, ["e"])]
    assert sorted(u for u, _ in bins.rest()) == [5, 7, 9]


@pytest.mark.parametrize(("open_bins", "part_bins"), [(2, 100), (64, 200), (1, 10_000)])
def test_packing_places_every_token_once(spark, open_bins, part_bins):
    rng = random.Random(open_bins)
    sizes = [(i, rng.choice([0, None, 1, 10, 50, 100, 101, 250, 1000, rng.randint(1, 99)])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("part", F.lit(5))
    rows = packing.pack(df, capacity=100, open_bins=open_bins, part_bins=part_bins).collect()
    used, pieces = {}, {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["part"], r["start"], r["n_tokens"]))
    assert max(used.values()) <= 100
    for doc, n in sizes:
        if not n or n < 1:
            assert doc not in pieces
            continue
        own = sorted(pieces[doc])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(k for *_, k in own) == n
        assert all(start == p * 100 for p, start, _ in own)
        assert len(own) == 1 if n <= 100 else all(k == 100 for *_, k in own[:-1])
    again = packing.pack(df.repartition(5), capacity=100, open_bins=open_bins, part_bins=part_bins).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_leaves_little_room(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randint(1, 700)) for i in range(4000)], "doc_id long, n_tokens long")
    report = packing.fill_report(packing.pack(df, part_bins=170)).first()
    assert report["unused_share"] < 0.02 and report["containers"] >= report["least_containers"]


def test_empty_and_hot_sizes(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(none).count() == 0
    assert packing.fill_report(packing.pack(none)).first()["containers"] == 0
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1025).cast("long").alias("n_tokens"))
    assert packing.pack(same, part_bins=750).groupBy("container_id").count().count() == 3000


def test_ids_of_64_bits_keep_containers_apart(spark):
    ids = [1, 1 + 2**43, 1 - 2**62, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(i, 1500) for i in ids], "doc_id long, n_tokens long")
    rows = packing.pack(df).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids) and len({r["container_id"] for r in rows}) == len(ids)


def test_the_packing_does_not_depend_on_the_session(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.randint(1, 900)) for i in range(1500)], "doc_id long, n_tokens long")
    one = sorted(map(tuple, packing.pack(df, part_bins=64).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, packing.pack(df, part_bins=64).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
