"""Rules of truncation that must not fade as the corpus grows."""

from pathloom.llm import truncation

SCHEMA = "doc_id long, text string, source string, genre string"


def reasons(spark, docs):
    return {r["doc_id"]: r["reason"] for r in truncation.truncated(spark.createDataFrame(docs, SCHEMA)).collect()}


def test_a_stray_fragment_does_not_make_it_a_word(spark):
    docs = [(i, "deva " * 100 + "x" * (i + 1) + " nara", "s", "g") for i in range(30)]
    docs += [(100, "a gi stands here once nara", "s", "g"), (101, "deva nara de", "s", "g"), (102, "nara ekadA de deva", "s", "g"), (103, "vana deva vana nara", "s", "g")]
    got = reasons(spark, docs)
    assert got.get(101) == "word" and not {100, 102, 103} & set(got)


def test_texts_with_a_shared_footer_are_different_texts(spark):
    footer = ". " + "the whole of this collection is kept in the old library " * 6 + "Rama"
    docs = [(i, f"{'word ' * (i + 1)}ends{footer}", "s", "g") for i in range(10)]
    docs += [(100 + i, f"{'word ' * (i + 1)}ends here.", "s", "g") for i in range(30)]
    assert reasons(spark, docs) == {}


def test_half_verses_are_found_in_small_genres_and_when_many(spark):
    small = [(i, "word " * (i + 1) + "||", "s", "small") for i in range(20)] + [(50, "half a verse |", "s", "small")]
    many = [(100 + i, "word " * (i + 1) + "||", "t", "many") for i in range(250)] + [(400 + i, "half " * (i + 1) + "|", "t", "many") for i in range(10)]
    mixed = [(500 + i, "word " * (i + 1) + ("||" if i % 2 else "|"), "u", "mixed") for i in range(40)]
    assert reasons(spark, small + many + mixed) == {50: "mark"} | {400 + i: "mark" for i in range(10)}


def test_a_source_may_have_two_limits(spark):
    filler = "deva nara vana giri "
    docs = [(i, (f"t{i} " + filler * 40)[: 300 + 7 * i], "s", "g") for i in range(30)]
    docs += [(200 + i, (f"v{i:03} " + filler * 40)[:400], "s", "g") for i in range(12)]
    docs += [(300 + i, (f"w{i:03} " + filler * 40)[:600], "s", "g") for i in range(25)]
    got = reasons(spark, docs)
    assert {d for d, reason in got.items() if reason == "limit"} >= {*range(200, 212), *range(300, 325)}
    assert all(d >= 200 for d in got if got[d] == "limit")


def test_beginnings_of_any_length_against_brute_force(spark):
    import random

    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(n)): rng.randint(1, 9) for n in (*range(1, 9), 15, 16, 17, 31, 32, 33, 63, 64, 65, 300, 300)}
    words |= {w + "a": 7 for w in list(words)[-6:]} | {"": 3}
    keys = {w[:n] for w in words for n in (1, 2, 5, 15, 16, 17, 20, 31, 32, 33, 63, 64, 65, 200)} | {"zz", ""}
    got = truncation._beginnings(spark.createDataFrame(list(words.items()), "word string, n long"), spark.createDataFrame([(k,) for k in keys], "key string"))
    want = {k: max(n for w, n in words.items() if w != k and w.startswith(k)) for k in keys if k and any(w != k and w.startswith(k) for w in words)}
    assert {r["key"]: r["longer"] for r in got.collect()} == want
