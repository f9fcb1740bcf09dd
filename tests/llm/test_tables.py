"""Term counts, canonical entries, cross-split overlaps and truncation on small fixtures."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.translit import slp1_letters, slp1_to_iast
from pathloom.llm import canonical, overlap, terms, truncation

LETTERS = "aAiukKgcjtdnpbmyrlvSzsh"


def test_last_seen_counters_against_sets():
    rng = np.random.default_rng(1)
    c, seen, occurrences = terms.LastSeenCounters(), {}, Counter()
    record = 0
    for _ in range(30):
        n = int(rng.integers(0, 50))
        records = record + np.cumsum(rng.integers(0, 2, n)) if n else np.zeros(0, dtype=np.int64)
        record = int(records[-1]) if n else record
        ids = rng.integers(1, 9, n)
        for t, r in zip(ids.tolist(), records.tolist(), strict=True):
            seen.setdefault(t, set()).add(r)
            occurrences[t] += 1
        c.add(ids, records)
    assert {int(t): (int(o), int(r)) for t, (o, r, _) in zip(c.terms, c.seen, strict=True)} == {t: (occurrences[t], len(s)) for t, s in seen.items()}


def test_term_frequencies(spark, rows, monkeypatch):
    schema = "sentence_id long, f array<int>, l array<int>, kind int"
    data = [(i, [1, 1, i % 7 + 2, None, 0, -1], None if i % 3 else [5], 0) for i in range(40)]
    data += data[:10] + [(100, None, None, 0), (101, [], [], 0), (None, [9], [9], 0)]
    df = spark.createDataFrame(data, schema)
    want = []
    distinct = {r[0]: r for r in data if r[0] is not None}
    for kind, at in (("form", 1), ("lemma", 2)):
        occ, rec = Counter(), Counter()
        for r in distinct.values():
            ids = [x for x in r[at] or [] if x is not None and x >= 1]
            occ.update(ids)
            rec.update(set(ids))
        for t in occ:
            want.append((kind, t, occ[t], rec[t], "rare" if rec[t] < 3 else "common" if rec[t] * 5 > len(distinct) else None))
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert rows(terms.term_frequencies(df, "sentence_id", {"form": "f", "lemma": "l"})) == sorted(want, key=key)
    assert terms.term_frequencies(df.where("false"), "sentence_id", {"form": "f"}).count() == 0


def test_bk_tree_returns_every_entry_within_the_threshold():
    rng = random.Random(2)
    entries = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9)))) for i in range(300)]
    long = ["".join(rng.choice(LETTERS) for _ in range(n)) for n in (62, 63, 64, 65, 90, 200)]
    entries += [(900, entries[0][1]), (901, "k" * 80), (902, ""), *((910 + i, w) for i, w in enumerate(long)), (920, long[5][:-1]), (921, long[3][1:])]
    tree = canonical.BKTree(entries)
    words = [w for _, w in rng.sample(entries, 80)] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 10))) for _ in range(200)] + ["k" * 79, "k" * 77]
    words += [w[:3] + "?" + w[4:] for w in long] + [w[1:] for w in long] + ["a" + w for w in long]
    least = {}
    for i, w in entries:
        least[w] = min(i, least.get(w, i))
    for most in (0, 1, 2, 3):
        want = [(n, i, d) for n, word in enumerate(words) for w, i in least.items() if w and word and abs(len(w) - len(word)) <= most and (d := canonical.edit_distance(word, w)) <= most]
        assert sorted(zip(*(x.tolist() for x in tree.within(words, most)), strict=True)) == sorted(want)
    assert [len(x) for x in canonical.BKTree([]).within(["a"], 2)] == [0, 0, 0]


def test_all_entries_near_a_value(spark, rows):
    reference = spark.createDataFrame([(1, "rAma"), (2, "rAmA"), (3, "vana"), (4, "rAma"), (None, "rama"), (6, ""), (7, None)], "lemma_id int, lemma string")
    df = spark.createDataFrame([("rAma",), ("rāmā",), ("vanam",), ("zzzzzz",), (None,), ("",), ("rAma",)], "value string").withColumn("w", F.lit(1)).withColumn("i", F.lit(1))
    for shard in (1, 100):
        assert rows(canonical.entries_within(df, reference, "lemma_id", "lemma", 1, shard)) == [("rAma", 0, 1), ("rAma", 1, 2), ("rāmā", 0, 2), ("rāmā", 1, 1), ("vanam", 1, 3)]
    assert canonical.entries_within(df, reference.where("false"), "lemma_id", "lemma").count() == 0
    assert canonical.entries_within(df.where("false"), reference, "lemma_id", "lemma").count() == 0


@pytest.mark.parametrize(
    "value",
    ["rAma", " rAma ", "\trAma\xa0", "√rAma", "*rAma", "-rAma", "rAma°", "2. rAma", "rAma_3", "rAma-2", "rAma (4)", "rAma2", "rAma [m.]", "rAma m.", "rAma, ind.", "rAma; to go",
     "rAma = to go", 'rAma "to go"', "rA-ma", "rA ma", "rāma", "rāma", "Rāma", "rAma: uncertEn"],
)
def test_what_stands_around_the_letters_is_set_aside(value):
    assert "rAma" in canonical.readings(value)


def test_nothing_readable():
    assert canonical.readings(None) == canonical.readings("") == canonical.readings(" ?? 12") == []


def test_nearest_entries_in_one_and_in_several_shards(spark, rows):
    rng = random.Random(3)
    words = ["".join(rng.choice(LETTERS) for _ in range(8)) for _ in range(60)]
    reference = spark.createDataFrame([*enumerate(words), (99, None)], "lemma_id int, lemma string").withColumn("value", F.lit("x"))
    values = [(w[:3] + w[4:],) for w in words] + [("zzzzzzzzzzzz",), (None,), ("",), (words[0],), (words[0],)]
    df = spark.createDataFrame(values, "value string")
    one = rows(canonical.nearest_entries(df, reference, "lemma_id", "lemma"))
    assert one == rows(canonical.nearest_entries(df, reference, "lemma_id", "lemma", shard_entries=9))
    found = {v: e for v, _, e in one}
    assert found[words[0]] == 0 and found[""] is None and found["zzzzzzzzzzzz"] is None and None not in found
    assert all(canonical.edit_distance(words[e], v) <= 2 for v, _, e in one if e is not None)
    assert {e for _, _, e in rows(canonical.nearest_entries(df, reference.where("false"), "lemma_id", "lemma"))} == {None}


def test_within_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        b = "".join(b)
        d = canonical.edit_distance(a, b)
        for limit in (0, 2, 5, 9):
            assert overlap.within(a, b, limit) == (d if d <= limit else None)


def near_copy(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice(LETTERS))
        elif out:
            i = min(i, len(out) - 1)
            out[i : i + 1] = [rng.choice(LETTERS)] if kind == 1 else []
    return "".join(out)


def overlap_tables(spark, seed=5, size=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 7))) for _ in range(40)]
    base = ["".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(size)]
    texts = base + [near_copy(rng, t, rng.randint(0, max(1, len(t) // 8))) for t in base] + ["", None, " 12 ", "a", "a", "k" * 6000, "k" * 5999]
    sentences, splits = [], []
    for i, t in enumerate(texts):
        shown = t if t is None or rng.random() < 0.5 else slp1_to_iast(t)
        if shown and slp1_letters(shown) != t:
            shown = t
        sentences += [(i, shown, f"s{i % 3}", 1)] * rng.choice([1, 1, 2])
        splits.append((i, rng.choice(["train", "Train ", "TRAIN", "dev", " Dev", "test\t", "other", None]), 5))
        if rng.random() < 0.2:
            splits.append((i, rng.choice(["train", "dev"]), 9))
    s = spark.createDataFrame(sentences, "sentence_id long, surface_text string, source string, letters int")
    p = spark.createDataFrame(splits, "sentence_id long, splits string, at int").selectExpr("sentence_id", "splits", "timestamp_seconds(at) as assigned_at", "1 as split")
    last = {}
    for i, name, at in splits:
        last[i] = max(last.get(i, (0, "")), (at, name or ""))
    role = {i: n.strip().lower() for i, (_, n) in last.items()}
    letters = {i: slp1_letters(t) for i, t, *_ in sentences}
    want = set()
    for i, a in letters.items():
        for j, b in letters.items():
            if a and b and role[i] in ("dev", "test") and role[j] == "train" and canonical_close(a, b):
                want.add((min(i, j), max(i, j)))
    return s, p, want


def canonical_close(a, b):
    limit = max(len(a), len(b)) // 10
    return abs(len(a) - len(b)) <= limit and (canonical.edit_distance(a, b) if len(a) < 500 else overlap.within(a, b, limit) or 0) <= limit


def test_overlap_pairs_against_brute_force(spark, rows):
    s, p, want = overlap_tables(spark)
    got = overlap.overlap_pairs(s, p).select(F.least("eval_id", "train_id").alias("a"), F.greatest("eval_id", "train_id").alias("b"), "coverage", "edits").collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want and len(want) > 20
    assert all(0 < r["coverage"] <= 1 for r in got)


def test_shards_and_blocks_change_nothing(spark):
    s, p, want = overlap_tables(spark, 6)
    texts = overlap.stored_texts(s, p)
    sizes = [(1_000_000, 16_000_000), (300, 500), (5000, 90)]
    got = [sorted(map(tuple, overlap.near_texts(texts, *x).selectExpr("hex(eval_text)", "hex(train_text)", "edits").collect())) for x in sizes]
    assert got[0] == got[1] == got[2] and got[0]


def test_overlap_reports_add_up(spark):
    s, p, want = overlap_tables(spark, 7)
    assert overlap.overlap_report(s, p).agg(F.sum("pairs")).first()[0] == len(want)
    assert overlap.overlap_pairs(s.where("false"), p).count() == 0
    assert overlap.overlap_pairs(s, p.where("false")).count() == 0


CUT = {
    "omission": ["rAma gacCati | sItA [...]", "rAma gacCati | sI…", "rAma gacCati | sI..."],
    "broken": ["rAma gacCati | sIt�", "rAma &am", "<text><l>rAma |</l><l"],
    "unclosed": ["He said (no.", 'where x joins "abc de', "<text><l>rAma |</l><l>sItA vanaM |"],
    "between": ["the margin is open,", "path 5-14-", "rAmaH:"],
}


@pytest.mark.parametrize(("state", "text"), [(s, t) for s, ts in CUT.items() for t in ts])
def test_states_of_cut_endings(state, text):
    got, *_, tags = truncation.ending(text)
    assert got == state or (state == "unclosed" and tags)


@pytest.mark.parametrize("text", ["rAma gacCati |", "He goes (a.)", "“tṛrti.”", "a || 12 ||", "<text><l>a |</l></text>", "can't he?", "[13].", 'He said "no".', "॥ ३६ ॥"])
def test_finished_endings(text):
    assert truncation.ending(text)[0] == "closed"


def test_stack_automaton():
    names = lambda t: [n for n, _ in truncation.unclosed(t)]
    assert names("") == names("a (b [c] d) “e” \"f\" <x>g</x> <br/>") == []
    assert names("(a [b") == [")", "]"] and names("(a [b)") == [] and names(") a ]") == [] and names('"a') == ['"']
    assert names("<a><b></a>") == [] and names("<a x='1'><b>") == ["</a>", "</b>"]


def corpus(spark):
    rng = random.Random(8)
    words = ["rAmaH", "vanaM", "gacCati", "paSyati", "devaH", "nfpatiH", "sItA", "mahArAjaH"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    rows, cut = [], set()

    def add(text, source, genre, is_cut):
        rows.append((len(rows), text, source, genre, 1))
        if is_cut:
            cut.add(len(rows) - 1)

    for i in range(200):
        add(f"{line(6)} | {line(5)} ||", "plain", "prose", False)
        add(f"{line(5)}\n{line(6)}", "bare", "prose", False)
        add(line(2), "plain", "heading", False)
        add("\n".join(f"{rng.choice(words)} = {rng.choice(['to go', 'torn leaf', 'river'])}" for _ in range(4)), "plain", "wordlist", False)
        if i % 5 == 0:
            add(f"{line(6)} |\n-- reader {i}", "plain", "prose", False)
            add(f"{line(4)} | {line(3)} gacC", "plain", "prose", True)
            add(f"{line(5)}\n{line(3)} mahArA", "bare", "prose", True)
            add(f"{rng.choice(words)} = to go\n{rng.choice(words)} = torn", "plain", "wordlist", True)
            add((line(30) + " " * 100)[:120] if i % 2 else line(30)[:120], "short", "prose", True)
        add(f"{line(4)} |", "short", "prose", False)
    for t in (None, "", "  \n "):
        add(t, "plain", "prose", False)
    return spark.createDataFrame(rows, "doc_id long, text string, source string, genre string, n int"), cut


def test_truncated_documents(spark, rows):
    df, cut = corpus(spark)
    got = {r["doc_id"]: r["reason"] for r in truncation.truncated(df).collect()}
    assert set(got) == cut, (sorted(cut - set(got))[:5], sorted(set(got) - cut)[:5])
    report = {r["source"]: (r["documents"], r["cut"]) for r in truncation.truncation_report(df).collect()}
    assert sum(n for n, _ in report.values()) == df.count() and sum(c for _, c in report.values()) == len(cut)


def test_truncation_of_an_empty_table_and_null_columns(spark):
    df, _ = corpus(spark)
    assert truncation.truncated(df.where("false")).count() == 0
    blank = df.where("doc_id < 40").withColumn("source", F.lit(None).cast("string")).withColumn("genre", F.lit(None).cast("string"))
    assert truncation.truncated(blank).count() >= 0


def test_very_long_and_odd_values_take_no_time():
    import time

    began = time.time()
    for value in ("x " + "mfn" * 20_000, " " * 50_000 + "rAma", "1" * 50_000 + "x", "(" * 20_000, "rAma" + " -" * 20_000, "<" + "a" * 200_000, "a" + "." * 50_000, "< " * 50_000):
        canonical.readings(value)
        truncation.ending("a = b\n" * 3 + value)
        truncation.ending(value)
        list(truncation.word_counts([value, "a = " + value]))
    assert time.time() - began < 20


def test_overlap_of_very_long_texts():
    rng = random.Random(11)
    a = "".join(rng.choices(LETTERS, k=30_000))
    b = near_copy(rng, a, 900)
    shard = overlap.PassageShard(["a", "c"], [a, "kKgG" * 20])
    assert [(e, t) for e, t, *_ in shard.scan(["b", "d"], [b, "zzz"])] == [("a", "b")]


def test_bands_of_near_lengths_are_neighbours(spark):
    lengths = [*range(1, 400), 999, 1000, 8999, 9000, 10_000]
    df = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", overlap.length_band(F.col("n")).alias("b"))
    band = {r["n"]: r["b"] for r in df.collect()}
    assert all(abs(band[a] - band[b]) <= 1 for a in lengths for b in lengths if abs(a - b) * 10 <= max(a, b))


def test_parts_are_bounded_by_letters():
    plan, n = overlap._parts({2: 700_000, 3: 1, 20: 90_000}, 1, 250_000)
    assert plan == {2: (3, 0), 3: (1, 3), 20: (1, 4)} and n == 5
    assert overlap._parts({}, 4, 10) == ({}, 0)


def test_a_text_of_many_sentences_is_expanded_in_blocks(spark):
    s = spark.createDataFrame([(i, "rAmo vanaM gacCati" if i < 90 else "rAmo vanaM gacCatI" if i < 95 else "sItA tatra", "s") for i in range(100)], "sentence_id long, surface_text string, source string")
    p = spark.createDataFrame([(i, "dev" if i % 3 == 0 else "train", 1) for i in range(100)], "sentence_id long, splits string, at int").selectExpr("sentence_id", "splits", "timestamp_seconds(at) as assigned_at")
    pairs = overlap.overlap_pairs(s, p, block=7).select("eval_id", "train_id").collect()
    near = [(e, t) for e in range(0, 100, 3) for t in range(100) if t % 3 and (e < 95) == (t < 95)]
    assert sorted(map(tuple, pairs)) == near
    classes = overlap.overlap_classes(overlap.stored_texts(s, p)).collect()
    assert sorted((r["edits"], r["eval_members"], r["train_members"]) for r in classes) == [(0, 2, 3), (0, 2, 3), (0, 30, 60), (1, 2, 60), (1, 30, 3)]
