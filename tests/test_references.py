"""Orphan references against a brute-force version."""

import random
from datetime import datetime, timedelta

from pathloom.operators.references import direct_orphans, orphan_cascade, orphan_report

REFS = "child string, rec string, field string, parent string, ref string, at timestamp_ntz"
SPANS = "parent string, key string, added_at timestamp_ntz, removed_at timestamp_ntz"
IDS = "table string, parent string, key string, rec string"
T0 = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def brute(refs, spans):
    out = []
    for child, rec, field, parent, ref, at in refs:
        if ref is None:
            continue
        own = [(a, r) for p, k, a, r in spans if p == parent and k == ref]
        if any(at is None or (a is not None and a <= at and (r is None or r > at)) for a, r in own):
            continue
        ended = any(r is not None and at is not None and r <= at for _, r in own)
        out.append((child, rec, field, parent, ref, at, "missing" if not own else "deleted" if ended else "late"))
    return out


def test_direct_orphans_against_brute_force(spark):
    rng = random.Random(3)
    spans = []
    for k in range(20):
        for _ in range(rng.randint(0, 3)):
            a = rng.choice([None, *range(0, 40)]) if rng.random() < 0.1 else rng.randint(0, 40)
            r = None if rng.random() < 0.4 else (a or 0) + rng.randint(0, 20)
            spans.append(("p", f"k{k}", day(a), day(r)))
    spans += spans[:5]
    hot = [("c", f"h{i}", "f", "p", "k1", day(rng.randint(0, 60))) for i in range(200)]
    refs = [("c", f"r{i}", "f", "p", rng.choice([None, f"k{rng.randint(0, 22)}"]), day(rng.choice([None, *range(0, 60)]))) for i in range(300)] + hot
    refs += refs[:7]
    got = direct_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(spans, SPANS)).collect()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(refs, spans), key=key)


def test_cascade_reports_direct_and_inherited_once(spark, rows):
    spans = spark.createDataFrame([("root", "a", day(0), None), ("t1", "1", day(0), None), ("t1", "2", day(0), None), ("t2", "1", day(0), None)], SPANS)
    refs = spark.createDataFrame(
        [
            ("t1", "1", "f", "root", "a", day(1)),
            ("t1", "2", "f", "root", "gone", day(1)),
            ("t2", "1", "f", "t1", "2", day(1)),
            ("t2", "2", "f", "t1", "1", day(1)),
            ("t3", "1", "f", "t2", "1", day(1)),
            ("t3", "1", "g", "t2", "9", day(1)),
        ],
        REFS,
    )
    ids = spark.createDataFrame([("t1", "t1", "1", "1"), ("t1", "t1", "2", "2"), ("t2", "t2", "1", "1"), ("t2", "t2", "2", "2")], IDS)
    got = orphan_cascade(refs, spans, ids)
    assert rows(got, "child", "rec", "field", "kind", "depth") == [
        ("t1", "2", "f", "direct", 0), ("t2", "1", "f", "inherited", 1), ("t3", "1", "f", "inherited", 2), ("t3", "1", "g", "direct", 0),
    ]
    assert orphan_report(got).count() == 4


def test_a_cycle_of_records_ends(spark, rows):
    spans = spark.createDataFrame([("t", k, day(0), None) for k in "123"], SPANS)
    refs = spark.createDataFrame([("t", "1", "f", "t", "2", None), ("t", "2", "f", "t", "3", None), ("t", "3", "f", "t", "1", None), ("t", "3", "g", "t", "x", None)], REFS)
    ids = spark.createDataFrame([("t", "t", k, k) for k in "123"], IDS)
    assert rows(orphan_cascade(refs, spans, ids), "rec", "field", "kind") == [("1", "f", "inherited"), ("2", "f", "inherited"), ("3", "f", "inherited"), ("3", "g", "direct")]


def test_empty_tables(spark):
    refs, spans = spark.createDataFrame([], REFS), spark.createDataFrame([], SPANS)
    assert orphan_cascade(refs, spans, spark.createDataFrame([], IDS)).count() == 0
    one = spark.createDataFrame([("c", "1", "f", "p", "k", None), ("c", "2", "f", "p", None, None)], REFS)
    got = orphan_cascade(one, spans, spark.createDataFrame([], IDS)).collect()
    assert [(r["rec"], r["reason"], r["kind"]) for r in got] == [("1", "missing", "direct")]


def test_direct_and_inherited_references_of_one_field_are_told_apart_by_parent_and_time(spark, rows):
    spans = spark.createDataFrame([("a", "1", day(5), None), ("b", "1", day(0), None)], SPANS)
    refs = [("a", "1", "f", "root", "gone", day(9)), ("c", "1", "f", "a", "1", day(1)), ("c", "1", "f", "a", "1", day(9)), ("c", "1", "f", "b", "1", day(9)), ("c", "1", "f", "a", "1", day(9))]
    ids = spark.createDataFrame([("a", "a", "1", "1"), ("b", "b", "1", "1")], IDS)
    got = orphan_cascade(spark.createDataFrame(refs, REFS), spans, ids)
    assert rows(got.where("child = 'c'"), "parent", "at", "reason", "kind") == [("a", day(1), "late", "direct"), ("a", day(9), "parent", "inherited")]


def test_found_references_of_dirty_diagnoses(spark, rows, tmp_path):
    from pathloom.plans.references import p4_found

    def save(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("gold_vocab", [("lemma", "rāma", day(0), None), ("lemma", "old", day(0), day(3)), ("lemma", "new", day(9), None), ("cng", "7", day(0), None), ("cng", "x", day(0), None), (None, "rāma", day(0), None), ("lemma", None, day(0), None)], "kind string, token string, added_at timestamp_ntz, removed_at timestamp_ntz")
    diagnoses = [
        (1, "s", " rāma ", "07", ["7.0", None, " ", "8"], day(5), 1), (1, "s", " rāma ", "07", ["7.0", None, " ", "8"], day(5), 2),
        (2, None, "rāma", None, None, day(5), 1), (3, "t", "old", "", [], day(5), 1), (4, "t", "new", "9", ["9", "9"], day(5), 1), (5, "t", None, "abc", ["7"], None, 1),
        (6, "t", "lost", "8", ["8"], None, 1), (None, "t", "lost", "8", ["8"], day(5), 1),
    ]
    save("gold_diagnosis", diagnoses, "diag_id long, sent_id string, lemma string, expected_cng string, available_cngs array<string>, diagnosed_at timestamp_ntz, ref int")
    save("sentences", [(1, "s", day(0))], "sentence_id long, stem string, loaded_at timestamp_ntz")
    save("splits", [], "sentence_id long, splits string, assigned_at timestamp_ntz")
    assert rows(p4_found(spark, str(tmp_path))) == [
        (1, "available_cngs", "8", "missing"), (3, "lemma", "old", "deleted"), (4, "available_cngs", "9", "missing"), (4, "expected_cng", "9", "missing"),
        (4, "lemma", "new", "late"), (6, "available_cngs", "8", "missing"), (6, "expected_cng", "8", "missing"), (6, "lemma", "lost", "missing"),
    ]
