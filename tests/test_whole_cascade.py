"""The cascade over the tables counts every orphaned node."""

from datetime import datetime

from pathloom.plans.references import p4_cascade

T0 = datetime(2024, 1, 5)


def test_every_node_of_an_orphaned_sentence_counts(spark, tmp_path, rows):
    def save(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("gold_vocab", [], "kind string, token string, added_at timestamp_ntz, removed_at timestamp_ntz")
    save("gold_diagnosis", [], "diag_id long, sent_id string, lemma string, expected_cng string, available_cngs array<string>, diagnosed_at timestamp_ntz")
    later = datetime(2024, 3, 5)
    save("sentences", [(1, "a", T0), (1, "a", later), (2, "b", later), (3, "c", T0), (4, "d", None)], "sentence_id long, stem string, loaded_at timestamp_ntz")
    save("splits", [(3, "train", later)], "sentence_id long, splits string, assigned_at timestamp_ntz")
    nodes = [(1, 0), (1, 1), (1, 1), (1, 2), (1, None), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (9, 0), (9, 1)]
    save("nodes", nodes, "sentence_id long, node_id int")
    assert rows(p4_cascade(spark, str(tmp_path)), "table", "month", "kind", "reason", "refs", "records") == [
        ("nodes", None, "direct", "missing", 2, 2),
        ("nodes", None, "inherited", "parent", 1, 1),
        ("nodes", "2024-01", "inherited", "parent", 3, 3),
        ("nodes", "2024-03", "inherited", "parent", 2, 2),
        ("sentences", None, "direct", "missing", 1, 1),
        ("sentences", "2024-01", "direct", "missing", 1, 1),
        ("sentences", "2024-03", "direct", "missing", 1, 1),
    ]
