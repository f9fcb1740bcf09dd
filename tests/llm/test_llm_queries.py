"""The registered queries run, with the columns they must have, and equal their SQL where there is one."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
COLUMNS = {
    "p1_found": [("sentence_id_a", "bigint"), ("sentence_id_b", "bigint")],
    "p2_found": [("kind", "string"), ("id", "int"), ("mark", "string")],
    "p3_found": [("src", "string"), ("rec_id", "bigint"), ("lemma_id", "int")],
    "p5_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint")],
}


def test_queries(spark):
    import duckdb

    from pathloom.llm import queries as q

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    for name, run in q.queries().items():
        df = run(spark, SF)
        if name in COLUMNS:
            assert df.dtypes == COLUMNS[name], name
        got = df.collect()
        if name.endswith("_found"):
            assert len(got) == len(set(map(str, got))), name
        if name in q.oracle_sql():
            rel = db.execute(q.oracle_sql()[name])
            names = [d[0] for d in rel.description]
            want = [tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall()]
            key = lambda r: tuple((x is not None, str(x)) for x in r)
            assert sorted(map(tuple, got), key=key) == sorted(want, key=key), name
    assert df.sparkSession.read.parquet(f"{SF}/documents.parquet").count() == q.p5_ids(spark, SF).count()
