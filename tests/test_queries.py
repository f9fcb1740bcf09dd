"""Every registered query of the core against its SQL on the smallest test data."""

import math
import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value + 0.0:.9g}"
    return f"{value:.9g}" if type(value).__name__ == "Decimal" else value


def test_core_queries_equal_their_sql(spark):
    import duckdb

    from pathloom import plans

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    wrong = []
    sql = plans.oracle_sql()
    for name, run in plans.queries().items():
        df = run(spark, SF)
        cols = sorted(df.columns)
        mine = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=key)
        if name not in sql:
            continue
        rel = db.execute(sql[name])
        theirs = [d[0] for d in rel.description]
        if sorted(theirs) != cols:
            wrong.append((name, cols, theirs))
            continue
        want = sorted([tuple(plain(r[theirs.index(c)]) for c in cols) for r in rel.fetchall()], key=key)
        if mine != want:
            wrong.append((name, len(mine), len(want), [(a, b) for a, b in zip(mine, want, strict=False) if a != b][:1]))
    assert not wrong


def test_entry_without_the_training_data_package(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["sentence_id", "rank", "score", "path"]
    assert {"p4_found", "g09_kbest"} <= set(entry.queries())
