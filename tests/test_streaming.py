from datetime import datetime, timedelta

from pathloom import streaming


def test_deliveries_and_windows(spark, rows, tmp_path):
    t0 = datetime(2024, 1, 1)
    data = [(i % 5, [1, i, None, -1], t0 + timedelta(days=i)) for i in range(10)] + [(None, [1], t0), (7, None, None)]
    spark.createDataFrame(data, "sentence_id long, node_form_id array<int>, loaded_at timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", streaming.first_deliveries(stream, late="60 days"), "append"), ("terms", streaming.term_windows(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.table("once"), "sentence_id") == [(0,), (1,), (2,), (3,), (4,)]
    counts = {r["term"]: r["n"] for r in spark.table("terms").groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert counts[1] == 12 and counts[9] == 1 and set(counts) == set(range(1, 10))
