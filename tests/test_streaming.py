from pyspark.sql import functions as F

from tabulon.streaming import events as E

DIR = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, name, make):
    batch = spark.read.parquet(f"{DIR}/events.parquet")
    batch.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return batch, spark.table(name)


def test_windows_as_in_batch(spark, tmp_path):
    make = lambda df: E.tumbling(df, "ts", ["event_type"], "6 hours", "value", late="40 days")
    batch, got = streamed(spark, tmp_path, "tumbling_out", make)
    want = {(r.window_start, r.event_type): r.n for r in make(batch).collect()}
    assert all(want[(r.window_start, r.event_type)] == r.n for r in got.collect())


def test_redelivered_rows_once(spark, tmp_path):
    batch, got = streamed(spark, tmp_path, "once_out", lambda df: E.once(df.union(df), "ts", ["event_id"], late="40 days"))
    assert got.count() == batch.count()


def test_ledger_batches_are_written_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "log"))
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "log"))
        E.ledger_updates(stream, str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).select(F.count("*")).first()[0] == 10
