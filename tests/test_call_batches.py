"""Calls to a service: keys as they are, small batches."""

from tidemark.operators.claims import BATCH_ROWS, called


def test_calls_keep_keys_and_take_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    keys = [None, 2**53 + 1, *range(2500)]
    docs = spark.createDataFrame([(k, f"t{k}") for k in keys], "id long, text string").coalesce(1)
    got = called(docs, lambda t: {"answer": t}, "id", in_flight=3).collect()
    assert [r.id for r in got] == keys and [r.answer for r in got] == [f"t{k}" for k in keys]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
