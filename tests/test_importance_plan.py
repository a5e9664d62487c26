"""Permutation importance hands no table to the driver, and scores each trial once."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import ml


def test_trials_meet_rows_by_an_exchange(spark, monkeypatch):
    seen, plain = {}, ml.written
    monkeypatch.setattr(ml, "written", lambda df, name: seen.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or plain(df, name))
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(i), float(i * 37 % 101 > 50), float(i * 37 % 101), float(i * 53 % 7)) for i in range(120)]
    got = ml.permutation_importance(spark.createDataFrame(rows, "id long, date date, y double, a double, b double").withColumn("y", F.col("y").cast("int")), ["a", "b"], repeats=1, rounds=2).collect()
    assert [r.feature for r in got] == ["a", "b"]
    assert "rightHint=(strategy=merge)" in seen["trials"]
