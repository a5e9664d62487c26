"""What several claims ask for is found once a text."""

from pyspark.sql import functions as F

from tidemark.functions.text import extract_claims


def test_cues_are_counted_once_a_text(spark):
    df = spark.createDataFrame([("Strong, strong slowdown.",)], "t string").select(extract_claims(F.col("t")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("slowdown") == 1
