"""Tables of whole steps: writes that fail, writers that meet, appends that repeat, and the extraction cache on them."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks, tables


def values(spark, path):
    return sorted(r[0] for r in tables.read(spark, path).select("id").collect())


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace(spark.range(3), path)
    broken = spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    for write in (tables.replace, tables.append):
        with pytest.raises(Exception, match="no"):
            write(broken, path)
        assert values(spark, path) == [0, 1, 2] and not glob.glob(f"{path}/_staged*")
    tables.replace(tables.read(spark, path).where("id > 0"), path)  # a table may be made of itself
    assert values(spark, path) == [1, 2]


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace(spark.range(1), path)
    seen = tables.steps(spark, path)[-1][0]
    tables.replace(spark.range(5), path, since=seen)
    with pytest.raises(tables.Conflict):
        tables.replace(spark.range(9), path, since=seen)
    assert values(spark, path) == [0, 1, 2, 3, 4]


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path, rows = str(tmp_path / "t"), [spark.range(k, k + 6) for k in range(4)]  # keys overlap
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda r: tables.append(r, path, "id"), rows))
    assert values(spark, path) == list(range(9)) and sum(added) == 9


def test_appends_old_steps_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read(spark, path, "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path)
    one = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "id long, v string")
    assert [tables.append(one, path, "id") for _ in range(2)] == [2, 0]
    assert tables.append(spark.createDataFrame([(2, "c", 5)], "id long, v string, more int"), path, "id") == 1
    assert sorted(map(str, tables.read(spark, path).collect())) == sorted(map(str, spark.createDataFrame([(None, "a", None), (1, "b", None), (2, "c", 5)], "id long, v string, more int").collect()))
    tables.compact(spark, path)
    assert [k for _, k in tables.steps(spark, path)] == ["whole"] and tables.read(spark, path).count() == 3
    for k in range(4):
        tables.replace(spark.range(k), path)
    assert len(glob.glob(f"{path}/n=*")) == 2


def test_cache_reads_only_the_wanted_folders_and_survives_broken_files(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "key string, v long, ok boolean"
    rows = spark.range(400).select(F.md5(F.col("id").cast("string")).alias("key"), F.col("id").alias("v"), (F.col("id") % 10 > 0).alias("ok"))
    assert sinks.cached_in(rows, path, schema).count() == 0 and sinks.missing_in(rows, path, schema).count() == 400
    assert [sinks.cache_results(rows, path), sinks.cache_results(rows, path)] == [360, 0]
    few = rows.where("v in (3, 4, 20)")
    got = sinks.cached_in(few, path, schema)
    assert sorted(r.v for r in got.collect()) == [3, 4] and [r.v for r in sinks.missing_in(few, path, schema).collect()] == [20]
    plan = got._jdf.queryExecution().executedPlan().toString()
    folders = {r[0] for r in few.select(F.concat(F.lit("s"), F.left("key", F.lit(2)))).collect()}
    assert "PartitionFilters: [shard" in plan and all(f in plan for f in folders)
    third = rows.where("v = 3").select(F.concat(F.lit("s"), F.left("key", F.lit(2)))).first()[0]
    for f in glob.glob(f"{path}/n=*/kind=part/shard={third}/*.parquet"):
        os.remove(os.path.join(os.path.dirname(f), "." + os.path.basename(f) + ".crc"))
        open(f, "wb").write(b"PAR1 broken")
    assert [r.v for r in sinks.cached_in(few, path, schema).collect()] == [4]
    assert sorted(r.v for r in sinks.missing_in(few, path, schema).collect()) == [3, 20]
