"""Writers: replaced tables, CSV, claims of successful extractions, append-once JSON lines, the extraction cache. Tables are those of
tidemark.sources.tables, whose readers see a whole table or none; a CSV and JSON lines become visible by Spark's own commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.extraction import failure_reasons, run_stats
from tidemark.sources import tables
from tidemark.sources.tables import read as read_table  # noqa: F401  what write_table has written


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace the table at path, in folders of the columns `by`; the old one stays if the write fails."""
    tables.replace(rows, path, by)


def write_csv(rows: DataFrame, path: str) -> None:
    """Replace the CSV at path: a header, nulls and NaN empty. For tables of results, so one file."""
    cells = [F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in rows.dtypes]
    rows.select(*cells).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def successful_claims(results: DataFrame, keep: tuple[str, ...] = ("accession", "ticker")) -> DataFrame:
    """One row with the claims' fields for each result that is ok and has claims."""
    return results.where("ok and claims is not null").select(*keep, "claims.*")


def write_extractions(results: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Replace the claims table at path; returns the run's statistics and its failure reasons."""
    write_table(successful_claims(results), path)
    return run_stats(results), failure_reasons(results)


def append_jsonl(rows: DataFrame, path: str, key: str) -> int:
    """Append to the JSON lines at path the rows whose key they lack; returns how many. Safe to repeat, not for two writers at a time
    (tables.append is)."""
    spark = rows.sparkSession
    try:
        there = spark.read.schema(rows.select(key).schema).json(path).select(key)
    except Exception as e:  # the first write makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = spark.createDataFrame([], rows.select(key).schema)
    new = rows.join(there, key, "left_anti").dropDuplicates([key])
    n = new.count()
    if n:
        new.write.mode("append").option("ignoreNullFields", False).json(path)
    return n


def _shard(key: str = "key"):
    return F.concat(F.lit("s"), F.left(key, F.lit(2)))


def cache_results(results: DataFrame, path: str) -> int:
    """Add results whose key the extraction cache at path lacks, in folders by the key's first two digits, a file each. Failures are never
    cached. Returns how many were added."""
    return tables.append(results.where("ok").withColumn("shard", _shard()).repartition("shard"), path, "key", ["shard"])


def cached_in(docs: DataFrame, path: str, schema) -> DataFrame:
    """The cache's rows (of the given schema) for the keys of docs: only the folders of those keys are read (256 names at most are asked
    for), and a broken file counts as not there."""
    spark: SparkSession = docs.sparkSession
    wanted = [r.shard for r in docs.select(_shard().alias("shard")).distinct().collect()]
    names = [n for n in spark.createDataFrame([], schema).columns if n != "shard"]
    there = tables.read(spark, path, spark.createDataFrame([], schema).withColumn("shard", F.lit("")).schema, lenient=True)
    return there.where(F.col("shard").isin(wanted)).select(*names).join(docs.select("key").distinct(), "key", "left_semi")


def missing_in(docs: DataFrame, path: str, schema) -> DataFrame:
    """The rows of docs whose key the cache lacks."""
    return docs.join(cached_in(docs, path, schema).select("key"), "key", "left_anti")
