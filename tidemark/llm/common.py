"""Plumbing shared by the training-data operators: shared scratch tables and column access."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import root


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: later plans start from files that survive lost executors."""
    spark = df.sparkSession
    path = f"{root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark drops the shuffle files of finished jobs when the driver collects its garbage; nothing reads them any more
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(name: str) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(col(name), F.lit("")).cast("binary")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that cross to a Python worker at a time; texts are long, so the default of the library would make large batches.
BATCH_ROWS = 1000
_KEPT: dict = {}


def keep(owner: str, key, make) -> dict:
    """What a worker keeps between the tasks of one operator; it is let go when another operator's task begins."""
    if _KEPT.get("of") != (owner, key):
        _KEPT.clear()
        _KEPT.update(of=(owner, key), state=make())
    return _KEPT["state"]


def let_go(owner: str) -> None:
    """Drops what a worker keeps for an operator other than owner. A function of this module, as what a nested one names is copied when Spark pickles it."""
    if _KEPT.get("of", ("",))[0] != owner:
        _KEPT.clear()


def tidy(run, owner: str = ""):
    """run for mapInArrow with batches of bounded rows, in a worker that gives back memory which earlier tasks have used."""
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark and not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))

    def tidied(batches):
        let_go(owner)
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
