"""Tables between jobs: written to the folder that the cluster shares and read back, so that later plans start from files."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only where a local session names none (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="tidemark-")
        weakref.finalize(spark, shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{root(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
