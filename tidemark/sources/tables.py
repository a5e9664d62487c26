"""Parquet tables that are replaced and appended to in whole steps: a step is a folder that appears by one rename, or not at all.

A table is a folder of numbered steps, `n=0000000007/kind=whole` or `n=0000000008/kind=part`. What it holds is its last whole step and the
parts after it. Rows are written aside and then claim the next number, so a write that fails leaves the table as it was, readers see a step
whole or not, and of two writers one gets the number and the other a Conflict. This needs a store whose rename does not replace (local disks,
HDFS). Readers of a step that a later write has removed must read anew; the last `keep` whole steps stay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has taken the step."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def steps(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, kind) of the steps that make up the table, oldest first: its last whole one and the parts after it."""
    fs, root = _path(spark, path)
    out = []
    for n in sorted(_numbers(fs, root), reverse=True):
        kind = next(s.getPath().getName() for s in fs.listStatus(_child(spark, root, f"n={n:010}"))).removeprefix("kind=")
        out.append((n, kind))
        if kind == "whole":
            break
    return out[::-1]


def _numbers(fs, root) -> list[int]:
    if not fs.exists(root):
        return []
    return [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("n=")]


def _child(spark, root, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(root, name)


def _claim(spark: SparkSession, fs, staged, step) -> None:
    """Give the staged folder its number by a rename that fails if the number is taken."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        if step.toUri().getScheme() == "file":  # the file system's own rename refuses a folder that holds something
            how = gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            how[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            jvm.java.nio.file.Files.move(jvm.java.nio.file.Paths.get(staged.toUri()), jvm.java.nio.file.Paths.get(step.toUri()), how)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(step.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(staged, step, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if fs.exists(step):
            raise Conflict(f"{step} is another writer's") from e
        raise


def _step(rows: DataFrame, path: str, kind: str, last: int, by: list[str] | None) -> str:
    """Write rows as step last + 1; returns where."""
    spark = rows.sparkSession
    fs, root = _path(spark, path)
    staged, step = _child(spark, root, f"_staged-{uuid.uuid4().hex}"), _child(spark, root, f"n={last + 1:010}")
    try:
        w = rows.write
        (w.partitionBy(*by) if by else w).parquet(f"{staged}/kind={kind}")
        _claim(spark, fs, staged, step)
    finally:
        fs.delete(staged, True)
    return f"{step}/kind={kind}"


def replace(rows: DataFrame, path: str, by: list[str] | None = None, keep: int = 2, since: int | None = None) -> None:
    """Make rows, in folders of the columns `by`, the table at path. rows may read the table: give the number of its last step then (since). Raises
    Conflict if another writer has changed it since (by default, since this call began), and leaves it as it was if the write fails."""
    spark = rows.sparkSession
    fs, root = _path(spark, path)
    there = sorted(_numbers(fs, root))
    last = max(there, default=0) if since is None else since
    _step(rows, path, "whole", last, by)
    wholes = [n for n in [*there, last + 1] if n == last + 1 or fs.exists(_child(spark, root, f"n={n:010}/kind=whole"))]
    for n in there:
        if len(wholes) >= keep and n < wholes[-keep]:
            fs.delete(_child(spark, root, f"n={n:010}"), True)


def read(spark: SparkSession, path: str, schema=None, lenient: bool = False) -> DataFrame:
    """The table at path; with a schema, also one that has no step yet is read, as empty. lenient: broken files are passed over."""
    found = steps(spark, path)
    if not found and schema is not None:
        return spark.createDataFrame([], schema)
    if not found:
        raise FileNotFoundError(f"{path} is no table")
    _, root = _path(spark, path)
    reader = spark.read.option("basePath", str(root.toString())).option("mergeSchema", schema is None).option("ignoreCorruptFiles", lenient)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.parquet(*[f"{root.toString()}/n={n:010}/kind={kind}" for n, kind in found]).drop("n", "kind")


def append(rows: DataFrame, path: str, key: str | None = None, by: list[str] | None = None) -> int:
    """Add rows, with a key those whose key the table lacks (one row of each; a null key is a key), and return how many. Safe to repeat:
    if another writer adds meanwhile, the keys are looked up again."""
    spark = rows.sparkSession
    fs, root = _path(spark, path)
    while True:
        last = max(_numbers(fs, root), default=0)
        new = rows
        if key:
            there = read(spark, path).select(F.col(f"`{key}`").alias("\0there")) if last else None
            new = rows if there is None else rows.join(there, F.col(f"`{key}`").eqNullSafe(F.col("\0there")), "left_anti")
            new = new.dropDuplicates([key])
        if new.isEmpty():
            return 0
        try:
            return spark.read.parquet(_step(new, path, "part", last, by)).count()
        except Conflict:
            rows = new  # those that the table had are out already


def compact(spark: SparkSession, path: str, by: list[str] | None = None, files: int | None = None) -> None:
    """Put the table's steps into one, as `files` files (or a file for each folder of `by`)."""
    last = steps(spark, path)[-1][0]
    rows = read(spark, path)
    replace(rows.repartition(*by) if by else rows.coalesce(files or 1), path, by, since=last)
