"""Samples in the order of a hash of (seed, key), the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import placed


def draw(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def equal_strata(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows, as many of each stratum: ceil(n / strata), at least 1, then the first n of all."""
    strata = rows.agg(F.count_distinct(stratum).alias("k"))
    per = F.greatest(F.lit(1), F.ceil(F.lit(n) / F.col("k")))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, seed), key)))
    return ranked.join(F.broadcast(strata)).where(F.col("r") <= per).drop("r", "k").orderBy(draw(key, seed), key).limit(n)


def proportional_strata(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """max(1, round(size * n / N)) rows of each stratum, halves to even."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("all"))
    take = sizes.join(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(F.col("size") * n / F.col("all")).cast("int")).alias("take"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, seed), key)))
    return ranked.join(F.broadcast(take), stratum).where("r <= take").drop("r", "take")


def abba_arms(rows: DataFrame, size: str, key: str, n_per_arm: int) -> DataFrame:
    """Two arms of like sizes: rows by size, evenly spaced, taken in pairs whose order alternates (A B, B A, ...)."""
    ranked = placed(rows.select(size, key), [F.col(size), F.col(key)], name="r").withColumn("n", F.lit(rows.count()))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / (2 * n_per_arm))).cast("int")
    picked = ranked.where((F.col("r") % step == 0) & (F.col("r") / step < 2 * n_per_arm)).withColumn("i", (F.col("r") / step).cast("int"))
    return picked.select(key, size, F.when(F.pmod("i", F.lit(4)).isin(0, 3), "A").otherwise("B").alias("arm"))


def simple_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """min(n, all) rows, the first in the order of the draw."""
    return rows.orderBy(draw(key, seed), key).limit(n)


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a stated order."""
    return rows.orderBy(*order).limit(n)
