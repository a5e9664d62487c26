"""Places of rows in a total order, by range partitions and carried offsets: no task sees more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

_PART, _AT, _TIE = "\0part", "\0at", "\0tie"  # names that no table has


def placed(rows: DataFrame, order: list[str | Column], within: list[str] | None = None, name: str = "pos") -> DataFrame:
    """rows with `name`, the place (long, from 0) in the order inside the groups of the columns `within`; nulls first, in the order
    and as a group. Rows that tie are told apart by where they stand in the input. Every row is kept.

    Rows are dealt by ranges of (within, order, where they stand), so a group or a value that holds most rows is cut like others, and are
    written once. Rows of a group are counted in each range; the ranges' counts are summed in order, and the only thing that is gathered
    is that table: one row for each range and group in it."""
    within = list(within or [])
    keyed = rows.withColumn(_TIE, F.monotonically_increasing_id())
    keys = [*(F.col(f"`{c}`") for c in within), *order, F.col(_TIE)]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_TIE)
    ranged = ranged.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = written(ranged, "placed")
    sizes = ranged.groupBy(*within, _PART).agg(F.min(_AT).alias("\0first"), F.count("*").alias("\0n"))
    before = Window.partitionBy(*within).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("\0ahead", F.coalesce(F.sum("\0n").over(before), F.lit(0)) - F.col("\0first"))
    renamed = offsets.select(*(F.col(f"`{c}`").alias(f"\0g{i}") for i, c in enumerate(within)), F.col(_PART).alias("\0p"), "\0ahead")
    same = F.col(_PART) == F.col("\0p")
    for i, c in enumerate(within):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"\0g{i}"))
    if not within:
        renamed = F.broadcast(renamed)  # a row for each range
    out = ranged.join(renamed, same)
    return out.withColumn(name, F.col(_AT) + F.col("\0ahead")).drop(_PART, _AT, "\0p", "\0ahead", *(f"\0g{i}" for i in range(len(within))))
