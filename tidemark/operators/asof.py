"""As-of join: each row of one side meets the latest (or next) row of the other, without a calendar and without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

_KIND, _TIE, _PART, _AT = "\0kind", "\0tie", "\0part", "\0at"  # names that no table has


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, direction: str = "backward", strict: bool = False) -> DataFrame:
    """All rows of left with the columns of right, other than `on` and `by`, of the row with the same `by` and the last `on` up to the left row's
    (backward), or the first from it on (forward); strict: not the left row's own `on`. The right row's `on` is there as matched_`on`.

    Columns are null where no row fits, and where `on` or one of `by` is null. Of right rows with one `on` the one with the largest values counts
    (forward: the smallest). No row of left is left out or repeated. Values of right whose names left has must be renamed before.

    Both sides are put in one order by (by, on) and cut into ranges, so that a group of any size is spread. Within a range the last value seen is
    carried along; across ranges the last value of each (range, group) is, in a table with one row for each."""
    by, back = list(by or []), direction == "backward"
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction!r} is neither backward nor forward")
    values = [c for c in right.columns if c != on and c not in by]
    if set(values) & set(left.columns):
        raise ValueError(f"both sides have {sorted(set(values) & set(left.columns))}")
    seen = F.struct(*[F.col(f"`{c}`") for c in values], F.col(f"`{on}`").alias(f"matched_{on}"))
    keys = [on, *by]
    first = right.select(*by, on, seen.alias("\0seen"), F.lit(None).cast(left.schema).alias("\0row")).dropna(subset=keys)
    second = left.select(*by, on, F.lit(None).cast(first.schema["\0seen"].dataType).alias("\0seen"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("\0row"))
    # where both have one `on`, rows that may match stand on the side from which values are carried
    right_first = back != strict
    first, second = first.withColumn(_KIND, F.lit(int(not right_first))), second.withColumn(_KIND, F.lit(int(right_first)))
    both = first.unionByName(second).withColumn(_TIE, F.monotonically_increasing_id())
    order = [*(F.col(f"`{c}`") for c in [*by, on]), F.col(_KIND), F.col("\0seen"), F.col(_TIE)]
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order).drop(_TIE).withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id())
    ranged = written(ranged, "asof")

    pick = F.last if back else F.first
    here = Window.partitionBy(_PART, *by).orderBy(_AT)
    here = here.rowsBetween(Window.unboundedPreceding, 0) if back else here.rowsBetween(0, Window.unboundedFollowing)
    local = ranged.withColumn("\0near", pick("\0seen", ignorenulls=True).over(here)).where(F.col("\0row").isNotNull())
    ends = ranged.groupBy(*by, _PART).agg((F.max_by if back else F.min_by)("\0seen", F.when(F.col("\0seen").isNotNull(), F.col(_AT))).alias("\0end"))
    over = Window.partitionBy(*by).orderBy(_PART)
    over = over.rowsBetween(Window.unboundedPreceding, -1) if back else over.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(F.col(_PART).alias("\0p"), *[F.col(f"`{c}`").alias(f"\0b{i}") for i, c in enumerate(by)], pick("\0end", ignorenulls=True).over(over).alias("\0far")).where(F.col("\0far").isNotNull())
    same = F.col(_PART) == F.col("\0p")
    for i, c in enumerate(by):
        same &= F.col(f"`{c}`") == F.col(f"\0b{i}")
    known = F.lit(True)
    for c in keys:
        known &= F.col(f"`{c}`").isNotNull()
    met = local.join(carried, same, "left").select("\0row", F.when(known, F.coalesce("\0near", "\0far")).alias("\0seen"))
    return met.select("\0row.*", *[F.col("\0seen")[c].alias(c) for c in [*values, f"matched_{on}"]])
