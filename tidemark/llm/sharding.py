"""Sharding into equal bytes by histogram sort, with equal texts kept together. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import col, parallelism, settle

#: Bits of the key that the first round of probes resolves, and each further one.
FIRST_BITS, MORE_BITS = 12, 8


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table from literals (a LocalRelation, no Python on executors)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    lit = lambda v: "null" if v is None else f"array({','.join(f'{x}L' for x in v)})" if isinstance(v, (list, tuple)) else f"{v}L" if isinstance(v, int) and v > -(1 << 63) else str(v)
    empty = not rows
    rows = rows or [tuple(None for _ in names)]
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    out = spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds))} FROM VALUES {body} AS t({', '.join(names)})")
    return out.where("false") if empty else out


def _splitters(light: DataFrame, targets: list[int], tolerance: int) -> list[int]:
    """For each target, the key below which the bytes come nearest to it. Each round counts the exact bytes between probes, evenly
    spaced in the intervals where a target still lies, and stops once all are near enough or an interval is one key wide."""
    spark, n = light.sparkSession, len(targets)
    low, base, best = [0] * n, [0] * n, [(1 << 63, -(1 << 63))] * n
    open_, shift, bits = set(range(n)), 64, FIRST_BITS
    while open_ and shift:
        step = min(bits, shift)
        first = shift == 64
        shift, bits = shift - step, MORE_BITS
        keyed = light.withColumn("probe", F.shiftright("key", shift))
        if not first:
            inside = inline(spark, "up long", [(x,) for x in sorted({low[j] for j in open_})])
            keyed = keyed.withColumn("up", F.shiftright("key", shift + step)).join(F.broadcast(inside), "up")
        got = sorted((r.probe, r.b) for r in keyed.groupBy("probe").agg(F.sum("size").alias("b")).collect())
        for j in sorted(open_):
            total = base[j]
            mine = got if first else [x for x in got if x[0] >> step == low[j]]
            best[j] = min(best[j], (abs(targets[j] - total), (mine[0][0] << shift) if mine else best[j][1]))
            for probe, b in mine:
                if total + b >= targets[j]:
                    low[j], base[j] = probe, total
                    best[j] = min(best[j], (abs(targets[j] - total), probe << shift), (abs(targets[j] - total - b), min((probe + 1) << shift, (1 << 63) - 1)))
                    break
                total += b
            else:
                low[j], base[j] = (mine[-1][0], total - mine[-1][1]) if mine else (0, 0)
            if best[j][0] <= tolerance:
                open_.discard(j)
    out, at = [], -(1 << 63)
    for _, key in best:
        at = max(at, key)
        out.append(at)
    return out


def balanced_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.0005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put whole groups of equal texts into shards of nearly equal bytes.

    Returns id_col, size (UTF-8 bytes, null: none, plus 1), text_crc32 (unsigned), shard from 0, slot (gapless from 0 in each
    shard). One row for each row of docs: repeated rows, null ids, null and empty texts have their places; an empty table gives
    no rows; other columns are not read. Equal texts share a shard, so a shard exceeds an even share only where one text's copies do.

    Rows are sorted by a 64-bit key of the text. Groups of copies over `tolerance` of a shard are counted first (there are fewer
    than shards / tolerance) and go, largest first, to the shard with the least bytes; the others are laid along the key, and
    rounds of exact byte counts below candidate keys refine the splitters until each is within the tolerance. The splitters are
    finer than the shards, so that the one exchange deals rows to as many tasks as the session has partitions; slots are a
    cell's offset, from exact counts, plus the place in the cell. What is broadcast is bounded by shards, tolerance and partitions.
    """
    spark = docs.sparkSession
    text = F.coalesce(col(text_col), F.lit(""))
    rows = settle(docs.select(col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "sizes")
    total = rows.agg(F.sum("size").alias("b")).first().b or 0
    near = max(1, int(total / shards * tolerance))
    heavy = sorted(((r.b, r.key) for r in rows.groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > near).collect()), reverse=True)
    load, home = [0] * shards, {}
    for b, key in heavy:
        s = min(range(shards), key=lambda s: (load[s], s))
        load[s] += b
        home[key] = s
    crowd = inline(spark, "key long, home int", sorted(home.items()))
    light = rows.join(F.broadcast(crowd), "key", "left_anti")

    rest = total - sum(load)
    fill, spare = [0.0] * shards, rest
    level = sorted(range(shards), key=lambda s: load[s])
    for k in range(shards, 0, -1):  # the shards already above an even share get nothing more
        even = (spare + sum(load[s] for s in level[:k])) / k
        if load[level[k - 1]] <= even:
            for s in level[:k]:
                fill[s] = even - load[s]
            break
    cells = max(1, -(-2 * parallelism(spark) // shards))
    targets, at = [], 0.0
    for s in range(shards):
        targets += [int(at + fill[s] * c / cells) for c in range(1, cells)] + [int(at + fill[s])]
        at += fill[s]
    splits = _splitters(light, targets[:-1], near) if rest else []

    top = 64 - FIRST_BITS
    within: dict[int, list[int]] = {}
    for x in splits:
        within.setdefault(x >> top, []).append(x)
    lookup, below = [], 0
    for p in range(-(1 << (FIRST_BITS - 1)), 1 << (FIRST_BITS - 1)):
        mine = within.get(p, [])
        lookup.append((p, below, mine))
        below += len(mine)
    lookup = inline(spark, "top long, below int, inner array<bigint>", lookup)
    cell = F.col("below") + F.size(F.filter("inner", lambda x: x <= F.col("key")))
    placed = rows.withColumn("top", F.shiftright("key", top)).join(F.broadcast(lookup), "top").join(F.broadcast(crowd), "key", "left")
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(cells)).cast("int")
    placed = placed.select("id", "size", "crc", "key", F.coalesce("home", F.floor(cell / cells).cast("int")).alias("shard"), F.when(F.col("home").isNotNull(), -1 - salt).otherwise(cell).alias("cell"))

    counts = sorted((r.shard, r.cell, r.n) for r in placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).collect())
    offsets, at, shard = [], 0, None
    for s, c, n in counts:
        at = 0 if s != shard else at
        offsets.append((s, c, at))
        at, shard = at + n, s
    offsets = inline(spark, "shard int, cell int, ahead long", offsets)
    from pyspark.sql import Window

    order = Window.partitionBy("shard", "cell").orderBy("key", "id", "size")
    out = placed.withColumn("place", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "cell"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("ahead") + F.col("place") - 1).alias("slot"))
