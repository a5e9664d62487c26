"""Exact deduplication by distributed radix partitioning on the bytes of the texts, most significant first."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import col, parallelism, text_bytes, tidy

#: Bytes of the first digit; each further digit has STEP times as many.
FIRST, STEP = 16, 4
#: Bytes of the texts that a worker may hold of one group, whatever the size of the table (a single text may be longer).
MOST = 1 << 28


def radix_groups(texts: list[bytes], at: int, width: int = 64):
    """Index lists of equal texts, by splitting on successive bytes until a group is single or its texts have ended."""
    stack = [(list(range(len(texts))), at, width)]
    while stack:
        group, at, width = stack.pop()
        if len(group) == 1:
            yield group
            continue
        parts: dict[bytes, list[int]] = {}
        for i in group:
            parts.setdefault(texts[i][at : at + width], []).append(i)
        for digit, members in parts.items():
            if len(members) == 1 or len(digit) < width:
                yield members
            else:
                stack.append((members, at + width, width * STEP))


def _walk(df: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """df (id, text, ...) with a text's place in the tree so far. node: the crowded node that it stands in, else null. For texts in
    none: depth, parent and digit, where it left the crowded part; or, where its crowded group has ended, keep and size of the group."""
    own = df.columns
    df = df.select(*own, F.lit(0).alias("node"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("binary").alias("digit"), F.lit(None).cast(df.schema["id"].dataType).alias("keep"), F.lit(None).cast("long").alias("size"))
    at, width = 0, FIRST
    for r, tree in enumerate(nodes):
        piece = F.when(F.col("node").isNotNull(), F.substring("text", at + 1, width))
        df = df.withColumn("piece", piece).join(F.broadcast(tree), (F.col("node") == F.col("t_node")) & (F.col("piece") == F.col("t_digit")), "left")
        left = F.col("node").isNotNull() & F.col("t_node").isNull()
        df = df.select(
            *own, F.col("t_next").alias("node"),
            F.when(left, F.lit(r)).otherwise(F.col("depth")).alias("depth"), F.when(left, F.col("node")).otherwise(F.col("parent")).alias("parent"), F.when(left, F.col("piece")).otherwise(F.col("digit")).alias("digit"),
            F.coalesce("keep", "t_keep").alias("keep"), F.coalesce("size", "t_size").alias("size"),
        )
        at, width = at + width, width * STEP
    return df


def _crowded(plain: DataFrame, crowd: int | None, crowd_bytes: int | None) -> list[DataFrame]:
    """The tree of crowded nodes over plain (id, text), a table for each level: rounds of counting, in which nodes of more than
    crowd rows, or of several that make up more than crowd_bytes, are split by their next bytes."""
    spark, kind = plain.sparkSession, plain.schema["id"].dataType
    if crowd is None or crowd_bytes is None:
        all_ = plain.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("b")).first()
        crowd = crowd or max(16, all_.n // (4 * parallelism(spark)))
        crowd_bytes = crowd_bytes or min(MOST, max(1 << 26, all_.b // (4 * parallelism(spark))))
    schema = T.StructType([T.StructField("t_node", T.IntegerType()), T.StructField("t_digit", T.BinaryType()), T.StructField("t_next", T.IntegerType()), T.StructField("t_keep", kind), T.StructField("t_size", T.LongType())])
    nodes: list[DataFrame] = []
    at, width, last, more = 0, FIRST, 0, True
    while more:
        here = _walk(plain, nodes).where("node is not null")
        heavy = here.groupBy("node", F.substring("text", at + 1, width).alias("digit")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("b"), F.max("id").alias("keep"))
        rows, more = [], False
        for h in sorted(heavy.where((F.col("n") > crowd) | (F.col("n") > 1) & (F.col("b") > crowd_bytes)).collect(), key=lambda h: (h.node, bytes(h.digit))):
            if len(h.digit) < width:
                rows.append((h.node, h.digit, None, h.keep, h.n))
            else:
                last += 1
                rows.append((h.node, h.digit, last, None, None))
                more = True
        nodes.append(spark.createDataFrame(rows, schema))
        at, width = at + width, width * STEP
    return nodes


def _starts(levels: int) -> list[int]:
    """Where the bytes begin that no level up to each has looked at."""
    return [FIRST * (STEP**r - 1) // (STEP - 1) + FIRST * STEP**r for r in range(levels)]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int | None = None, crowd_bytes: int | None = None) -> DataFrame:
    """Groups of identical texts. Returns id_col, keep_id (the largest id of the group, which stays), group_size, kept, text_sha256.

    One row for each row of docs. A null text is an empty one. Of rows that repeat the keep_id with the same text one is kept. A
    null id is smaller than any other; a group of only null ids keeps one row and has a null keep_id. Equality is decided on the
    bytes; the digest is an output only. Other columns are not read; an empty table gives no rows.

    Rounds of counting split the nodes of the radix tree that hold more than `crowd` rows (default: a quarter of an even share
    of a partition), or several rows of more than `crowd_bytes` together (a like share, 64 MB at least and 256 MB at most), by their next bytes.
    There are fewer than rows/crowd + bytes/crowd_bytes such nodes, so the tree that is broadcast is bounded by the number of
    partitions. A crowded group whose texts have ended is a group of copies: its size and keep_id are known from the count, and
    its texts are never moved. All other texts are dealt by node and digit in one exchange, and each worker splits one such group
    at a time, of at most `crowd` rows and crowd_bytes or a single row.
    """
    plain = docs.select(col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kind = plain.schema["id"].dataType
    nodes = _crowded(plain, crowd, crowd_bytes)
    starts = _starts(len(nodes))
    walked = _walk(plain, nodes)

    ended = walked.where("size is not null").select("id", "keep", "size", F.sha2("text", 256).alias("sha"))
    best = F.col("id").eqNullSafe(F.col("keep"))
    rest = ended.where(~best).select("id", "keep", "size", F.lit(False).alias("kept"), "sha")
    once = Window.partitionBy("keep", "size", "sha").orderBy("id")
    ended = ended.where(best).select("id", "keep", "size", (F.row_number().over(once) == 1).alias("kept"), "sha").unionByName(rest)

    def run(batches):
        def solve(ids, texts, at):
            out = []
            for g in radix_groups(texts, at):
                keep = max(g, key=lambda i: (ids[i] is not None, ids[i])) if len(g) > 1 else g[0]
                sha = hashlib.sha256(texts[keep]).hexdigest()
                out += [(ids[i], ids[keep], len(g), i == keep, sha) for i in g]
            return out

        key, ids, texts, rows, arrow = None, [], [], [], None

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [arrow, arrow, pa.int64(), pa.bool_(), pa.string()])], ["id", "keep", "size", "kept", "sha"])

        for b in batches:
            arrow = b.schema.field(0).type
            for i, text, *k in zip(*(b.column(c).to_pylist() for c in range(5))):
                if k != key:
                    if ids:
                        rows += solve(ids, texts, starts[key[0]])
                    key, ids, texts = k, [], []
                    if len(rows) >= 5000:
                        yield batch(rows)
                        rows = []
                ids.append(i)
                texts.append(text)
        if ids:
            rows += solve(ids, texts, starts[key[0]])
        if rows:
            yield batch(rows)

    keys = ["depth", "parent", "digit"]
    light = walked.where("size is null").select("id", "text", *keys).repartition(*keys).sortWithinPartitions(*keys)
    light = light.mapInArrow(tidy(run), f"id {kind.simpleString()}, keep {kind.simpleString()}, size long, kept boolean, sha string")
    return ended.unionByName(light).select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def exact_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int | None = None, crowd_bytes: int | None = None) -> DataFrame:
    """docs, with all columns, less the rows that exact_duplicates does not keep: of equal texts (null as empty) one row with the
    largest id stays. Of rows that repeat that id with the same text it is any one; null ids are smaller than any other. An empty
    table gives no rows; columns of any name pass through.

    The same radix tree, but rows are dealt with all their columns, once, and the workers hand on those that stay: no verdicts
    are joined to the rows again. Rows of crowded groups of copies are settled by the count and never dealt, but for those that
    repeat the id that stays.
    """
    names = docs.columns
    text_at = names.index(text_col)
    row = docs.select(col(id_col).alias("id"), text_bytes(text_col).alias("text"), F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    plain = row.select("id", "text")
    nodes = _crowded(plain, crowd, crowd_bytes)
    starts = _starts(len(nodes))
    walked = _walk(row, nodes)
    back = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]

    staying = walked.where("size is not null").where(F.col("id").eqNullSafe(F.col("keep")))
    once = Window.partitionBy("keep", "size", "sha").orderBy("id")
    staying = staying.withColumn("sha", F.sha2("text", 256)).withColumn("r", F.row_number().over(once)).where("r = 1").select(*back)

    def run(batches):
        held, key = [], None  # batches of rows of the latest group, which the next batch may go on with

        def kept(rows, starts_at):
            """Places in rows, a batch of whole groups, that stay."""
            ids, depth = (rows.column(c).to_pylist() for c in (0, 2))
            texts = rows.column(1).field(text_at).cast(pa.binary()).fill_null(b"").to_pylist()
            out = []
            for a, z in zip(starts_at, [*starts_at[1:], len(ids)]):
                if z == a + 1:
                    out.append(a)
                    continue
                for g in radix_groups(texts[a:z], starts[depth[a]]):
                    out.append(a + max(g, key=lambda i: (ids[a + i] is not None, ids[a + i])) if len(g) > 1 else a + g[0])
            return rows.column(1).take(pa.array(sorted(out), pa.int64()))

        def fields(rows):
            return pa.RecordBatch.from_arrays(rows.flatten(), [f"c{i}" for i in range(len(names))])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in (2, 3, 4))))
            at = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else key)]
            if not at:
                held.append(b)
                continue
            if held or at[0]:
                group = pa.Table.from_batches([*held, b.slice(0, at[0])]).combine_chunks().to_batches()
                for x in group:
                    yield fields(kept(x, [0]))
            whole = b.slice(at[0], at[-1] - at[0])
            if len(whole):
                yield fields(kept(whole, [i - at[0] for i in at[:-1]]))
            held, key = [b.slice(at[-1])], keys[-1]
        if held:
            for x in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield fields(kept(x, [0]))

    place = ["depth", "parent", "digit"]
    light = walked.where("size is null").select("id", "row", *place).repartition(*place).sortWithinPartitions(*place)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    light = light.mapInArrow(tidy(run), schema)
    return staying.unionByName(light.toDF(*names)) if len(set(names)) == len(names) else staying.union(light)
