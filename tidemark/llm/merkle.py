"""A Merkle manifest of a table: leaves are rows, groups have subtrees, and one root covers all."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle, tidy
from tidemark.operators.ranks import placed

#: A block is what one task reduces at a time: FAN ** HEIGHT nodes. The driver builds what stands above at most TOP nodes.
FAN, HEIGHT, TOP = 3, 8, 20_000


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def climb(nodes: list[str], of: int, height: int | None = None) -> list[list[str]]:
    """The levels above a run of nodes: they stand in a group of `of` nodes, which is climbed to its top or for `height` levels."""
    levels = [nodes]
    while of > 1 and (height is None or len(levels) <= height):
        nodes = [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        levels.append(nodes)
        of = -(-of // FAN)
    return levels


def sides(levels: list[list[str]], i: int) -> list[str]:
    """The siblings of node i, level by level: those to its left, a bar, those to its right."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % FAN
        out.append("".join(nodes[first:i]) + "|" + "".join(nodes[i + 1 : first + FAN]))
        i //= FAN
    return out


def folded(node: str, proof: list[str]) -> str:
    """The root that a node and its siblings give."""
    for step in proof:
        left, right = step.split("|")
        node = digest(left + node + right)
    return node


def _by_block(nodes: DataFrame) -> DataFrame:
    """Nodes (g, pos, n, h, ...) dealt so that a task has whole blocks, one after the other. No block is larger than FAN ** HEIGHT."""
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / FAN**HEIGHT).cast("long"))
    return keyed.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _blocks(batches, *names: str):
    """(columns of a block) for each block of the batches; blocks go on from one batch to the next."""
    held, key = None, None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("g", "block", *names)]
        for row in zip(*cols):
            if row[:2] != key:
                if held:
                    yield key, held
                held, key = [], row[:2]
            held.append(row[2:])
    if held:
        yield key, held


def block_nodes(nodes: DataFrame) -> DataFrame:
    """(g, pos, n, h): the nodes HEIGHT levels up, or the tops of groups that end before."""
    kind = nodes.schema["g"].dataType.simpleString()

    def run(batches):
        rows = []
        for (g, block), held in _blocks(batches, "n", "h"):
            n = held[0][0]
            rows.append((g, block, -(-n // FAN**HEIGHT), climb([h for _, h in held], n, HEIGHT)[-1][0]))
            if len(rows) >= 5000:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)

    arrow = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())])
    return _by_block(nodes.select("g", "pos", "n", "h")).mapInArrow(tidy(run), f"g {kind}, pos long, n long, h string")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)


def to_top(nodes: DataFrame) -> DataFrame:
    """(g, pos, path, top) of settled nodes (g, pos, n, h): the siblings from each node to the top of its group.

    Up to TOP nodes the driver builds the trees, and the paths are a table of as many rows. Of more, groups of one node have ended; blocks
    of the others are reduced, their nodes' paths are found in the same way, and each block's task puts its own before them."""
    spark = nodes.sparkSession
    many = nodes.where("n > 1")
    if many.count() <= TOP:
        trees: dict = {}
        for r in many.orderBy("g", "pos").collect():
            trees.setdefault(r.g, []).append(r.h)
        rows = []
        for g, own in trees.items():
            levels = climb(own, len(own))
            rows += [(g, i, sides(levels, i), levels[-1][0]) for i in range(len(own))]
        paths = F.broadcast(spark.createDataFrame(rows, "g string, pos long, path array<string>, top string"))  # TOP rows at most
    else:
        paths = settle(with_paths(many, to_top(settle(block_nodes(many), "merkle-nodes"))), "merkle-paths").select("g", "pos", "path", "top")
    alone = nodes.where("n = 1").select("g", "pos", F.array().cast("array<string>").alias("path"), F.col("h").alias("top"))
    return settle(paths.unionByName(alone), "merkle-tops")


def with_paths(nodes: DataFrame, above: DataFrame, seen: bool = False) -> DataFrame:
    """Nodes (g, pos, n, h, ...) with path and top, and with `seen` the top that their column seen folds to. above: the paths and tops of
    the blocks' nodes. The first row of a block takes its block's path along (one row in FAN ** HEIGHT is joined)."""
    size = FAN**HEIGHT
    firsts = nodes.where(F.col("pos") % size == 0).withColumn("at", (F.col("pos") / size).cast("long"))
    above = above.select(F.col("g").alias("g_"), F.col("pos").alias("at_"), "path", "top", *(["more"] if "more" in above.columns else []))
    extra = [c for c in above.columns if c in ("more",)]
    firsts = firsts.join(above, F.col("g").eqNullSafe(F.col("g_")) & (F.col("at") == F.col("at_"))).drop("g_", "at_", "at")
    others = nodes.where(F.col("pos") % size != 0).withColumns({"path": F.lit(None).cast("array<string>"), "top": F.lit(None).cast("string"), **{c: F.lit(None).cast(above.schema[c].dataType) for c in extra}})
    dealt = _by_block(firsts.unionByName(others))
    own = [c for c in nodes.columns]
    added = "path array<string>, top string" + (", seen_top string" if seen else "") + "".join(f", {c} {above.schema[c].dataType.simpleString()}" for c in extra)
    names = [*own, "path", "top", *extra]

    def run(batches):
        at = {c: i for i, c in enumerate(names)}
        for (g, block), held in _blocks(batches, *names):
            path, top = held[0][at["path"]] or [], held[0][at["top"]]
            rest = [held[0][at[c]] for c in extra]
            levels = climb([r[at["h"]] for r in held], held[0][at["n"]], HEIGHT)
            for first in range(0, len(held), 1000):
                rows = []
                for i in range(first, min(first + 1000, len(held))):
                    proof = sides(levels, i) + path
                    rows.append((*held[i][: len(own)], proof, top, *([folded(held[i][at["seen"]], proof)] if seen else []), *rest))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), arrow.types)], schema=arrow)

    fields = [f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in own]
    schema = ", ".join(fields) + ", " + added
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parsed(schema))
    return dealt.mapInArrow(tidy(run), schema)


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def leaf(columns: dict[str, Column]) -> Column:
    """H of the columns' values: `-` for null, else count of UTF-8 bytes, colon, value."""
    parts = []
    for c in columns.values():
        value = c.cast("string")
        parts += [F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))]
    return F.sha2(F.concat(*parts), 256)


def merkle_manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", presented: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: id_col, leaf, subroot (of the rows with its group), root (of all), proof (the siblings from leaf to
    root, level by level, left ones and right ones with a bar between), presented_root (what the row folds to when its columns are read
    as `presented` says: a dict of columns in place of those in docs), verified (presented_root = root).

    A group's leaves ascend by id (null first; rows of one id by leaf, equal rows are alike); groups by UTF-8 bytes, null first. Every FAN
    consecutive nodes become one until one remains, and so do the groups' tops. Null values have a mark of their own, so null and ''
    differ. Other columns are not read. An empty table gives no rows; a table of one row has its leaf as root and an empty proof.

    Leaves are placed by ranges of (group, id), so a group of any size is cut evenly; blocks of 3^8 leaves are reduced side by side; the
    driver builds what stands above at most 20,000 nodes (more are reduced in further rounds) and broadcasts the paths from there up; the tasks
    of the blocks finish the proofs and fold every row. Nothing but those top nodes reaches the driver."""
    shown = {c: (presented or {}).get(c, col(c)) for c in fields}
    rows = docs.select(col(id_col).alias("id"), col(group_col).cast("string").alias("g"), leaf({c: col(c) for c in fields}).alias("h"), leaf(shown).alias("seen"))
    rows = placed(settle(rows, "merkle-leaves"), [F.col("id"), F.col("h")], ["g"])
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).select(F.col("g").alias("g_"), "n")
    rows = settle(rows.join(sizes, F.col("g").eqNullSafe(F.col("g_"))).drop("g_"), "merkle-placed")

    above = to_top(settle(block_nodes(rows), "merkle-blocks"))
    groups = placed(above.where("pos = 0").select(F.col("g").alias("source"), F.col("top").alias("h")), [F.col("source")])
    count = groups.count()
    groups = settle(groups.select("source", F.lit("").alias("g"), "pos", F.lit(count).cast("long").alias("n"), "h"), "merkle-groups")
    upper = with_paths(groups, to_top(settle(block_nodes(groups), "merkle-over"))).select(F.col("source").alias("source_"), F.col("path").alias("rest"), F.col("top").alias("more"), F.col("h").alias("subroot"))
    # `top` is the root from here on, `more` the subroot; the paths lead from a block to the root
    suffix = above.join(upper, F.col("g").eqNullSafe(F.col("source_"))).select("g", "pos", F.concat("path", "rest").alias("path"), F.col("more").alias("top"), F.col("subroot").alias("more"))
    suffix = settle(suffix, "merkle-suffix")
    if suffix.count() <= TOP:
        suffix = F.broadcast(suffix)  # TOP rows of some 2 KB at most
    out = with_paths(rows, suffix, seen=True)
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), F.col("more").alias("subroot"), F.col("top").alias("root"), F.col("path").alias("proof"), F.col("seen_top").alias("presented_root"), (F.col("seen_top") == F.col("top")).alias("verified"))


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings, from leaf to root, left to right."""
    return F.sha2(F.replace(F.array_join(proof, ""), F.lit("|"), F.lit("")), 256)
