"""Near-duplicate groups by an inverted join over the coordinates of MinHash signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle, text_bytes, tidy
from tidemark.llm.components import components

MEMO_ENTRIES = 200_000
#: Members of a list that a task compares with as many others at a time.
BLOCK = 2500
#: Size of the bitmap of wanted ids: 4 MB.
MAP_BITS = 1 << 25
_M = np.uint64(0xFF51AFD7ED558CCD)


class Shingler:
    """Sorted distinct hashes of a text's word shingles, and the coordinates of their signature."""

    def __init__(self, words: int, coordinates: int):
        self.k, self.memo = words, {}
        r = np.random.default_rng(20240607)
        self.a = r.integers(1, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, coordinates, np.uint64)

    def set(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(w))
        n = len(w) - k + 1
        with np.errstate(over="ignore"):
            h = np.full(n, k, np.uint64)
            for i in range(k):
                h = (h ^ w[i : i + n]) * _M
                h ^= h >> np.uint64(33)
        return np.unique(h)

    def signature(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(s), 512):
                out = np.minimum(out, (((s[i : i + 512, None] ^ self.b) * self.a) >> np.uint64(32)).min(0))
        return out.astype(np.uint32)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _emit(cols: list, kinds: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


BIN, INT = pa.binary(), pa.int64()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 64, slack: float = 4.9, cells: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicate texts. Returns id_col, n_shingles (size of the set), component_id (the smallest id reachable, its own
    included), kept (id_col = component_id); one row for each row of docs.

    A text's set has its distinct shingles of `words` words, or the whole sequence if it has fewer; texts without words (null,
    empty) have none and link with nothing. Sets with 100 * intersection >= percent * union are linked. Rows with equal sets are
    one class and are never compared; a null id is larger than any other and only stands for a group of null ids. Other columns
    are not read; an empty table gives no rows.

    Every class is posted under its rarest coordinate-value pairs only: two sets at the limit agree in at least `least` of the
    `coordinates` (the mean less `slack` standard deviations: about one such pair in two million agrees in fewer), so they meet in
    the coordinates - least + 1 rarest ones, in an order by a counting sketch of fixed size. Frequent pairs are thereby skipped.
    In two turns each class outside of a list's largest component is compared with members of that, the best agreements first, and
    confirmed links make components. Then, in lists that still hold several components, all pairs across components are judged,
    a pair of blocks of the list in a task. Each comparison counts agreeing coordinates, then takes the full sets. Pairs inside
    a component can add nothing, so no group of copies is expanded.
    """
    spark = docs.sparkSession
    p = percent / 100
    least = max(1, int(coordinates * p - slack * (coordinates * p * (1 - p)) ** 0.5))
    prefix = coordinates - least + 1
    kind = docs.select(col(id_col).alias("id")).schema[0].dataType.simpleString()
    plain = docs.select(col(id_col).alias("id"), text_bytes(text_col).alias("text"))

    def sign(batches):
        s = Shingler(words, coordinates)
        for b in batches:
            n, dig, sig = [], [], []
            for t in b.column(1):
                x = s.set(t.as_py())
                n.append(len(x))
                dig.append(_digest(x) if len(x) else None)
                sig.append(s.signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, INT), pa.array(dig, BIN), pa.array(sig, BIN)], ["id", "n", "c", "sig"])

    signed = settle(plain.mapInArrow(tidy(sign), f"id {kind}, n long, c binary, sig binary"), "signed")
    classes = settle(signed.where("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    parts = 16

    def sketch(batches):
        total = np.zeros(cells, np.int32)
        for b in batches:
            total += np.bincount(_cells(_coordinates(b.column(0).to_pylist())).ravel(), minlength=cells).astype(np.int32)
        size = cells // parts
        yield _emit([range(parts), [total[i * size : (i + 1) * size].tobytes() for i in range(parts)]], [INT, BIN], ["part", "v"])

    def add(batches):
        sums: dict = {}
        for b in batches:
            for part, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(v, np.int32)
        yield _emit([list(sums), [v.tobytes() for v in sums.values()]], [INT, BIN], ["part", "v"])

    def _coordinates(sigs):
        """(class, coordinate) -> coordinate << 32 | value."""
        v = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, coordinates).astype(np.int64)
        return v | (np.arange(coordinates, dtype=np.int64) << 32)

    def _cells(keys):
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % cells

    counted = np.zeros(cells, np.int32)
    for r in classes.select("sig").mapInArrow(tidy(sketch), "part long, v binary").repartition(parts, "part").mapInArrow(tidy(add), "part long, v binary").collect():
        size = cells // parts
        counted[r.part * size : (r.part + 1) * size] = np.frombuffer(r.v, np.int32)
    shared = spark.sparkContext.broadcast(counted)

    def _prefix(keys):
        seen = shared.value
        with np.errstate(over="ignore"):
            tie = ((keys.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(34)).astype(np.int64)
        rank = (seen[_cells(keys)].astype(np.int64) << 30) | tie
        return np.argpartition(rank, prefix - 1, axis=1)[:, :prefix] if prefix < coordinates else np.tile(np.arange(coordinates), (len(keys), 1))

    def post(batches):
        for b in batches:
            keys = _coordinates(b.column(2).to_pylist())
            chosen = np.take_along_axis(keys, _prefix(keys), 1).ravel()
            rows = pa.array(np.repeat(np.arange(len(keys)), prefix))
            yield pa.RecordBatch.from_arrays([pa.array(chosen), b.column(0).take(rows), b.column(1).take(rows)], ["key", "c", "n"])

    def shared_lists(batches):
        """Members of lists with two or more."""
        held, out = None, []
        for b in batches:
            for key, c, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held and held[0] == key:
                    if not held[3]:
                        out.append(held[:3])
                        held = (key, c, n, True)
                    out.append((key, c, n))
                else:
                    held = (key, c, n, False)
            if len(out) >= 10_000:
                yield _emit(list(zip(*out)), [INT, BIN, INT], ["key", "c", "n"])
                out = []
        if out:
            yield _emit(list(zip(*out)), [INT, BIN, INT], ["key", "c", "n"])

    postings = classes.select("c", "n", "sig").mapInArrow(tidy(post), "key long, c binary, n long").repartition("key").sortWithinPartitions("key", "c")
    lists = settle(postings.mapInArrow(tidy(shared_lists), "key long, c binary, n long"), "lists")

    def with_texts(rows: DataFrame, name: str) -> DataFrame:
        """rows, which have a class c, with a text of that class. A bitmap of the wanted ids' hashes, of a fixed size, keeps most
        other texts from the join; as it fills up, more of them pass, at worst all. Rows that repeat an id can bring other texts;
        readers test the set."""
        wanted = settle(rows.join(classes.select("c", "least"), "c"), f"{name}-wanted")
        spot = lambda id: F.pmod(F.xxhash64(id), F.lit(MAP_BITS)) + 1
        bits = np.zeros(MAP_BITS // 8, np.uint8)
        found = wanted.select(spot("least").alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
        for r in found.collect():
            bits[(r.k - 1) * len(r.m) : r.k * len(r.m)] = np.frombuffer(r.m, np.uint8)
        told = spark.sparkContext.broadcast(bits)

        def asked_for(batches):
            seen = told.value
            for b in batches:
                x = b.column(2).to_numpy() - 1
                b = b.filter(pa.array((seen[x >> 3] >> (x & 7) & 1).astype(bool)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["id", "text"])

        texts = plain.withColumn("x", spot("id")).mapInArrow(tidy(asked_for), f"id {kind}, text binary")
        return wanted.join(texts, wanted["least"].eqNullSafe(texts["id"])).select(*rows.columns, "text")

    def confirm(batches):
        maker, out, at, mine = Shingler(words, 1), [], None, None
        for b in batches:
            for a, salt, other, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = maker.set(text)
                if _digest(s) != (other or a):
                    continue
                if other is None:
                    at, mine = (a, salt), s
                elif at == (a, salt):
                    inter = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * inter >= percent * (len(mine) + len(s) - inter):
                        out.append((a, other))
            if len(out) >= 5000:
                yield _emit(list(zip(*out)), [BIN, BIN], ["u", "v"])
                out = []
        if out:
            yield _emit(list(zip(*out)), [BIN, BIN], ["u", "v"])

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs a, b whose full sets are linked, as u, v. A text with many partners is dealt to several tasks."""
        pairs = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("many")), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / 100)).cast("int").alias("salt"))
        pairs = settle(pairs, f"{name}-pairs")
        own = pairs.select(F.col("a").alias("c"), "a", "salt", F.lit(None).cast("binary").alias("b")).distinct()
        texts = with_texts(own.unionByName(pairs.withColumn("c", F.col("b"))), name).select("a", "salt", "b", "text")
        dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return settle(dealt.mapInArrow(tidy(confirm), "u binary, v binary"), f"{name}-links")

    def runs_of(batches, columns: int, keys: int = 1):
        """The rows of each key, in turn."""
        key, group = None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
                k, row = row[0] if keys == 1 else row[:keys], row[keys:]
                if k != key:
                    if group:
                        yield key, group
                    key, group = k, []
                group.append(row)
        if group:
            yield key, group

    def stream(rows, kinds: list, names: list):
        out = []
        for x in rows:
            out.append(x)
            if len(out) >= 5000:
                yield _emit(list(zip(*out)), kinds, names)
                out = []
        if out:
            yield _emit(list(zip(*out)), kinds, names)

    def low_bytes(batches):
        """The lowest byte of each coordinate: at least as many agree as do of the coordinates themselves."""
        for b in batches:
            v = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, coordinates).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], BIN)], ["c", "brief"])

    brief = classes.select("c", "sig").mapInArrow(tidy(low_bytes), "c binary, brief binary")

    def mixed(roots: DataFrame | None, name: str) -> DataFrame:
        """Lists that hold several components, with each member's component."""
        if roots is None:
            return lists.withColumn("root", F.col("c"))
        placed = lists.join(roots.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "n", F.coalesce("root", "c").alias("root"))
        several = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("key")
        return settle(placed.join(several, "key", "left_semi"), name)

    def attempts(turn: int):
        """Each member outside of its list's largest component, with two of that component (the first list members at first), and
        in how many bytes they agree; pairs whose sizes or bytes admit no link are left out."""

        def run(batches):
            def pairs():
                for key, group in runs_of(batches, 5):
                    big = Counter(x[2] for x in group).most_common(1)[0][0]
                    inside = [x for x in group if x[2] == big]
                    for c, n, r, marks in group:
                        if r != big:
                            h = int.from_bytes(c[:8], "little") ^ key * 0x9E3779B97F4A7C15 ^ turn << 7
                            for i in {h % len(inside), (h >> 20) % len(inside)}:
                                x, m, _, others = inside[i]
                                same = int((np.frombuffer(marks, np.uint8) == np.frombuffer(others, np.uint8)).sum())
                                if same >= least and 100 * min(n, m) >= percent * max(n, m):
                                    yield x, c, same

            return stream(pairs(), [BIN, BIN, INT], ["a", "b", "same"])

        return run

    def across(batches):
        """Links between members of different components, each pair judged once: in the first list that both post under and the
        pair of blocks that they are in. Best agreements come first; what a link joins is not compared any more."""

        maker = Shingler(words, 1)

        def with_sets(group):
            return [(*x[:5], made) for x in group if _digest(made := maker.set(x[5])) == x[0]]

        def pairs():
            for _, group, root, y, others in likely(batches, 9, with_sets):
                for x in others:
                    if root[x] != root[y]:
                        one, two = group[x][5], group[y][5]
                        inter = len(np.intersect1d(one, two, assume_unique=True))
                        if 100 * inter >= percent * (len(one) + len(two) - inter):
                            root[root == root[y]] = root[x]
                            yield group[x][0], group[y][0]

        return stream(pairs(), [BIN, BIN], ["u", "v"])

    def likely(batches, columns: int, prepared=list):
        """(key, group, components, member, its partners in the order of agreement) of groups of a list's blocks."""
        for keys, group in runs_of(batches, columns, 3):
            key, low, high = keys
            group = prepared(group)
            if not group:
                continue
            big = Counter(x[2] for x in group).most_common(1)[0][0]
            n, block = np.array([x[1] for x in group]), np.array([x[3] for x in group])
            code = {r: i for i, r in enumerate({x[2] for x in group})}
            root = np.array([code[x[2]] for x in group])
            coords = _coordinates([x[4] for x in group])
            sig, posted = coords.astype(np.uint32), np.zeros(coords.shape, bool)
            np.put_along_axis(posted, _prefix(coords), True, 1)
            inside = root == code[big]
            for y in np.flatnonzero(~inside):
                there = block == (high if block[y] == low else low)
                fit = np.flatnonzero(there & (root != root[y]) & (100 * np.minimum(n, n[y]) >= percent * np.maximum(n, n[y])) & (inside | (np.arange(len(n)) > y)))
                same = sig[fit] == sig[y]
                count = same.sum(1)
                once = (count >= least) & ((same & posted[fit] & posted[y]).argmax(1) == key >> 32)
                if once.any():
                    yield keys, group, root, y, fit[once][np.argsort(-count[once], kind="stable")]

    def taking_part(batches):
        """Members of which some pair is to be judged, so that only their texts are fetched."""

        def members():
            at, taken = None, {}
            for keys, group, _, y, others in likely(batches, 8):
                if keys != at:
                    yield from ((*at, *x) for x in taken.values())
                    at, taken = keys, {}
                taken.update((group[i][0], group[i]) for i in (y, *others))
            yield from ((*at, *x) for x in taken.values())

        return stream(members(), [INT, pa.int32(), pa.int32(), BIN, INT, BIN, pa.int32(), BIN], [*keys, "c", "n", "root", "block", "sig"])

    keys = ["key", "low", "high"]
    links, roots = None, None
    for turn in range(3):
        rows = mixed(roots, f"mixed{turn}")
        if turn < 2:
            rows = rows.join(brief, "c").select("key", "c", "n", "root", "brief").repartition("key").sortWithinPartitions("key", "root", "c")
            pairs = rows.mapInArrow(tidy(attempts(turn)), "a binary, b binary, same long").distinct()
            pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("same"), "a"))).where("r <= 3").select("a", "b")
            got = confirmed(pairs, f"near{turn}")
        else:
            blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
            rows = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
            rows = rows.join(classes.select("c", "sig"), "c").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "c", "n", "root", "block", "sig")
            part = rows.repartition(*keys).sortWithinPartitions(*keys, "root", "c").mapInArrow(tidy(taking_part), "key long, low int, high int, c binary, n long, root binary, block int, sig binary")
            rows = with_texts(settle(part, "taking-part"), "across").select(*keys, "c", "n", "root", "block", "sig", "text")
            got = settle(rows.repartition(*keys).sortWithinPartitions(*keys, "root", "c").mapInArrow(tidy(across), "u binary, v binary"), "across")
        if not got.isEmpty():
            links = got if links is None else links.unionByName(got)
            roots = components(links, "component")
    if roots is None:
        roots = classes.select(F.col("c").alias("node"), F.col("c").alias("root")).where("false")

    named = classes.select("c", "least").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    groups = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("c", "component")
    out = signed.select("id", "n", "c").join(groups, "c", "left")
    label = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"), label.eqNullSafe(F.col("id")).alias("kept"))
