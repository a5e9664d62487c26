"""Removal of long repeated byte strings, by enhanced suffix arrays over content-defined anchors.

Any string of `length` bytes holds at least one anchor, a gram with the least hash of some window, and equal strings hold the same
anchors at the same places. So the suffixes that start at anchors, grouped by the gram, stand for all suffixes: in each group the
suffixes are sorted, a stack scan over their common prefixes gives the tree of prefix intervals, and the strings before the
anchors, compared inside each interval, tell how far its repeats extend to the left: all occurrences of the maximal repeats.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle, text_bytes, tidy

#: Bytes of an anchor's gram.
GRAM = 32
#: Occurrences of a gram up to which one task gathers their surroundings (of less than 800 bytes each).
CROWD = 50_000
#: Digests of surroundings that a task remembers before it starts anew; bounds memory, never results.
MET = 200_000
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 22


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


_SEEDS = {s: (_table(s), *np.random.default_rng(s + 1000).integers(1, 1 << 63, 2, np.uint64) | np.uint64(1)) for s in (7, 8)}


def window_hashes(data: np.ndarray, length: int, seed: int = 7) -> np.ndarray:
    """A hash of each run of `length` bytes, from hashes of runs of powers of two."""
    table, a, b = _SEEDS[seed]
    level, size, out, done = table[data], 1, None, 0
    n = len(data) - length + 1
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                part = level[done : done + n]
                out = part.copy() if out is None else _mix(out * a + part, b)
                done += size
            if done == length:
                return out
            level = _mix(level[:-size] * a + level[size:], b)
            size *= 2


def _mix(h: np.ndarray, b: np.uint64) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= b
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of a text's anchors: of each window of `length` bytes, the leftmost gram with the least hash."""
    span = length - GRAM + 1
    places, keys = [], []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        h = window_hashes(data[at : at + BLOCK + length - 1], GRAM)
        v = (h >> np.uint64(26) << np.uint64(26)) | np.arange(len(h), dtype=np.uint64)
        n = len(v) - span + 1
        padded = np.full(-(-len(v) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(v)] = v
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        p = np.unique((least & np.uint64((1 << 26) - 1)).astype(np.int64))
        places.append(p + at)
        keys.append(h[p].view(np.int64))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(keys)[first]


def owned(data: np.ndarray, at: int, length: int) -> list[int]:
    """Starts of the windows of data whose anchor is the gram at `at`."""
    span = length - GRAM + 1
    h = window_hashes(data, GRAM) >> np.uint64(26)
    least = np.lib.stride_tricks.sliding_window_view(h, span).argmin(1)
    return np.flatnonzero(least + np.arange(len(least)) == at).tolist()


def common(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def reaches(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int) -> list[tuple[int, int]]:
    """For each context of an anchor (the reversed bytes before it, and the bytes from it on): how far left and right of the anchor
    strings of at least `length` bytes reach that also occur in another context, or in a further copy of this one; (0, 0): none.

    One stack scan over the sorted right sides: each interval carries its members in the order of their left sides, and where
    intervals close, the smaller part is put into the larger one, so a context is looked at a logarithmic number of times."""
    n = len(lefts)
    left, right = [0] * n, [0] * n

    def meet(i: int, a: int, b: int) -> None:
        if a + b >= length:
            left[i], right[i] = max(left[i], a), max(right[i], b)

    for i in range(n):
        if counts[i] > 1:
            meet(i, len(lefts[i]), len(rights[i]))
    if n == 2:
        a, b = common(*lefts), common(*rights)
        meet(0, a, b), meet(1, a, b)
    elif n > 2:
        order = sorted(range(n), key=rights.__getitem__)
        place = sorted(range(n), key=lefts.__getitem__)
        rank = [0] * n
        for r, i in enumerate(place):
            rank[i] = r
        stack: list[tuple[int, list[int]]] = []  # open intervals: prefix length, and the places of their members' lefts in order

        def join(into: list[int], others: list[int], size: int) -> list[int]:
            """Members of two parts of an interval together. Only neighbours that become new can reach further left than before."""
            if len(into) < len(others):
                into, others = others, into
            if 8 * len(others) > len(into):
                both = sorted(into + others)
            else:
                both = into
                for r in others:
                    insort(both, r)
            for r in others:
                at = bisect_left(both, r)
                for x in both[max(0, at - 1) : at] + both[at + 1 : at + 2]:
                    a = common(lefts[place[r]], lefts[place[x]])
                    meet(place[r], a, size), meet(place[x], a, size)
            return both

        for k in range(n):
            last = [rank[order[k]]]
            size = common(rights[order[k]], rights[order[k + 1]]) if k + 1 < n else -1
            while stack and stack[-1][0] > size:
                within, part = stack.pop()
                last = join(part, last, within)
            if stack and stack[-1][0] == size:
                stack[-1] = (size, join(stack[-1][1], last, size))
            elif size >= 0:
                stack.append((size, last))
    return list(zip(left, right))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else in the table, the same text included.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with keep_text the kept bytes. One row for each row of docs. Strings are judged on
    the input and never cross texts; a null text is an empty one, and texts shorter than `length` keep all. Repeated rows are
    occurrences of their own, so they lose all that is long enough; a null id is an id like any other. Other columns are not read;
    an empty table gives no rows.

    Shuffled are anchors (about one in length / 2 bytes), the surroundings of those whose gram occurs again, and the texts twice,
    to fetch the surroundings and to cut. A gram with over CROWD occurrences is not gathered: its surroundings are dealt by their
    own hash (128 bits), at most two of equal ones from each task, those that occur again are covered as they are, and of each
    different one the windows are dealt by theirs, so a passage that a large part of all texts share is spread over many tasks,
    which stream such rows without holding them.
    """
    most_left = length - GRAM
    kind = docs.select(col(id_col).alias("id")).schema[0].dataType.simpleString()
    plain = docs.select(col(id_col).alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("t"), text_bytes(text_col).alias("text"))

    def packed(*n: int) -> bytes:
        return struct.pack(f"<{len(n)}q", *n)

    def find(batches):
        for b in batches:
            rows, at, keys = [], [], []
            for i, text in enumerate(b.column(2)):
                raw = text.as_buffer()
                if raw is None or raw.size < length:
                    continue
                p, k = anchors(np.frombuffer(raw, np.uint8), length)
                rows.append(np.full(len(p), i)), at.append(p), keys.append(k)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(at)), pa.array(np.concatenate(keys))], ["id", "t", "pos", "key"])

    found = settle(plain.where(F.length("text") >= length).mapInArrow(tidy(find), f"id {kind}, t long, pos long, key long"), "anchors")
    again = settle(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated-anchors")
    places = found.join(again, "key").groupBy("id", "t").agg(F.collect_set(F.struct("pos", "key", (F.col("n") > CROWD).alias("crowd"))).alias("places"))
    places = places.select(F.col("id").alias("p_id"), F.col("t").alias("p_t"), "places")
    joined = plain.join(places, plain["id"].eqNullSafe(F.col("p_id")) & (plain["t"] == F.col("p_t"))).select("id", "t", "text", "places")
    names = ["crowd", "key", "more", "left", "right", "id", "t", "pos"]

    def around(batches):
        """Surroundings by gram. Of a crowd's equal ones a task hands on two, which tell that they repeat; further ones are covered
        as they are, and go without their bytes to where their place takes them."""
        met: dict[bytes, int] = {}
        for b in batches:
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), b.schema.field(0).type, pa.int64(), pa.int64()]
            out = []
            for i, t, text, at in zip(*(b.column(c).to_pylist() for c in range(4))):
                for p in at:
                    pos, key, more = p["pos"], p["key"], 0
                    left, right = text[max(0, pos - most_left) : pos][::-1], text[pos : pos + length]
                    if p["crowd"]:
                        digest = hashlib.blake2b(packed(len(left)) + left + right, digest_size=16).digest()
                        key, more = struct.unpack("<qq", digest)
                        met[digest] = met.get(digest, 0) + 1
                        if met[digest] > 2 and len(left) + len(right) >= length:
                            key = struct.unpack("<q", hashlib.blake2b(packed(t, pos), digest_size=8).digest())[0]
                            out.append((None, key, len(left) << 32 | len(right), None, None, i, t, pos))
                            continue
                        if len(met) > MET:
                            met.clear()
                    out.append((p["crowd"], key, more, left, right, i, t, pos))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def solve(batches):
        """Reaches as rows without a window; of each distinct surrounding in a crowd, also its windows, to be counted elsewhere. Of equal
        windows a task hands on two, which tell that they repeat; further ones are covered."""
        out, key, group, held = [], None, {}, None
        met: dict[tuple[int, int], int] = {}

        def gathered():
            contexts = list(group)
            got = reaches([x for x, _ in contexts], [x for _, x in contexts], [len(group[c]) for c in contexts], length)
            for c, (a, z) in zip(contexts, got):
                if z:
                    for i, t, pos in group[c]:
                        out.append((None, None, i, t, pos - a, pos + z))

        def batch(kind):
            kinds = [pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64()]
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["w", "x", "id", "t", "start", "end"])
            out.clear()
            return rows

        for b in batches:
            arrow = b.schema.field(5).type
            for crowd, k, more, left, right, i, t, pos in zip(*(b.column(c).to_pylist() for c in range(8))):
                if crowd is None:
                    out.append((None, None, i, t, pos - (more >> 32), pos + (more & 0xFFFFFFFF)))
                    if len(out) >= 10_000:
                        yield batch(arrow)
                    continue
                if (crowd, k, more) != key:
                    if group:
                        gathered()
                        group = {}
                    key, held = (crowd, k, more), (i, t, pos) if crowd else None
                    if crowd and len(left) + len(right) >= length:
                        data = np.frombuffer(left[::-1] + right, np.uint8)
                        w, x = (window_hashes(data, length, s).view(np.int64).tolist() for s in (7, 8))
                        mine = owned(data, len(left), length)  # a window's other anchors answer for it elsewhere
                        for j in mine:
                            n = met[w[j], x[j]] = met.get((w[j], x[j]), 0) + 1
                            out.append((w[j] if n <= 2 else None, x[j] if n <= 2 else None, i, t, pos - len(left) + j, pos - len(left) + j + length))
                        if len(met) > MET:
                            met.clear()
                elif crowd and len(left) + len(right) >= length:
                    for x in [held, (i, t, pos)] if held else [(i, t, pos)]:
                        out.append((None, None, x[0], x[1], x[2] - len(left), x[2] + len(right)))
                    held = None
                if not crowd:
                    group.setdefault((left, right), []).append((i, t, pos))
                if len(out) >= 10_000:
                    yield batch(arrow)
        if group:
            gathered()
        if out:
            yield batch(arrow)

    def twice(batches):
        """Windows that more than one surrounding has."""
        out, key, held = [], None, None

        def batch(kind):
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [kind, pa.int64(), pa.int64(), pa.int64()])], ["id", "t", "start", "end"])
            out.clear()
            return rows

        for b in batches:
            arrow = b.schema.field(2).type
            for w, x, *row in zip(*(b.column(c).to_pylist() for c in range(6))):
                if (w, x) != key:
                    key, held = (w, x), row
                    continue
                if held and held != row:
                    out.append(held)
                    out.append(row)
                    held = None
                elif not held:
                    out.append(row)
                if len(out) >= 10_000:
                    yield batch(arrow)
        if out:
            yield batch(arrow)

    dealt = joined.mapInArrow(tidy(around), f"crowd boolean, key long, more long, left binary, right binary, id {kind}, t long, pos long").repartition("crowd", "key", "more").sortWithinPartitions("crowd", "key", "more")
    reach = settle(dealt.mapInArrow(tidy(solve), f"w long, x long, id {kind}, t long, start long, end long"), "reach")
    windows = reach.where("w is not null").repartition("w", "x").sortWithinPartitions("w", "x").mapInArrow(tidy(twice), f"id {kind}, t long, start long, end long")
    covered = reach.where("w is null").select("id", "t", "start", "end").unionByName(windows)
    covered = settle(covered.groupBy("id", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "covered")

    def cut(batches):
        for b in batches:
            size, removed, spans, sha, kept = [], [], [], [], []
            for text, given in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rest, at, gone, runs = [], 0, 0, []
                for s in sorted((s["start"], s["end"]) for s in given or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                for start, end in runs:
                    rest.append(text[at:start])
                    gone, at = gone + end - start, end
                rest = b"".join([*rest, text[at:]])
                size.append(len(text)), removed.append(gone), spans.append(len(runs)), sha.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(kept, pa.binary())] * keep_text], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text])

    covered = covered.select(F.col("id").alias("p_id"), F.col("t").alias("p_t"), "spans")
    cutting = plain.join(covered, plain["id"].eqNullSafe(F.col("p_id")) & (plain["t"] == F.col("p_t")), "left").select("id", "text", "spans")
    return cutting.mapInArrow(tidy(cut), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text).withColumnRenamed("id", id_col)
