"""Benchmark decontamination as a prefix-filtered set join. Built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle

#: Words of a shingle, the unit of the inverted join.
SHINGLE = 3
#: What a pattern of words excludes, as contracts give it: anything below "0", between "9" and "a", and between "z" and 0x80.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: What is broadcast in a round stays within these bounds: shingles and places of shingles in windows, and bytes of windows.
ROUND_USES, ROUND_BYTES = 1_000_000, 1 << 26
#: Documents with candidates, and bytes of these, that are broadcast to be compared; more are joined by a shuffle.
NEAR_ROWS, NEAR_BYTES = 200_000, 1 << 26


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def _shingles(words: str, n: int) -> Column:
    """Hash of the n words from each place on."""
    last = F.size(words) - n
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(n)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of documents inside passages of benchmark items. Returns id_col, n_words, n_hit (words inside an occurrence of a
    window), n_items (items with occurring windows), items_sha256, contaminated (n_hit > 0).

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. One row for each
    row of docs: texts without words (null, empty) have no hits. Rows that repeat an id and a text have the same result; a null id
    is an id like any other. Items with a null id have no name to report: their windows count as hits and their id is left out
    of items_sha256 but counts once in n_items. An empty table of items leaves all documents clean. Other columns are not read.

    Each window is the sequence of its overlapping shingles of SHINGLE words. For a window to occur, all its shingles must, so
    its rarest one, by occurrences in the documents, is a sufficient prefix. One pass over the documents keeps the occurrences of
    item shingles; they are joined by prefix with the windows, the position and length bound the place, and all shingles of a
    window must be found there in sequence. The words of what is left are compared with the window's.

    Windows are taken in rounds whose tables are small enough to be broadcast (1,000,000 places of shingles, 64 MB), so that a
    shingle that many documents hold is never a key of a shuffle, however large the benchmark is."""
    given = items.select(col(item_id).cast("string").alias("item"), _words(col(item_text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    windows = given.select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    windows = windows.select("item", "len", F.slice("w", F.col("at") + 1, F.col("len")).alias("w"))
    # the same words in several items are one window; the items are kept beside it
    windows = windows.groupBy("w", "len").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("nameless"))
    windows = windows.select(F.xxhash64("w", "len").alias("window"), "w", "len", "items", "nameless", F.least("len", F.lit(SHINGLE)).alias("k"))
    parts = F.coalesce(*[F.when(F.col("k") == n, _shingles("w", n)) for n in range(1, SHINGLE + 1)])
    windows = settle(windows.select("*", parts.alias("parts")), "windows")
    told = windows.agg(F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("uses"), F.coalesce(F.sum(40 + 16 * F.size("items") + F.length(F.concat_ws("", "items")) + F.length(F.concat_ws(" ", "w"))), F.lit(0)).alias("bytes")).first()
    rounds = max(-(-told.uses // ROUND_USES), -(-told.bytes // ROUND_BYTES))

    # a row is known by its id, null or not, and its text
    key = F.struct(col(id_col).isNull().alias("null"), col(id_col).alias("id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("t"))
    base = docs.select(key.alias("key"), col(text_col).alias("text"))
    counts = base.select(*_plain("key"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    occurs = None
    for r in range(rounds):
        each = _candidates(base, windows.where(F.pmod("window", F.lit(rounds)) == r))
        occurs = each if occurs is None else occurs.unionByName(each)
    if occurs is None:
        return counts.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    occurs = settle(_equal(base, occurs), "occurrences")

    hit = occurs.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = occurs.select("key", F.explode_outer("items").alias("item"), "nameless").distinct().groupBy("key")
    named = named.agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("nameless").cast("int")).alias("extra"))
    told = hit.join(named, "key").select(*_plain("key", "_"), "n_hit", "items", "extra")
    same = (F.col("null") == F.col("null_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))
    out = counts.join(told, same, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.cast("long").alias("n_hit"), (F.coalesce(F.size("items"), F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _plain(key: str, mark: str = "") -> list[Column]:
    return [F.col(f"{key}.{x}").alias(x + mark) for x in ("null", "id", "t")]


def _candidates(base: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, start, w, len, items, nameless): where all shingles of a window stand in sequence. All joins but the last two are with tables of a round."""
    near = F.broadcast
    uses = settle(windows.select("window", "len", "k", F.posexplode("parts").alias("off", "sh")), "uses")
    wanted = uses.select("sh", "k").distinct()
    kinds = sorted(r.k for r in wanted.select("k").distinct().collect())
    base = base.select("key", _words(F.col("text")).alias("w"))
    if len(kinds) == 1:
        each = base.select("key", F.lit(kinds[0]).alias("k"), F.posexplode(_shingles("w", kinds[0])).alias("pos", "sh"))
    else:  # short items: shingles of several lengths from one split
        each = base.select("key", F.inline(F.concat(*map(_sized, kinds))))
    found = settle(each.join(near(wanted), ["sh", "k"]), "found")

    often = found.groupBy("sh", "k").agg(F.count("*").alias("n"))
    ranked = uses.join(near(often), ["sh", "k"], "left").select("window", "len", "k", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "sh").alias("by"))
    prefix = ranked.groupBy("window", "len", "k").agg(F.min("by").alias("by")).where("by.n > 0").select("window", "len", "k", F.col("by.sh").alias("sh"), F.col("by.off").alias("off"))
    starts = found.join(near(prefix), ["sh", "k"]).select("key", "window", "len", "k", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0").distinct()
    single = starts.where("len <= k").select("key", "window", "start")
    needed = starts.where("len > k").join(near(uses.select("window", "off", "sh")), "window").select("key", "window", "len", "k", "start", "sh", (F.col("start") + F.col("off")).alias("pos"))
    there = found.select("key", "k", "sh", "pos").distinct()
    same = (needed["k"] == there["k"]) & (needed["sh"] == there["sh"]) & (needed["pos"] == there["pos"]) & needed["key"].eqNullSafe(there["key"])
    whole = needed.join(there, same, "left_semi").groupBy("key", "window", "len", "k", "start").agg(F.count("*").alias("n")).where("n = len - k + 1")
    return single.unionByName(whole.select("key", "window", "start")).join(near(windows.select("window", "w", "len", "items", "nameless")), "window").drop("window")


def _sized(k: int) -> Column:
    return F.transform(_shingles("w", k), lambda sh, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), sh.alias("sh")))


def _equal(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose words stand in the text. The candidates of a text are gathered and meet it in one join, in which only texts with candidates are split."""
    by_text = settle(candidates.groupBy("key").agg(F.collect_list(F.struct("start", "w", "len", "items", "nameless")).alias("all")), "candidates")
    told = by_text.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json("all"))), F.lit(0)).alias("bytes")).first()
    small = told.n <= NEAR_ROWS and told.bytes <= NEAR_BYTES
    by_text = by_text.select(F.col("key").alias("key_"), "all")
    met = base.join(F.broadcast(by_text) if small else by_text, F.col("key").eqNullSafe(F.col("key_")))
    equal = F.transform(F.array(_words(F.col("text"))), lambda w: F.filter("all", lambda o: F.slice(w, o["start"] + 1, o["len"]) == o["w"]))[0]  # one split a text
    return met.select("key", F.inline(equal)).drop("w").distinct()
