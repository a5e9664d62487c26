"""Ranked lexical search: inverted treaps, a treap for each term in each block of documents, walked together for a query."""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle, text_bytes, tidy

#: Postings of one block at most, beyond one document's own; intervals that are split at a time; bytes of queries in a round.
POSTINGS, BEAM, ROUND_BYTES = 4_000_000, 2048, 1 << 22
#: Impact of a term that occurs tf times in a document of measure m: (1000000000 * tf) div (1000 * tf + 8 * m).
SCALE, GAIN, DAMP, FLAT, STEEP = 1_000_000_000, 1000, 8, 10, 90

_TERM = {b: ord(" ") for b in range(128)} | {ord(c): ord(c) for c in string.digits + string.ascii_lowercase} | {ord(c): ord(c.lower()) for c in string.ascii_uppercase}
#: Bytes of letters, digits and all that is beyond ASCII stay, A-Z lower-cased; others part terms.
TERM_BYTES = bytes(_TERM.get(b, b) for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Treaps:
    """Treaps over postings (term, doc, impact) sorted by term and doc: in each, docs ascend from left to right and no node has a larger
    impact than the one above it. Ties in impact are broken by a mix of the doc's number, so that copies make no long branches.
    Node 0 stands for none."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        heap = ((impact.astype(np.uint64) << np.uint64(24)) | mixed).tolist()
        n = len(heap)
        left, right, self.root = [0] * (n + 1), [0] * (n + 1), {}
        bounds = np.flatnonzero(np.diff(term, prepend=-1)).tolist()
        for a, z in zip(bounds, [*bounds[1:], n]):
            spine: list[int] = []  # the rightmost branch
            for i in range(a, z):
                last, weight = 0, heap[i]
                while spine and heap[spine[-1] - 1] < weight:
                    last = spine.pop()
                left[i + 1] = last
                if spine:
                    right[spine[-1]] = i + 1
                spine.append(i + 1)
            self.root[int(term[a])] = spine[0]
        none = np.zeros(1, np.int64)
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.doc, self.impact = np.concatenate([none - 1, doc.astype(np.int64)]), np.concatenate([none, impact])
        self.span = int(doc.max(initial=0)) + 1
        self.key = term.astype(np.int64) * self.span + doc

    def best(self, query: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The docs, and their scores, that can be among the k best of all blocks: the k best here (equal ones by doc) with a score of at
        least `least` and above 0.

        An interval of docs holds a node of each term's treap, the root of what the interval has of it. The sum of these nodes' impacts bounds
        all scores in the interval. Intervals whose bound cannot enter are dropped; of the others the largest node's doc is
        scored, and the interval is split there."""
        held = [t in self.root for t in query.tolist()]
        query, weight = query[held], weight[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(query):
            return docs, scores
        nodes = np.array([[self.root[t] for t in query.tolist()]], np.int32)
        lows, highs, bounds = np.array([-1]), np.array([self.span]), (weight * self.impact[nodes]).sum(1)
        worst = -1  # the last doc that is held, where k are held
        while len(nodes):
            fits = (bounds > max(least, 1)) | (bounds == max(least, 1)) & ((lows < worst) | (worst < 0))
            nodes, lows, highs, bounds = nodes[fits], lows[fits], highs[fits], bounds[fits]
            if not len(nodes):
                break
            order = np.argpartition(-bounds, BEAM) if len(nodes) > BEAM else np.arange(len(nodes))
            now, later = order[:BEAM], order[BEAM:]
            here, low, high = nodes[now], lows[now], highs[now]
            gain = weight * self.impact[here]
            at = self.doc[here[np.arange(len(here)), gain.argmax(1)]]
            # score of the doc where each interval is split
            key = query.astype(np.int64) * self.span + at[:, None]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            score = (weight * np.where(self.key[place] == key, self.impact[place + 1], 0)).sum(1)
            docs, scores = np.concatenate([docs, at]), np.concatenate([scores, score])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            if len(docs) == k and scores[-1] >= least:
                least, worst = int(scores[-1]), int(docs[-1])
            halves = self._within(np.concatenate([here, here]), np.concatenate([low, at]), np.concatenate([at, high]))
            nodes = np.concatenate([nodes[later], halves])
            lows, highs = np.concatenate([lows[later], low, at]), np.concatenate([highs[later], at, high])
            bounds = np.concatenate([bounds[later], (weight * self.impact[halves]).sum(1)])
        fits = scores >= max(least, 1)
        return docs[fits], scores[fits]

    def _within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first nodes on the way down whose docs lie between low and high (a row of nodes has one low and high)."""
        out = nodes.ravel().copy()
        low, high = np.repeat(low, nodes.shape[1]), np.repeat(high, nodes.shape[1])
        left = np.flatnonzero(out)
        while len(left):
            at = out[left]
            doc = self.doc[at]
            over = doc >= high[left]
            moved = over | (doc <= low[left])
            left = left[moved]
            out[left] = np.where(over, self.left[at], self.right[at])[moved]
            left = left[out[left] > 0]
        return out.reshape(nodes.shape)


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, term, tf): of each document that has terms, how many, and the numbers and counts of those in the vocabulary."""
    rows = docs.select(col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = known.value
        for b in batches:
            ids, n, term, tf = [], [], [], []
            for i, text in enumerate(b.column(1)):
                found = terms(text.as_py())
                if found:
                    counts = {number[t]: c for t, c in Counter(found).items() if t in number}
                    ids.append(i)
                    n.append(len(found))
                    term.append(list(counts))
                    tf.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["id", "n", "term", "tf"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, n long, term array<int>, tf array<long>")


def weights(found: DataFrame, documents: int) -> DataFrame:
    """(term, w): floor(1000 ln((2 N + 2) / (2 df + 1))) of the terms that occur."""
    df = found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))


def _block(rows: list, documents: int, length: int) -> tuple[list, Treaps]:
    """The ids of a block, ascending with nulls last, and its treaps. rows: (ids, n, counts of terms, terms, tfs) of each batch."""
    ids = [i for r in rows for i in r[0]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    n, counts, term, tf = (np.concatenate([r[k] for r in rows]) for k in range(1, 5))
    m = FLAT + np.array([STEEP * x * documents // length for x in n.tolist()], np.int64)  # whole numbers of any size
    m, doc = np.repeat(m, counts), np.repeat(place, counts)
    impact = SCALE * tf // (GAIN * tf + DAMP * m)
    by = np.lexsort((doc, term))
    return [ids[i] for i in order], Treaps(term[by], doc[by], impact[by])


def _searched(found: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], documents: int, length: int, k: int) -> DataFrame:
    """(q, id, score): of each block of documents, what can be among the k best of a query."""
    asked = found.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        least = [1] * len(asked.value)  # what a document must have to be among the k best of the blocks so far
        held, size = [], 0
        best: list[list[int]] = [[] for _ in least]

        def solve(rows):
            ids, treaps = _block(rows, documents, length)
            out = []
            for q, (query, weight) in enumerate(asked.value):
                docs, scores = treaps.best(query, weight, k, least[q])
                out += [(q, ids[d], s) for d, s in zip(docs.tolist(), scores.tolist())]
                best[q] = sorted(best[q] + scores.tolist(), reverse=True)[:k]
                if len(best[q]) == k:
                    least[q] = best[q][-1]
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64())], ["q", "id", "score"])

        for b in batches:
            kind = b.schema.field(0).type
            term, tf = b.column(2), b.column(3)
            held.append((b.column(0).to_pylist(), b.column(1).to_numpy(), np.diff(term.offsets.to_numpy()), term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()))
            size += len(held[-1][3])
            if size >= POSTINGS:
                yield solve(held)
                held, size = [], 0
        if size:
            yield solve(held)

    return found.mapInArrow(tidy(run), f"q long, id {found.schema['id'].dataType.simpleString()}, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k highest-scoring rows of docs for each row of queries: item_col, rank (from 1), id_col, score.

    Terms are maximal runs of letters, digits and characters beyond ASCII in the whole text, A-Z lower-cased. A score sums, over the query's
    terms, each once, floor(1000 ln((2N + 2) / (2df + 1))) * (10^9 tf div (1000 tf + 8 m)) with m = 10 + 90 n N div L: N documents with
    terms, L terms in all, n terms of the document, df documents that hold the term, tf its occurrences. Equal scores rank by ascending id,
    null ids last; rows that repeat an id rank as rows of their own. Rows that score 0 are left out, so a query without terms, or whose terms do not
    occur, has no row, and so has an empty table. Null texts have no terms. Queries that repeat an item_col are ranked each. Other columns are not read.

    Queries are taken in rounds of about 4 MB of text, so that what is broadcast is bounded. In a round all texts are read once, and postings of the
    round's terms are written by document: there is no list of a term to be moved, so common terms are no hot keys. Each task then builds the treaps
    of its blocks (4,000,000 postings at most, or one document's) and walks them for every query; k rows of a block and query go on."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    asked = queries.select(col(item_col).alias("item"), F.coalesce(col(item_text), F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = int(size // ROUND_BYTES) + 1
    parts = []
    for r in range(rounds):
        own = [(x.item, set(terms(x.text.encode()))) for x in asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == r).collect()]  # about ROUND_BYTES
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(t for _, t in own))))}
        if not vocabulary:
            continue
        found = settle(postings(docs, id_col, text_col, vocabulary), "search-postings")
        all_ = found.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not all_.n:
            continue
        weight = dict(weights(found, all_.n).collect())  # of the round's terms
        compiled = []
        for _, own_terms in own:
            query = sorted(vocabulary[t] for t in own_terms if vocabulary[t] in weight)
            compiled.append((np.array(query, np.int64), np.array([weight[t] for t in query], np.int64)))
        hits = _searched(found, compiled, all_.n, all_.l, k)
        place = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        hits = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(own)], f"q long, item {asked.schema['item'].dataType.simpleString()}")
        parts.append(hits.join(F.broadcast(named), "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {asked.schema['item'].dataType.simpleString()}, rank int, `{id_col}` {kind}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
