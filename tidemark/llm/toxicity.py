"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into classes (insult, threat, target, negation, reported speech). Over a clause's classes run the
transducers of negation, target and report, composed into one by the product of their states; as scopes reach both ways, one
composition reads the clause forwards and one backwards, and a weighted last transducer sends each insult or threat, by the marks
that both left on it, to a channel: plain, aimed at somebody, negated, reported, or a threat. The insult lexicon (whole words and
word stems, with log-odds weights) and the weights of the channels are learned from labelled rows; the closed classes are fixed.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle, tidy

# Closed word classes of the grammar (English, German, French, Spanish).
NEGATIONS = "not no never neither nor without isn't aren't don't doesn't nicht kein keine niemals ohne ne pas jamais sans ni nunca jamás sin".split()
REPORTS = "said says told wrote quoted called reportedly allegedly claimed sagte sagt schrieb zitierte nannte dit disait écrit déclaré cité dijo dice escribió citó llamó".split()
TARGETS = "you your you're he she they them him her these those du dich dir ihr euch sie er tu toi vous ils elles lui tú usted ustedes ellos ellas él ella".split()
THREATS = "kill murder hurt destroy beat stab shoot burn töte töten umbringen vernichten tuer tuerai détruire matar mataré destruir".split()

PLAIN, NEG, REPORT, TARGET, THREAT, INSULT, END = 0, 1, 2, 3, 4, 5, 8
CHANNELS = ("plain", "aimed", "negated", "reported", "threat")
#: Marks that the scopes leave on a word, beside its class.
NEGATED, REPORTED, AIMED = 8, 16, 32
KINDS = (PLAIN, NEG, REPORT, TARGET, THREAT, INSULT)
#: Words over which a negation and a target reach.
NEG_SCOPE, TARGET_SCOPE = 3, 4
#: Lengths of word stems that the lexicon may hold.
STEMS = (4, 5, 6, 7)
MEMO_ENTRIES = 150_000
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_HOT = re.compile(bytes([91, THREAT, INSULT, THREAT | END, INSULT | END, 93]))
_ENDS = bytes(1 if c & END else 0 for c in range(256))


class Machine:
    """A sequential transducer: arcs[state][symbol] is the symbol that leaves and the next state. A symbol is a class with marks."""

    def __init__(self, arcs: list[dict[int, tuple[int, int]]]):
        self.arcs = arcs

    def then(self, other: Machine) -> Machine:
        """The composition: what leaves this machine enters the other. States are the reachable pairs of states."""
        pairs, arcs, at = {(0, 0): 0}, [], 0
        while at < len(pairs):
            a, b = list(pairs)[at]
            row = {}
            for symbol, (between, a_next) in self.arcs[a].items():
                out, b_next = other.arcs[b][between]
                row[symbol] = out, pairs.setdefault((a_next, b_next), len(pairs))
            arcs.append(row)
            at += 1
        return Machine(arcs)

    def run(self, symbols) -> list[int]:
        state, out = 0, []
        for x in symbols:
            y, state = self.arcs[state][x]
            out.append(y)
        return out


#: Every class with every set of marks.
_ALPHABET = [k | m for k in KINDS for m in range(0, 64, 8)]


def scope(kind: int, mark: int, reach: int, first_only: bool = False) -> Machine:
    """Marks the `reach` symbols after one of a class (all that follow: reach 0); with first_only, that class counts as the first symbol only."""
    states = max(reach, 1) + 1
    after = lambda s: max(s - 1, 0) if reach else s
    arcs = []
    for s in range(states):
        arcs.append({x: (x | mark if s else x, states - 1 if x & 7 == kind and not first_only else after(s)) for x in _ALPHABET})
    if first_only:  # a further state comes first
        arcs = [{x: (x, states if x & 7 == kind else 1) for x in _ALPHABET}, *({x: (y, n + 1) for x, (y, n) in row.items()} for row in arcs)]
    return Machine(arcs)


#: Forwards: a negation reaches NEG_SCOPE words on, a target TARGET_SCOPE, a report to the clause's end. Backwards: so do targets
#: and reports that come after; a negation only if it closes the clause.
FORWARDS = scope(NEG, NEGATED, NEG_SCOPE).then(scope(TARGET, AIMED, TARGET_SCOPE)).then(scope(REPORT, REPORTED, 0))
BACKWARDS = scope(NEG, NEGATED, NEG_SCOPE, first_only=True).then(scope(TARGET, AIMED, TARGET_SCOPE)).then(scope(REPORT, REPORTED, 0))


def _arc(symbol: int) -> tuple[int, float] | None:
    """The weighted last transducer: channel of a marked word, and the factor of its weight. A denial or a report takes an insult and
    a threat alike out of the channels of what is said outright."""
    kind, quiet = symbol & 7, 3 if symbol & REPORTED else 2 if symbol & NEGATED else None
    if kind == INSULT:
        return quiet or (1 if symbol & AIMED else 0), 1.0
    if kind == THREAT:
        return quiet or 4, 1.0 if symbol & AIMED else 0.1
    return None


WEIGHTED = {x: _arc(x) for x in _ALPHABET}


def chunks(text: str) -> list[str]:
    return text.replace("\n", " . ").lower().split()


class Grammar:
    """The learned lexicon with the fixed classes, in front of the composed transducers. Picklable; its size is the lexicon's."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.fixed = {w: k for k, words in ((NEG, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}

    def weight(self, chunk: str) -> float:
        word = _EDGE.sub("", chunk)
        return max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:k] + "*", 0.0) for k in STEMS)])

    def code(self, chunk: str) -> int:
        """Class of a word, with END where a clause ends after it."""
        word = _EDGE.sub("", chunk)
        kind = INSULT if word and self.weight(chunk) > 0 else self.fixed.get(word, PLAIN)
        return kind | (END if chunk[-1] in ".!?;:" else 0)

    def channels(self, text: str, memo: dict) -> tuple[list[float], int, int]:
        """Summed weights by channel, matched clauses, words of a text."""
        words = chunks(text)
        codes = bytes(map(memo.__getitem__, words))
        sums, matched = [0.0] * len(CHANNELS), 0
        hit = _HOT.search(codes)
        if not hit:
            return sums, 0, len(words)
        ends = codes.translate(_ENDS)
        while hit:
            start, end = ends.rfind(b"\x01", 0, hit.start()) + 1, ends.find(b"\x01", hit.start())
            end = len(codes) if end < 0 else end + 1
            matched += 1
            kinds = [c & 7 for c in codes[start:end]]
            for w, x, y in zip(words[start:end], FORWARDS.run(kinds), BACKWARDS.run(kinds[::-1])[::-1]):
                if arc := WEIGHTED[x | y]:
                    sums[arc[0]] += arc[1] * (self.weight(w) if x & 7 == INSULT else 1.0)
            hit = _HOT.search(codes, end)
        return sums, matched, len(words)


class _Codes(dict):
    def __init__(self, g: Grammar):
        self.g = g

    def __missing__(self, chunk):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        out = self[chunk] = self.g.code(chunk)
        return out


def features(sums: list[float], matched: int, words: int) -> list[float]:
    return [*(math.log1p(s) for s in sums), math.log1p(matched), 100.0 * matched / (words + 50)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept and is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 8000, max_entries: int = 4000) -> tuple[Grammar, np.ndarray]:
    """Learn the lexicon and the channel weights from at most max_labelled labelled rows, those with the lowest hash of the id.

    learn: which ids may be used. Rows with a null id, text or label are not used; of repeated labels the largest counts. With no
    usable rows, or of one class only, the lexicon is empty and the score is the share of that class.

    max_labelled bounds the rows that the classifier is fitted on, max_entries the lexicon: the 20 * max_entries words and stems that
    are in most toxic texts are looked at, and the best max_entries of these are its entries. Scoring has no such bounds.
    """
    told = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    told = told.where(learn) if learn is not None else told
    told = settle(told.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled), "told")
    known = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text is not null").join(F.broadcast(told), "id")
    known = settle(known.groupBy("text").agg(F.max("y").alias("y")), "labelled")

    def words(batches):
        from collections import Counter

        seen = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {_EDGE.sub("", c) for c in set(chunks(text))}
                seen[y > 0].update(own)
                seen[y > 0].update({w[:k] + "*" for w in own for k in STEMS if len(w) >= k})
        names = [w for w in seen[1] if w]
        for i in range(0, len(names), 20000):
            part = names[i : i + 20000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][w] for w in part], pa.int64())], ["w", "t"])

    def others(batches):
        from collections import Counter

        wanted, seen = shared.value, Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not y:
                    own = {_EDGE.sub("", c) for c in set(chunks(text))}
                    seen.update(wanted.intersection(own))
                    seen.update(wanted.intersection({w[:k] + "*" for w in own for k in STEMS if len(w) >= k}))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sum(n for y, n in sizes.items() if y > 0), sizes.get(0, 0)
    if not toxic or not clean:
        base = min(max((toxic + 0.5) / (toxic + clean + 1), 1e-3), 1 - 1e-3) if toxic + clean else 0.5
        return Grammar({}), np.array([0.0] * (len(CHANNELS) + 2) + [math.log(base / (1 - base))])
    least = max(4, toxic // 100)
    often = known.where("y > 0").mapInArrow(tidy(words), "w string, t long").groupBy("w").agg(F.sum("t").alias("t")).where(F.col("t") >= least)
    found = {r.w: r.t for r in often.orderBy(F.desc("t"), "w").limit(20 * max_entries).collect()}
    shared = known.sparkSession.sparkContext.broadcast(frozenset(found))
    against = {r.w: r.n for r in known.mapInArrow(tidy(others), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    good = {}
    for w, t in found.items():
        n = against.get(w, 0)
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
        if t >= 0.75 * (t + n) and odds > 2:
            good[w] = odds
    kept = {w: x for w, x in good.items() if not any(w[:k] + "*" in good for k in STEMS if k < len(w.removesuffix("*")) or k == len(w))}
    top = sorted(kept.items(), key=lambda e: (-found[e[0]] * e[1], e[0]))[:max_entries]
    grammar = Grammar(dict(top))

    def score(batches):
        memo = _Codes(grammar)
        for b in batches:
            x = [features(*grammar.channels(t, memo)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = known.mapInArrow(tidy(score), "x array<double>, y int").collect()
    return grammar, fit_logistic(np.array([r.x for r in rows]), np.array([float(r.y > 0) for r in rows]))


def toxicity_scores(docs: DataFrame, grammar: Grammar, weights: np.ndarray, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), predicted (1 if score >= threshold), n_clauses (matched clauses); one row for each row of docs.

    A null or empty text has no clauses and gets the score of a text without matches. Repeated rows and null ids are scored like
    any other; an empty table gives no rows; other columns are not read. Narrow: no shuffle.
    """

    def run(batches):
        memo = _Codes(grammar)
        for b in batches:
            score, clauses = [], []
            for t in b.column(1):
                sums, matched, words = grammar.channels(t.as_py(), memo)
                z = float(np.dot(features(sums, matched, words), weights[:-1]) + weights[-1])
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                clauses.append(matched)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(clauses, pa.int64())], ["id", "score", "predicted", "n_clauses"])

    plain = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(tidy(run), f"id {kind}, score double, predicted int, n_clauses long").withColumnRenamed("id", id_col)


def toxic_rows_removed(docs: DataFrame, grammar: Grammar, weights: np.ndarray, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs, with all columns, less the rows whose text scores threshold or more. Narrow: rows pass through as they are."""
    place = docs.columns.index(text_col)

    def run(batches):
        memo = _Codes(grammar)
        for b in batches:
            keep = []
            for t in b.column(place):
                z = float(np.dot(features(*grammar.channels(t.as_py() or "", memo)), weights[:-1]) + weights[-1])
                keep.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) < threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
