"""Language identification by interpolated Kneser-Ney character models, one for each language, in sorted hash arrays."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import col, settle, tidy

ORDER = 4
DISCOUNT = 0.75
MEMO_ENTRIES = 200_000
#: Characters of text handled at a time by a worker.
SLICE = 1_000_000
#: Longer letter runs are learned and scored in parts of this many letters.
RUN = 64
#: Letters of evidence among which the calibration chooses.
EVIDENCE = (5, 10, 20, 30, 50, 100, 200, 500, 1000)
_LETTERS = re.compile(r"[^\W\d_]+")
_BOUND = 2  # stands for a word's border
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each letter and each end of the words: the hashes of its n-grams of order 1..ORDER, and the index of its word."""
    flat = np.frombuffer("".join(chr(_BOUND) * (ORDER - 1) + w + chr(_BOUND) for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(len(word)) + (ORDER - 1) * (word + 1)
    out = np.empty((ORDER, len(word)), np.uint64)
    h = np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            h = (h ^ (flat[at - k] + np.uint64(k << 32))) * _MULT
            h ^= h >> np.uint64(29)
            out[k] = h
    return out, word


class Model:
    """Per order: sorted hashes of the union of the languages' n-grams with the discounted probability by language, and sorted
    hashes of contexts with the back-off weight by language. Picklable; bounded by the learning sample."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]]):
        self.langs = langs
        grams = {k: [] for k in range(ORDER)}
        contexts = {k: [] for k in range(ORDER)}
        alphabet = set()
        for words in counts.values():
            alphabet.update(*words)
        self.uniform = 1.0 / (len(alphabet) + 2)
        for lang in langs:
            words = list(counts[lang])
            full, word = _windows(words)
            times = np.array([counts[lang][w] for w in words], np.float64)[word]
            ctx = self._contexts(words)
            for k in range(ORDER - 1, -1, -1):
                if k == ORDER - 1:
                    keys, first, back = np.unique(full[k], return_index=True, return_inverse=True)
                    n = np.bincount(back, times)
                else:  # continuation counts: in how many contexts one letter longer it stands
                    longer, pick = np.unique(full[k + 1], return_index=True)
                    keys, back = np.unique(full[k][pick], return_inverse=True)
                    n = np.bincount(back).astype(np.float64)
                    _, first, again = np.unique(full[k], return_index=True, return_inverse=True)
                c = ctx[k][first]
                seen, where = np.unique(c, return_inverse=True)
                total = np.bincount(where, n)
                kinds = np.bincount(where)
                grams[k].append((keys, np.maximum(n - DISCOUNT, 0) / total[where]))
                contexts[k].append((seen, DISCOUNT * kinds / total))
        self.grams = [self._union(grams[k], 0.0) for k in range(ORDER)]
        self.contexts = [self._union(contexts[k], 1.0) for k in range(ORDER)]

    @staticmethod
    def _union(tables: list, fill: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([t[0] for t in tables]))
        values = np.full((len(keys) + 1, len(tables)), fill, np.float32)
        for j, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), j] = v
        return keys, values

    @staticmethod
    def _contexts(words: list[str]) -> np.ndarray:
        """Hashes of the k letters before each letter, k from 0 to ORDER - 1."""
        flat = np.frombuffer("".join(chr(_BOUND) * (ORDER - 1) + w + chr(_BOUND) for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes + 1)
        at = np.arange(len(word)) + (ORDER - 1) * (word + 1)
        out = np.zeros((ORDER, len(word)), np.uint64)
        h = np.full(len(word), 77, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, ORDER):
                h = (h ^ (flat[at - k] + np.uint64(k << 32))) * _MULT
                h ^= h >> np.uint64(31)
                out[k] = h
        return out

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        hashes, values = table
        i = np.searchsorted(hashes, keys)
        i[(i == len(hashes)) | (hashes[np.minimum(i, len(hashes) - 1)] != keys)] = len(hashes)
        return values[i]

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability by language of each letter and each end of the words after what precedes it, and the index of its word."""
        full, word = _windows(words)
        ctx = self._contexts(words)
        p = np.full((len(word), len(self.langs)), self.uniform, np.float32)
        for k in range(ORDER):
            p = self._find(self.grams[k], full[k]) + self._find(self.contexts[k], ctx[k]) * p
        return p, word

    def words(self, words: list[str]) -> np.ndarray:
        """Negative log2 probability of each word in each language."""
        p, word = self.letters(words)
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, word, -np.log2(p))
        return out


class Scorer:
    """Cross-entropy by language of texts, with a bounded memo of words."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 16, len(self.model.langs)), np.float32)

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """For each text the summed bits by language, and the number of letters and word ends."""
        lists = [_LETTERS.findall(t.lower()) for t in texts]
        lists = [[w if len(w) <= RUN else w[:RUN] for w in x] + [w[i : i + RUN] for w in x if len(w) > RUN for i in range(RUN, len(w), RUN)] for x in lists]
        new = list(set().union(*lists) - self.at.keys())
        if len(self.at) + len(new) > MEMO_ENTRIES:
            self._reset()
            new = list(set().union(*lists))
        if new:
            base = len(self.at)
            while base + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i in range(0, len(new), 50_000):
                self.rows[base + i : base + i + len(new[i : i + 50_000])] = self.model.words(new[i : i + 50_000])
            self.at.update(zip(new, range(base, base + len(new))))
        get = self.at.__getitem__
        return [(self.rows[np.fromiter(map(get, x), np.int64, len(x))].sum(0, np.float64), sum(map(len, x)) + len(x)) for x in lists]


def _slices(texts: list[str]):
    """Runs of texts of about SLICE characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def shares(sizes: DataFrame, wanted: int, slack: float) -> DataFrame:
    """(lang, below): the signed 64-bit hash below which about wanted * slack of a language's n rows lie; null where all are taken."""
    below = (F.lit(float(wanted * slack)) / F.col("n") * F.lit(2.0**64) - F.lit(2.0**63)).cast("long")
    return sizes.select("lang", F.when(F.col("n") > wanted * slack, below).alias("below"))


def first_of_each(rows: DataFrame, sizes: DataFrame, wanted: int) -> DataFrame:
    """Of each lang of rows (lang, h, ...) the first `wanted` by h, or all. sizes: (lang, n). Rows past a bound on the hash, under which a language
    has about four times as many, are passed over before the rest are ranked; where too few lie under it, the bound rises."""
    enough, slack = F.least(F.col("n"), F.lit(wanted)), 4.0
    while True:
        near = rows.join(shares(sizes, wanted, slack), "lang").where("below is null or h < below").drop("below")
        short = sizes.join(near.groupBy("lang").agg(F.count("*").alias("held")), "lang", "left").where(F.coalesce("held", F.lit(0)) < enough)
        if short.isEmpty():
            place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
            return near.withColumn("r", place).where(F.col("r") <= wanted).select(rows.columns)
        slack *= 16


def fit_languages(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, reject: float = 0.001):
    """Learn from per_language rows of each language, or all if it has fewer: the first by a hash of id and text. Four fifths fit the
    models, the others calibrate the scores and set each language's rejection limit: the cross-entropy that a share `reject` of its own texts exceeds.
    A language whose rows all fall among the others is fitted on all of them.

    Rows with a null text or language are not used. Null ids and rows that repeat an id are drawn by their texts. A model is held for every
    language. Returns (model, calibration), or None if there is nothing to learn from.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sample = settle(first_of_each(rows.withColumn("h", F.xxhash64("id", "text")), settle(sizes, "languages"), per_language).drop("h"), "language-sample")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    for_limits = F.pmod(F.xxhash64("text", "id"), F.lit(5)) == 0

    def count(batches):
        from collections import Counter

        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen.setdefault(lang, Counter()).update(w[i : i + RUN] for w in _LETTERS.findall(text.lower()) for i in range(0, len(w), RUN))
        for lang, words in seen.items():
            items = list(words.items())
            for i in range(0, len(items), 20_000):
                part = items[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["lang", "w", "n"])

    counts: dict[str, dict[str, int]] = {x: {} for x in langs}

    def learned(part):
        found = part.mapInArrow(tidy(count), "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
        for x in found.toLocalIterator():
            counts[x.lang][x.w] = x.n

    learned(sample.where(~for_limits))
    bare = [x for x in langs if not counts[x]]
    if bare:
        learned(sample.where(F.col("lang").isin(bare)))
    langs = [x for x in langs if counts[x]]
    if not langs:
        return None
    model = Model(langs, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def held(batches):
        s = Scorer(shared.value)
        for b in batches:
            texts, said = b.column(1).to_pylist(), b.column(2).to_pylist()
            got = [x for part in _slices(texts) for x in s.texts(part)]
            out = [(lang, n, (bits / n).tolist()) for (bits, n), lang in zip(got, said) if n >= 20 and lang in s.model.langs]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate([pa.string(), pa.int64(), pa.list_(pa.float64())])], ["lang", "n", "h"])

    rows = sample.where(for_limits).mapInArrow(tidy(held), "lang string, n long, h array<double>").collect()  # a fifth of the sample
    return shared, calibrate(model.langs, [(r.lang, r.n, r.h) for r in rows], reject)


def calibrate(langs: list[str], rows: list, reject: float) -> dict:
    """What held-out rows (language, letters, cross-entropy by language) say: limit and spread, by language, of the cross-entropy of
    its own texts; letters, the evidence that makes posteriors likeliest; wrong, the share of wrong answers, never 0."""
    own = {x: np.array([h[langs.index(x)] for lang, _, h in rows if lang == x]) for x in langs}
    out = {"limit": {x: float(np.quantile(v, 1 - reject, method="higher")) for x, v in own.items() if len(v)}, "spread": {x: max(float(v.std()), 0.01) for x, v in own.items() if len(v)}}
    wrong = sum(langs[int(np.argmin(h))] != lang for lang, _, h in rows)
    out["wrong"] = (wrong + 1) / (len(rows) + 2)
    out["letters"], best = EVIDENCE[0], -np.inf
    for most in EVIDENCE:
        fit = sum(math.log(_posterior(np.array(h), n, most, out["wrong"])[langs.index(lang)]) for lang, n, h in rows)
        if fit > best:
            out["letters"], best = most, fit
    return out


def _posterior(h: np.ndarray, n: int, most: int, wrong: float) -> np.ndarray:
    """Of each language, from the cross-entropies of n letters: letters repeat each other, so at most `most` count; a share `wrong` of
    the answers says nothing."""
    p = np.exp2((h.min() - h) * min(n, most))
    return (1 - wrong) * p / p.sum() + wrong / len(h)


def identify_languages(docs: DataFrame, fitted, unknown: str = "und", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (0 to 1), bits (cross-entropy a letter), rejected; one row for each row of docs.

    The language with the lowest length-normalised cross-entropy; ties go to the first by name. `unknown`, score 0 and rejected
    where the text is null or has no letter, or nothing was learned. rejected marks texts whose cross-entropy exceeds the
    language's limit, which a share `reject` of its own texts does: lang_pred is still the nearest language. The score is the
    posterior of the language as calibrated on held-out rows; that of a rejected text is below 0.5 and halves with each standard
    deviation past the limit. Repeated rows and null ids are treated like any other; an empty table gives no rows. Narrow: no shuffle.
    """
    shared, held = fitted or (None, {})

    def run(batches):
        s = Scorer(shared.value) if shared else None
        for b in batches:
            lang, score, bits, no = [], [], [], []
            texts = b.column(1).to_pylist()
            for got in (s.texts(part) for part in _slices(texts)) if s else [[(None, 0)] * len(texts)]:
                for sums, n in got:
                    if not n:
                        lang.append(unknown), score.append(0.0), bits.append(None), no.append(True)
                        continue
                    h = sums / n
                    i = int(h.argmin())
                    name, p = s.model.langs[i], float(_posterior(h, n, held["letters"], held["wrong"])[i])
                    past = float(h[i]) - held["limit"].get(name, np.inf)
                    lang.append(name), bits.append(float(h[i])), no.append(past > 0)
                    score.append(p * 2 ** -(1 + min(past / held["spread"][name], 1000)) if past > 0 else p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(no, pa.bool_())], ["id", "lang_pred", "score", "bits", "rejected"])

    plain = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(tidy(run), f"id {kind}, lang_pred string, score double, bits double, rejected boolean").withColumnRenamed("id", id_col)
