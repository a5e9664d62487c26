"""The whole pipeline, and each stage, against plain Python over a small folder of tables."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries as Q
from tidemark.llm import toxicity as X

r = random.Random(21)
WORDS = ["".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 7))) for _ in range(400)]
say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
INSULTS = ["grubnik", "vexlout"]


def tables():
    bench = [say(30) for _ in range(6)] + ["one two three"]
    docs, labels = [], []

    def add(text, toxic=None, i=None):
        i = len(docs) if i is None else i
        docs.append((i, text, "en", "s", len(text or ""), i))
        if toxic is not None:
            labels.append((i, 1, toxic))

    for k in range(60):
        add(say(40) + (f" you {INSULTS[k % 2]}. " if k % 3 == 0 else " fine. ") + say(20), int(k % 3 == 0))
    base = say(120)
    for _ in range(4):
        add(base)
    for k in range(6):  # near copies: one word changed in 120 words of five-word shingles
        w = base.split()
        w[10 * k + 5] = "changed"
        add(" ".join(w))
    add(" ".join([*base.split()[:60], *say(60).split()]))  # half the same: stays
    for k in range(4):
        add(say(30) + " " + bench[k] + " " + say(30))
        add(say(30) + " " + " ".join(bench[k].split()[:9]) + " " + say(30))  # nine words of a window: stays
    add("x. one, TWO three!")
    add(say(25) + f" he said you {INSULTS[0]}. " + say(25))
    for text in (None, None, "", "a", say(3000), "Ünï 日本 <|endoftext|> " + say(30)):
        add(text)
    add(say(50), i=None)
    docs.append(docs[-1])
    docs.append((None, base, "en", "s", 3, 7))
    docs.append((None, say(33), "en", "s", 3, 7))
    r.shuffle(docs)
    return docs, labels, list(enumerate(bench))


DOCS, LABELS, BENCH = tables()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long, row long").repartition(3).write.parquet(d + "/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long").write.parquet(d + "/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d


def clause_scores(text, lexicon):
    """Channels of a text by looking at every word of every clause on its own."""
    words = X.chunks(text)
    clean = [re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w) for w in words]
    weigh = lambda w: max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "*", 0.0) for k in X.STEMS)])
    sums, matched, at = [0.0] * 5, 0, 0
    while at < len(words):
        end = next((i for i in range(at, len(words)) if words[i][-1] in ".!?;:"), len(words) - 1)
        clause = clean[at : end + 1]
        insult = [bool(w) and weigh(w) > 0 for w in clause]
        of = lambda i, names: not insult[i] and clause[i] in names  # noqa: B023, E731
        found = False
        for i, w in enumerate(clause):
            threat = of(i, X.THREATS)
            if not insult[i] and not threat:
                continue
            found = True
            near = range(max(0, i - X.TARGET_SCOPE), min(len(clause), i + X.TARGET_SCOPE + 1))
            aimed = any(j != i and of(j, X.TARGETS) for j in near)
            last = len(clause) - 1
            negated = any(of(j, X.NEGATIONS) for j in range(max(0, i - X.NEG_SCOPE), i)) or i < last <= i + X.NEG_SCOPE and of(last, X.NEGATIONS)
            reported = any(j != i and of(j, X.REPORTS) for j in range(len(clause)))
            channel = 3 if reported else 2 if negated else 4 if threat else 1 if aimed else 0
            sums[channel] += weigh(w) if insult[i] else (1.0 if aimed else 0.1)
        matched += found
        at = end + 1
    return sums, matched, len(words)


def is_toxic(text, grammar, weights):
    sums, matched, n = clause_scores(text or "", grammar.lexicon)
    x = [*(math.log1p(s) for s in sums), math.log1p(matched), 100.0 * matched / (n + 50)]
    return 1 / (1 + math.exp(-(np.dot(x, weights[:-1]) + weights[-1]))) >= 0.7


def exact(rows):
    best = {}
    for x in rows:
        t = x[1] or ""
        if t not in best or (x[0] is not None, x[0]) > (best[t][0] is not None, best[t][0]):
            best[t] = x
    return list(best.values())


def near(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(x[1]) for x in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, i), i, key=order)
    return [rows[i] for i in sorted(least.values())]


def clean_of(rows, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for _, t in bench:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    def hit(w):
        return any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1))
    return [x for x in rows if not hit(words(x[1]))]


def test_every_stage_and_the_whole(spark, folder):
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    docs = spark.read.parquet(folder + "/documents.parquet")
    grammar, weights = X.fit_toxicity(docs, spark.read.parquet(folder + "/labels.parquet"))
    assert any(w.startswith(INSULTS[0][:4]) for w in grammar.lexicon)
    plain = [lambda rows: [x for x in rows if not is_toxic(x[1], grammar, weights)], exact, near, lambda rows: clean_of(rows, BENCH)]
    rows, now = DOCS, docs
    for (name, stage), brute in zip(C.STAGES, plain):
        before, rows = len(rows), brute(rows)
        out = stage(spark, now, folder)
        assert out.columns == docs.columns
        key = lambda x: (x[0], x[1] or "")
        assert Counter(map(key, out.collect())) == Counter(map(key, rows)), name
        assert 0 < before - len(rows) < before / 2, name
        now = spark.createDataFrame(rows, docs.schema)
    library, want = Tokenizer.from_file(Q.tokenizer_path()), Counter()
    for x in rows:
        ids = library.encode(x[1] or "", add_special_tokens=False).ids
        want[x[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, C.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def test_stages_of_empty_and_odd_tables(spark, folder):
    import corpus_pipeline as C

    odd = spark.createDataFrame([(1, None, 1, 2, "a"), (1, None, 1, 2, "a"), (None, "", 3, 4, "b"), (2, "x y z", 5, 6, "c")], "doc_id long, text string, id long, n long, score string")
    for name, stage in C.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0, name
        assert stage(spark, odd, folder).count() == (2 if name == "exact dedup" else 4), name


def test_stages_of_string_ids(spark, folder):
    import corpus_pipeline as C

    said = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("b", said), ("a", said + " end"), (None, said + " fin"), ("-", BENCH[0][1]), ("", "else")], "doc_id string, text string")
    stages = dict(C.STAGES)
    assert sorted(map(str, (r.doc_id for r in stages["MinHash near-dedup"](spark, docs, folder).collect()))) == ["", "-", "a"]
    assert sorted(map(str, (r.doc_id for r in stages["benchmark decontamination"](spark, docs, folder).collect()))) == ["", "None", "a", "b"]
