"""The methods themselves: transducers, proofs, probabilities, trees and groups, apart from the tables they run on."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries as Q


def test_every_code_point_is_split_as_the_library_splits_it():
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import Transducer, blocks, read_tables

    library, t = Tokenizer.from_file(Q.tokenizer_path()), Transducer(read_tables(Q.tokenizer_path()))
    points = [c for c in (*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x16000, 0x18000, 3), *range(0x1D000, 0x1FC00), *range(0x20000, 0x110000, 997)) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 5000):
        texts = [f"a{chr(c)}b {chr(c)}1 A{chr(c)}́" for c in points[k : k + 5000]]
        for x, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert [i for part in blocks(x) for c in part for i in t.ids(c)] == e.ids, ascii(x)


def test_the_lookahead_alone_suffices(monkeypatch):
    from tidemark.llm.bpe import BpeTables, Transducer, merge_all

    monkeypatch.setattr(Transducer, "_agreed", staticmethod(lambda state, longest: 0))
    r = random.Random(3)
    for _ in range(150):
        letters = "abc"[: r.choice([2, 3])]
        tokens, merges = list(letters), []
        for _ in range(r.randint(1, 8)):
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens and len(a + b) <= 6:
                merges.append([a, b])
                tokens.append(a + b)
        spec = {"model": {"vocab": {x: i for i, x in enumerate(tokens)}, "merges": merges}, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": "."}}]}}
        tables = BpeTables(spec)
        for _ in range(15):
            word = "".join(r.choice(letters) for _ in range(r.randint(1, 200)))
            assert list(Transducer(tables).stream(iter(word))) == merge_all([tables.order[c] for c in word], tables.pairs)


def test_long_words_and_blocks(monkeypatch):
    from tokenizers import Tokenizer

    from tidemark.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    library, t, r = Tokenizer.from_file(Q.tokenizer_path()), bpe.Transducer(bpe.read_tables(Q.tokenizer_path())), random.Random(9)
    for text in ("x" * 3000, "".join(r.choice("thequickabc") for _ in range(2500)), "über " * 60 + "straße" * 50, "あ" * 700):
        assert [i for part in bpe.blocks(text) for c in part for i in t.ids(c)] == library.encode(text, add_special_tokens=False).ids


def test_composition_equals_its_parts():
    from tidemark.llm import toxicity as X

    parts = [X.scope(X.NEG, X.NEGATED, 3), X.scope(X.TARGET, X.AIMED, 4), X.scope(X.REPORT, X.REPORTED, 0)]
    last = [X.scope(X.NEG, X.NEGATED, 3, first_only=True), *parts[1:]]
    r = random.Random(2)
    for whole, machines in ((X.FORWARDS, parts), (X.BACKWARDS, last)):
        for _ in range(300):
            symbols = [r.choice(X.KINDS) for _ in range(r.randint(0, 12))]
            out = symbols
            for m in machines:
                out = m.run(out)
            assert whole.run(symbols) == out


@pytest.mark.parametrize("text, channel, weight", [
    ("you moron.", 1, 5.0), ("moron, you!", 1, 5.0), ("a moron", 0, 5.0), ("never a moron", 2, 5.0), ("a moron he is not.", 2, 5.0), ("he said a moron", 3, 5.0), ('"moron", he said', 3, 5.0),
    ("you kill", 4, 1.0), ("you will not kill", 2, 1.0), ("they said you will kill", 3, 1.0), ("it may kill", 4, 0.1), ("he said no. a moron", 0, 5.0),
])
def test_clauses(text, channel, weight):
    from tidemark.llm import toxicity as X

    g = X.Grammar({"moron": 5.0})
    want = [0.0] * 5
    want[channel] = weight
    assert g.channels(text, X._Codes(g)) == (want, 1, len(X.chunks(text)))


def test_kneser_ney_probabilities_sum_to_one():
    from tidemark.llm.langid import ORDER, Model

    r = random.Random(4)
    counts = {x: Counter("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(200)) for x, letters in (("one", "abcab"), ("two", "abxyz"))}
    model = Model(["one", "two"], counts)
    alphabet = sorted(set().union(*(w for c in counts.values() for w in c)))
    for context in ("", "a", "ab", "cab", "xyz", "bab", "zz"):
        probed = [model.letters([context + c])[0][len(context)] for c in (*alphabet, "☃")] + [model.letters([context])[0][-1]]
        assert np.allclose(np.sum(probed, 0), 1, atol=1e-5)
    # against the formula itself, with counts of substrings
    d = 0.75
    for j, lang in enumerate(("one", "two")):
        grams = [Counter() for _ in range(ORDER)]
        for w, n in counts[lang].items():
            s = "^" * (ORDER - 1) + w + "$"
            for i in range(ORDER - 1, len(s)):
                for k in range(ORDER):
                    grams[k][s[i - k : i + 1]] += n
        for k in range(ORDER - 1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
        def p(g, k):
            if k < 0:
                return 1 / (len(alphabet) + 2)
            same = {x: n for x, n in grams[k].items() if x[:-1] == g[:-1]}
            lower = p(g[1:], k - 1)
            total = sum(same.values())
            return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * lower if total else lower
        for w in list(counts[lang])[:20]:
            got, s = model.letters([w])[0][:, j], "^" * (ORDER - 1) + w + "$"
            assert np.allclose(got, [p(s[i - ORDER + 1 : i + 1], ORDER - 1) for i in range(ORDER - 1, len(s))], rtol=1e-4)


def test_scores_are_calibrated(spark):
    from tidemark.llm.langid import fit_languages, identify_languages

    r = random.Random(8)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 7)))
    say = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, say("aeioulm" if i % 2 else "krstgxz", 30), "one" if i % 2 else "two") for i in range(600)]
    fitted = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), reject=0.01)
    asked = [(i, say("aeioulm" if i % 2 else "krstgxz", 30)) for i in range(400)] + [(1000, "qwyqwy vvvv jjjj wqwq " * 5)]
    got = {x.doc_id: x for x in identify_languages(spark.createDataFrame(asked, "doc_id long, text string"), fitted).collect()}
    assert got[1000].rejected and got[1000].score < 0.5
    known = [x for x in got.values() if x.doc_id < 400]
    assert sum(x.rejected for x in known) <= 40 and all(x.score > 0.9 for x in known if not x.rejected)


def test_languages_learn_whole_runs_and_keep_rare_languages(spark):
    from tidemark.llm.langid import fit_languages, identify_languages

    for_limits = F.pmod(F.xxhash64("id", F.lit("limit")), F.lit(5)) == 0
    rare = spark.range(1000, 1100).where(for_limits).first().id
    rows = [(i, "ab" * 32 + ("xyz" if i % 2 else "uvw") * 40, "one" if i % 2 else "two") for i in range(40)] + [(rare, "mnop mnop mnop mnop", "rare")]
    fitted = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "xyz" * 10), (2, "uvw" * 10), (3, "mnop mnop")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify_languages(asked, fitted).collect()} == {1: "one", 2: "two", 3: "rare"}


def test_reaches_equal_all_pairs():
    from tidemark.llm.repeats import common, reaches

    r = random.Random(1)
    for _ in range(600):
        some = {}
        for _ in range(r.randint(1, 14)):
            some[bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))), b"x" + bytes(r.choice(b"abc") for _ in range(r.randint(0, 7)))] = r.choice([1, 1, 1, 2])
        c, n, length = list(some), list(some.values()), r.randint(2, 9)
        want = []
        for i, (a, z) in enumerate(c):
            pairs = [(len(a), len(z))] * (n[i] > 1) + [(common(a, x), common(z, y)) for j, (x, y) in enumerate(c) if j != i]
            pairs = [p for p in pairs if sum(p) >= length]
            want.append((max((p[0] for p in pairs), default=0), max((p[1] for p in pairs), default=0)))
        assert reaches([a for a, _ in c], [z for _, z in c], n, length) == want


def test_components_of_a_chain_a_hub_and_a_ring(spark):
    from tidemark.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 320)] + [(400 + i, 400 + (i + 1) % 30) for i in range(30)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(200, 320), 200), **dict.fromkeys(range(400, 430), 400)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("crowd, crowd_bytes", [(1, None), (None, None), (None, 100)])
def test_exact_distinct(spark, crowd, crowd_bytes):
    from tidemark.llm.exact import exact_distinct, exact_duplicates

    r = random.Random(6)
    texts = [None, "", "a", "ab", "x" * 5000, "x" * 5000 + "y", *("p" * 70 + str(i % 9) for i in range(40))]
    rows = [(i if i % 11 else None, r.choice(texts), f"s{i}", i, [i], "k") for i in range(300)]
    rows += [rows[5]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id long, row array<long>, depth string").repartition(3)
    best = defaultdict(lambda: -1)
    for i, t, *_ in rows:
        best[t or ""] = max(best[t or ""], -1 if i is None else i)
    got = exact_distinct(docs, crowd=crowd, crowd_bytes=crowd_bytes)
    assert got.columns == docs.columns
    out = got.collect()
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in out) == sorted(best.items()) and {tuple(map(str, x)) for x in out} <= {tuple(map(str, x)) for x in rows}
    assert exact_distinct(docs.limit(0)).count() == 0
    kept = exact_duplicates(docs, crowd=crowd, crowd_bytes=crowd_bytes).where("kept")
    assert sorted((r.text_sha256, r.doc_id) for r in kept.collect()) == sorted((__import__("hashlib").sha256(t.encode()).hexdigest(), i) for t, i in best.items() if i >= 0)


def test_language_sample_is_the_first_by_hash_at_any_size(spark):
    from tidemark.llm.langid import first_of_each, shares

    rows = spark.createDataFrame([("en", i * 2654435761 % 2**61 - 2**60) for i in range(300)] + [("fr", 5), ("fr", 5), ("fr", 5)], "lang string, h long")
    told = spark.createDataFrame([("en", 2_000_000_000), ("fr", 3)], "lang string, n long")  # as if the rows were of so large a table
    got = first_of_each(rows, told, 100).collect()
    assert sorted(r.h for r in got if r.lang == "en") == sorted(r.h for r in rows.where("lang = 'en'").collect())[:100] and sum(r.lang == "fr" for r in got) == 3
    bound = {r.lang: r.below for r in shares(spark.createDataFrame([("en", 2 * 10**9), ("de", 10**13), ("fr", 9)], "lang string, n long"), 1500, 4.0).collect()}
    assert bound["fr"] is None and all(abs((bound[x] + 2**63) / 2**64 * n / 6000 - 1) < 0.01 for x, n in (("en", 2 * 10**9), ("de", 10**13)))


def test_languages_with_null_and_repeated_ids(spark):
    from tidemark.llm.langid import fit_languages, identify_languages

    said = {"en": "the house by the river and other things that were there", "de": "das haus am fluss und andere dinge die dort waren"}
    rows = [(None if i % 2 else 7, f"{text} {chr(97 + i % 26) * 3}", lang) for i in range(200) for lang, text in said.items()] + [(7, said["en"], "en")] * 50
    fitted = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40)
    got = identify_languages(spark.createDataFrame([(1, "the river"), (2, "der fluss und das haus")], "doc_id long, text string"), fitted).collect()
    assert [r.lang_pred for r in got] == ["en", "de"]
