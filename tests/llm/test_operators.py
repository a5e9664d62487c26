"""Each operator against a brute-force version, on a table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from tests.oracle import differences
from tidemark.llm import queries as Q

rng = random.Random(5)
WORDS = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(300)]
say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
BASE, PASSAGE = say(150), say(90)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t long, key long, pos string, n_tokens string"


def table():
    words = BASE.split()
    texts = [None, "", " \t\n", "a", "Ünï CODE. It's 3<|endoftext|>4!", BASE, BASE, BASE.upper(), BASE + " x", " ".join(words[:75] + ["zz"] + words[75:]), " ".join(["q", *words[:100]])]
    texts += [say(40) + " " + PASSAGE + " " + say(40) for _ in range(6)] + [say(5000) + "\n" + BASE, "ab" * 900, "no spaces" * 300, "x" * 1000, "日本語のテキスト" * 60, "a b c d", "a b c d", "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[7], (None, BASE), (None, None), (None, say(20))]
    return [(i, t, "en", "src0", len(t or ""), 1, 2, 3, "p", "q") for i, t in rows]


ROWS = table()
PAIRS = [(r[0], r[1] or "") for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_bpe_and_counts(docs, none):
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import bpe_roundtrip, token_counts

    t, want, counts = Tokenizer.from_file(Q.tokenizer_path()), Counter(), Counter()
    for i, x in PAIRS:
        ids = t.encode(x, add_special_tokens=False).ids
        want[(i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False)))] += 1
        counts[(i, len(x.encode()), len(ids), len(ids) > 100)] += 1
    assert rows(bpe_roundtrip(docs, Q.tokenizer_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert rows(token_counts(docs, Q.tokenizer_path(), limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit") == counts
    assert bpe_roundtrip(none, Q.tokenizer_path()).count() == token_counts(none, Q.tokenizer_path()).count() == 0


def test_transducer_streams_long_words():
    from tidemark.llm.bpe import Decoder, Transducer, merge_all, read_tables

    tables = read_tables(Q.tokenizer_path())
    tr, r = Transducer(tables), random.Random(1)
    for n in (3, 70, 900):
        for letters in ("ab", "the", "aeinrst", "a"):
            word = "".join(r.choice(letters) for _ in range(n))
            symbols = list(tr.symbols(word.encode()))
            assert list(tr.stream(iter(symbols))) == merge_all([tables.order[s] for s in symbols], tables.pairs)
    assert tables.lookahead() >= tables.longest
    d = Decoder(tables)
    d.t.joined_decoding = False
    ids = tr.ids("naïve") + tr.ids("日本")
    assert "".join(map(d.feed, ids)) + d.close() == "naïve日本"


@pytest.mark.parametrize("crowd", [1, None])
def test_exact(docs, none, crowd):
    from tidemark.llm.exact import exact_duplicates

    groups = defaultdict(list)
    for i, x in PAIRS:
        groups[x].append(i)
    want = Counter()
    for x, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        free = True
        for i in ids:
            want[(i, keep, len(ids), i == keep and free, sha(x))] += 1
            free = free and i != keep
    assert rows(exact_duplicates(docs, crowd=crowd), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_duplicates(none).count() == 0


def test_sharding(docs, none):
    from tidemark.llm.sharding import balanced_shards

    got = balanced_shards(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in PAIRS)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert balanced_shards(none).count() == 0


def test_shards_are_even(spark):
    from tidemark.llm.sharding import balanced_shards

    sizes = Counter()
    for r in balanced_shards(Q.table(spark, "/root/testdata/sf0.01", "documents"), tolerance=0.0005).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) / min(sizes.values()) < 1.002


def test_near_duplicates(docs, none, monkeypatch):
    from tidemark.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 2)
    for k in (4, 5):
        sets = {}
        for _, x in PAIRS:
            w = x.encode().lower().split()
            sets[x] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        parent = {x: x for x in sets}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[find(a)] = find(b)
        least = {}
        for i, x in PAIRS:
            if i is not None:
                least[find(x)] = min(i, least.get(find(x), i))
        want = Counter()
        for i, x in PAIRS:
            c = least.get(find(x)) if sets[x] else i
            want[(i, len(sets[x]), c, i == c)] += 1
        assert rows(neardup.near_duplicates(docs, words=k), "doc_id", "n_shingles", "component_id", "kept") == want
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [2, 50_000])
def test_repeats(docs, none, monkeypatch, crowd):
    from tidemark.llm import repeats

    monkeypatch.setattr(repeats, "CROWD", crowd)
    size, seen = 100, Counter()
    for _, x in PAIRS:
        b = x.encode()
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    want = Counter()
    for i, x in PAIRS:
        b = x.encode()
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want[(i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))] += 1
    assert rows(repeats.remove_repeats(docs, length=size), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert repeats.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, none, monkeypatch):
    from tidemark.llm.decontaminate import decontaminate

    p = PASSAGE.split()
    items = [(1, " ".join(p[:12])), (2, " ".join(p[30:45]).upper()), (3, "A b, C"), (4, None), (5, ""), (6, say(30)), (7, "a"), (7, "a"), (10, " ".join(p[2:14]))]
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(str(i))
    want = Counter()
    for i, x in PAIRS:
        w, hit, names = word.findall(low(x)), set(), set()
        for win, who in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    names |= who
        want[(i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(decontaminate(docs, bench), *cols) == want
    monkeypatch.setattr("tidemark.llm.decontaminate.NEAR_ROWS", 0)  # candidates meet their texts by a shuffle
    monkeypatch.setattr("tidemark.llm.decontaminate.ROUND_BYTES", 12_000)  # several rounds
    assert rows(decontaminate(docs, bench), *cols) == want
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_by_ids_that_look_alike(spark):
    from tidemark.llm.decontaminate import decontaminate

    said = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("-", said), (None, said), ("x", "clean"), ("-", "clean"), ("-", said), ("", said + " " + said)], "doc_id string, text string")
    got = decontaminate(docs, spark.createDataFrame([("i", said), ("j", "five")], "item_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in got) == sorted([("-", 11, 2), ("None", 11, 2), ("x", 0, 0), ("-", 0, 0), ("-", 11, 2), ("", 22, 2)])


def test_chat(spark):
    from tidemark.llm.chat import TEMPLATE, Template, chat_digests, format_conversations

    t, r = Template(TEMPLATE), random.Random(3)
    bits = ["<", "[", "\\", "/", "s>", "INST]", "/INST]", "[INST]", "</s>", ":]", "ROLE]", "SYS]", "a", " "]
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "[ROLE]"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(0, 4))]
        assert list(t.read("".join(s for role, x in turns for s, _ in t.segments(role, x)))) == turns
    rows_ = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, None, "y"), (3, 1, "assistant", "</s>"), (3, 0, "user", "[INST]")]
    f = format_conversations(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS loss"))
    got = {x.conv_id: x for x in f.collect()}
    assert (got[1].valid, got[1].complete, got[2].valid, got[2].n_turns, got[None].valid, got[3].valid) == (True, True, False, 2, False, True)
    d = {x.conv_id: x for x in chat_digests(f).collect()}
    assert d[3].turns_sha256 == sha("user\n[INST]\nassistant\n</s>\n") and d[3].loss_sha256 == sha("</s>") and d[2].loss_chars == 2
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_toxicity(spark, docs, none):
    from tidemark.llm.toxicity import Grammar, fit_toxicity, toxicity_scores

    sf = "/root/testdata/sf0.1"
    told = Q.table(spark, sf, "labels")
    got = Q.op1_toxicity(spark, sf).join(told, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic, flagged = sum(r.toxic for r in got), [r for r in got if r.predicted]
    assert sum(r.toxic for r in flagged) > 0.85 * toxic and sum(1 - r.toxic for r in flagged) <= 2
    g = Grammar({"moron": 5.0})
    memo = {w: g.code(w) for w in "you are a moron. he said not quoted is never".split() + ["moron", "."]}
    assert g.channels("you moron.", memo)[0][1] == 5.0 and g.channels("a moron", memo)[0][0] == 5.0
    assert g.channels("never a moron.", memo)[0][2] == 5.0 and g.channels("he said a moron.", memo)[0][3] == 5.0
    empty = told.limit(0)
    grammar, w = fit_toxicity(docs, empty)
    assert toxicity_scores(docs, grammar, w).count() == len(ROWS) and toxicity_scores(none, grammar, w).count() == 0


def test_languages(spark, docs, none):
    from tidemark.llm.langid import fit_languages, identify_languages

    sf = "/root/testdata/sf0.01"
    got = Q.op10_language_id(spark, sf).join(Q.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    fitted = fit_languages(docs)
    out = identify_languages(docs, fitted).collect()
    assert len(out) == len(ROWS) and {r.lang_pred for r in out} == {"en", "und"} and all(0 <= r.score <= 1 for r in out)
    assert identify_languages(docs, fit_languages(none)).where("lang_pred = 'und'").count() == len(ROWS)
    assert identify_languages(none, fitted).count() == 0


def test_sql(spark):
    for name, sql in Q.ORACLE_SQL.items():
        assert differences(spark, Q.QUERIES[name], sql, "/root/testdata/sf0.001") == []


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    want = set(docs.select("doc_id", "text").collect())
    clean = C.exact_dedup(spark, docs, sf)
    assert clean.columns == docs.columns
    assert {x[1] or "" for x in clean.select("doc_id", "text").collect()} == {x or "" for _, x in want} and clean.count() == len({x or "" for _, x in want})
    assert C.decontamination(spark, docs, sf).count() == len(ROWS)
    near = C.near_dedup(spark, docs.where("doc_id in (5, 8, 17)"), sf)
    assert {r.doc_id for r in near.collect()} == {5, 17}
    assert C.run(spark, sf).count() > 0
