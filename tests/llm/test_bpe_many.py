"""New words are encoded side by side, from the left, and give what the merges and the library give."""

import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tables():
    return bpe.read_tables(tokenizer_path())


def test_small_merge_lists_side_by_side():
    r = random.Random(5)
    for _ in range(200):
        letters = "abc"[: r.choice([2, 3])]
        tokens, merges = list(letters), []
        for _ in range(r.randint(1, 10)):
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens and len(a + b) <= 6:
                merges.append([a, b])
                tokens.append(a + b)
        spec = {"model": {"vocab": {x: i for i, x in enumerate(tokens)}, "merges": merges}, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": "."}}]}}
        t = bpe.Transducer(bpe.BpeTables(spec))
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(30)]
        want = [tuple(t.t.ids[x] for x in bpe.merge_all([t.t.order[c] for c in w], t.t.pairs)) for w in words]
        assert t.many(words) == want
        assert [t._short(w) for w in words] == want


def test_words_of_any_script_side_by_side(tables):
    t, library, r = bpe.Transducer(tables), Tokenizer.from_file(tokenizer_path()), random.Random(6)
    parts = ["tion", "ing", "é", "ción", "ß", "ΟΔΟΣ", "ж", "щение", "日本", "한국", "İ", "Å", "K", "Q", "wh", "ü", "ﬁ", "ŉ", "a", "é", "각", "ᆨ", "𝒜", "१", "'s", "ª"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 6))) + r.choice(["", "", ".", ","]) for _ in range(6000)]
    t.learn(words)
    assert [list(t.ids(w)) for w in words] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert [t.count(w) for w in words] == [len(t.ids(w)) for w in words]


def test_plain_words_beyond_ascii_skip_the_library(tables, monkeypatch):
    t, library = bpe.Transducer(tables), Tokenizer.from_file(tokenizer_path())
    t.ids("éñüß")
    monkeypatch.setattr(t, "runs", None)
    words = ["ÉtÉ", "señor,", "größe.", "üñé"]
    assert [list(t.ids(w)) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_new_words_of_a_window_are_not_encoded_one_by_one(tables, monkeypatch):
    t, library = bpe.Transducer(tables), Tokenizer.from_file(tokenizer_path())
    words = ["thinwhoneror", "Ñoñerías.", "ofatenor,", "the"]
    t.learn(words)
    monkeypatch.setattr(t, "_seam", None)
    assert [list(t.ids(w)) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_a_memo_keeps_what_is_asked_for_and_is_bounded():
    made = []
    memo = bpe._Memo(lambda x: made.append(x) or len(x), 20_000)
    for i in range(2000):
        assert memo["often"] == 5 and memo[str(i)] == len(str(i)) and memo["x" * 300] == 300
    assert made.count("often") == 1 and len(memo) + len(memo.older) <= 20_000 // 220 + 2
    assert "x" * 300 not in memo
