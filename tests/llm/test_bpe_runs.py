"""Plain words take the short way through the encoder and give what the library gives."""

from tokenizers import Tokenizer

from tidemark.llm.bpe import Transducer, read_tables
from tidemark.llm.queries import tokenizer_path


def test_plain_words_skip_the_runs(monkeypatch):
    t, library = Transducer(read_tables(tokenizer_path())), Tokenizer.from_file(tokenizer_path())
    parts = ["eaon", "shou", "ble", "Th", "ing", "q", "ntion", "re"]
    words = [a + b + c for a in parts for b in parts for c in (*parts, "", ".", ",")] + ["a.", "A", "zzzz"]
    monkeypatch.setattr(t, "runs", None)
    assert [list(t.ids(w)) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]
