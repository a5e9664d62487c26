"""Byte-pair encoding as a streaming transducer, its decoder, and counting by whole-token shortcut.

The tokenizer file is a parameter. The driver reads it, proves which vocabulary strings encode alone as one token, and
broadcasts the tables; their size is fixed by the vocabulary, never by the data.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import col, keep, text_bytes, tidy

#: White space as the tokenizer file's patterns mean it (Unicode White_Space).
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = regex.compile(f"[{SPACE}]+")
#: What str.split() treats as white space and the patterns do not.
_ODD_SPACE = regex.compile("[\\x1c-\\x1f]")
#: What a worker's memos may hold; they bound memory, never results. Of chunks and of pre-tokens: bytes, an entry being some 220 and three for
#: each character; of seams: entries of some 110 bytes. Three fifths of the bytes are for chunks.
MEMO_BYTES, SEAMS = 150_000_000, 200_000
#: Characters handled at a time, cut at white space, where no token can cross.
BLOCK_CHARS = 1 << 20
#: Chunks whose new words are encoded side by side.
WINDOW = 50_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class BpeTables:
    """Merge tables of a `tokenizers` file whose words end in a suffix; picklable, of vocabulary size."""

    def __init__(self, spec: dict, source: str = ""):
        self.source = source
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab: dict[str, int] = model["vocab"]
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        self.order = {t: i for i, t in enumerate(base)}
        for a, b in merges:
            self.order.setdefault(a + b, len(self.order))
        if len(made) != len(merges):
            raise ValueError("a token that two merges make has no unique split")
        n = len(self.order)
        self.base = len(base)
        self.ids = [0] * n
        for t, i in self.order.items():
            self.ids[i] = vocab[t]
        self.names = {i: t for t, i in vocab.items()}
        self.left, self.right = list(range(n)), list(range(n))
        self.pairs: dict[int, int] = {}
        for a, b in merges:
            i, x, y = self.order[a + b], self.order[a], self.order[b]
            self.left[i], self.right[i] = x, y
            self.pairs[x << 20 | y] = i
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.specials.items()})
        self.pattern: str = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", SPACE)
        self.rules = json.dumps({"version": "1.0", "added_tokens": [], "normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self.joined_decoding = spec.get("decoder") is None
        ends = len(self.suffix)
        size = lambda t: len(t) - ends * t.endswith(self.suffix) if ends else len(t)
        self.symbols = {t: size(t) for t in self.order}
        self.longest = max(self.symbols.values())
        self.whole = frozenset(t for t, i in self.order.items() if self._alone(i))
        self.ahead = self.lookahead()

    def _alone(self, token: int) -> bool:
        """Proof by the merges themselves: applied to the token's own symbols, do they end in that token?"""
        parts: list[int] = []
        stack = [token]
        while stack:
            t = stack.pop()
            if t < self.base:
                parts.append(t)
            else:
                stack += [self.right[t], self.left[t]]
        return merge_all(parts, self.pairs) == [token]

    def lookahead(self) -> int:
        """Symbols after which a token can no longer change: the longest chain of competing merges times the longest token.

        A merge can only be undone from the right by an earlier merge whose left part begins inside its right part, and so on;
        chains are counted with 'begins with a character of', which over-counts and so stays sufficient.
        """
        names = {i: t for t, i in self.order.items()}
        best: dict[str, int] = {}
        longest = 1
        for i in range(self.base, len(self.ids)):
            u, v = names[self.left[i]], names[self.right[i]]
            c = 1 + max((best.get(x, 0) for x in v.removesuffix(self.suffix) or v), default=0)
            best[u[0]] = max(best.get(u[0], 0), c)
            longest = max(longest, c)
        return longest * self.longest


def merge_all(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """Plain byte-pair merging, lowest rank and then leftmost first; used for proofs and tests, not on texts."""
    while len(parts) > 1:
        best = min((pairs.get(a << 20 | b, 1 << 40) for a, b in zip(parts, parts[1:])))
        if best == 1 << 40:
            break
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and pairs.get(parts[i] << 20 | parts[i + 1]) == best:
                out.append(best)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


class _Memo(dict):
    """x -> what make(x) gives. When full, what was not asked for since it was last half full goes. Long strings are not kept."""

    def __init__(self, make, size: int):
        self.make, self.size, self.bytes, self.older = make, size // 2, 0, {}

    def __missing__(self, x):
        out = self.older.pop(x, None)
        if out is None:
            out = self.make(x)
        self.add(x, out)
        return out

    def add(self, x, out) -> None:
        if len(x) <= 256:
            self.bytes += 220 + 3 * len(x)
            if self.bytes > self.size:
                self.older = dict(self)
                self.clear()
                self.bytes = 0
            self[x] = out


class _Numbers:
    """Whole numbers below 2**40 -> small numbers, looked up many at a time: a table of slots, at most half of them taken."""

    def __init__(self, bits: int):
        self.bits, self.taken = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in it."""
        self.taken += len(keys)
        at = self._first(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            self.values[at[free]] = values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for what is not in it."""
        at = self._first(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class _Letters(dict):
    """For str.translate: code point -> stand-ins of the bytes of its normal form where the file's rules keep it inside a word of letters, else NUL.

    Such code points are normalized one by one: only marks and conjoining jamo (U+1100 to U+11FF), and letters past U+FFFF, compose with
    what stands before them; those are left to the rules themselves.
    """

    def __init__(self, rules):
        self.rules = rules

    def __missing__(self, point: int) -> str:
        if point > 0xFFFF or 0x1100 <= point < 0x1200:
            return "\0"
        library = self.rules()
        own = library.normalizer.normalize_str(chr(point))
        pieces = library.pre_tokenizer.pre_tokenize_str(f"a{own}a")
        self[point] = out = pieces[0][0][1:-1] if own and len(pieces) == 1 else "\0"
        return out


class Transducer:
    """Encodes symbol streams: the state is the last token of each of the latest prefixes. Tokens leave once all states agree on
    them, and at the latest when they end the merge list's sufficient lookahead before the newest symbol."""

    def __init__(self, tables: BpeTables, memo_bytes: int = MEMO_BYTES):
        self.t = tables
        self.bytes = _byte_symbols()
        self.split = regex.compile(tables.pattern).findall
        self.beyond_ascii = None
        self.letters = _Letters(self.library)
        self.fits: dict[int, bool] = {}
        self.tokens = {x: tables.order[x] for x in tables.whole}
        self.pieces = _Memo(self._piece, memo_bytes * 2 // 5)
        self.piece = self.pieces.__getitem__
        self.children = None
        self.reach: dict[str, int] = {}  # first three symbols -> the longest token that begins with them
        for t, n in tables.symbols.items():
            self.reach[t[:3]] = max(n, self.reach.get(t[:3], 2))
        specials = sorted(map(regex.escape, tables.specials), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(specials) + ")") if specials else None
        self.begins = frozenset(t[:1] for t in tables.specials)

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges leave the tokens a b as they are side by side? Undoes both along the seam, latest merge first."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > SEAMS:
                self.fits.clear()
            known = self.fits[key] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        left, right, pairs, base = self.t.left, self.t.right, self.t.pairs, self.t.base
        limit = 1 << 40
        while True:
            made = pairs.get(a << 20 | b)
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = (a, right[a]) if a >= base else (a, -1)
                if a < 0:
                    if b < base:
                        return True
                    limit, b, a = b + 1, left[b], limit
            else:
                limit, b = (b + 1, left[b]) if b >= base else (b + 1, -1)
                if b < 0:
                    b = limit - 1
                    if a < base:
                        return True
                    limit, a = a, right[a]

    def symbols(self, word: bytes) -> Iterator[str]:
        for x in word[:-1]:
            yield self.bytes[x]
        yield self.bytes[word[-1]] + self.t.suffix

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token orders of a symbol stream. Holds the latest prefixes back to the point on which all of them agree, and never more
        than the sufficient lookahead and one token: what lies further back on the newest prefix's path can no longer change."""
        order, whole, longest, end, ahead = self.t.order, self.t.whole, self.t.longest, self.t.suffix, self.t.ahead
        recent: list[str] = []
        state: list[tuple[int, int]] = [(-1, -1)]  # of each held prefix: its last token and where that began
        for s in symbols:
            recent.append(s)
            at, piece, found = len(recent), "", None
            for start in range(at - 1, max(-1, at - 1 - longest), -1):
                piece = recent[start] + piece
                token = order.get(piece)
                if token is None or piece not in whole or state[start] is None:
                    continue
                before = state[start][0]
                if before < 0 or self.compatible(before, token):
                    found = (token, start)
                    break
            if found is None:
                raise ValueError(f"the vocabulary lacks {s!r}")
            state.append(found)
            if at >= min(4 * longest, ahead + longest) and not (end and s.endswith(end)):
                meet = self._agreed(state, longest)
                if not meet and at >= ahead + longest:
                    meet = at
                    while meet > at - ahead:
                        meet = state[meet][1]
                if meet:
                    yield from self._path(state, meet)
                    recent = recent[meet:]
                    seed = state[meet][0]
                    state = [(seed, -1)] + [(x[0], x[1] - meet) if x and x[1] >= meet else None for x in state[meet + 1 :]]
        yield from self._path(state, len(state) - 1)

    @staticmethod
    def _agreed(state: list, longest: int) -> int:
        """The last prefix through which the path of every prefix that a later token can still start from leads."""
        live = {i for i in range(max(1, len(state) - longest), len(state)) if state[i]}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(state[last][1])
        return live.pop()

    @staticmethod
    def _path(state: list, at: int) -> list[int]:
        out = []
        while at > 0:
            token, at = state[at]
            out.append(token)
        return out[::-1]

    def _piece(self, word: str) -> tuple[int, ...]:
        """Vocabulary ids of one pre-token, given as the stand-ins of its bytes."""
        if len(word) <= 64:
            return self._short(word)
        return tuple(self.t.ids[x] for x in self.stream(c if i + 1 < len(word) else c + self.t.suffix for i, c in enumerate(word)))

    def _short(self, word: str) -> tuple[int, ...]:
        """The stream's path through a word that fits its window, from the left: the longest token that may stand after the last one, and
        back by one where none leads on. Each prefix has but one path of tokens that the merges leave side by side, so an end without a
        way on is dead whatever led to it."""
        token_of, fits, suffix = self.tokens.get, self.fits, self.t.suffix
        full, n = word + suffix, len(word)
        last = token_of(full)
        if last is not None:
            return (self.t.ids[last],)
        if len(fits) > SEAMS:
            fits.clear()
        fit_of, reach_of = fits.get, self.reach.get
        path, begins, at, dead, last = [], [], 0, 0, -1
        end = min(n, reach_of(word[:3], 2))
        while at < n:
            while end > at:
                token = token_of(word[at:end] if end < n else full[at:])
                if token is not None and not dead >> end & 1:
                    if last < 0:
                        break
                    key = last << 20 | token
                    known = fit_of(key)
                    if known is None:
                        known = fits[key] = self._seam(last, token)
                    if known:
                        break
                end -= 1
            else:
                if not path:
                    raise ValueError(f"the vocabulary lacks {word!r}")
                dead |= 1 << at
                end = at - 1
                path.pop()
                at = begins.pop()
                last = path[-1] if path else -1
                continue
            path.append(token)
            begins.append(at)
            at, last = end, token
            end = min(n, at + reach_of(word[at : at + 3], 2))
        ids = self.t.ids
        return tuple([ids[x] for x in path])

    def _trie(self) -> None:
        """Of the tokens that encode alone, as rows of symbols: children of (node, symbol), and of each token the next shorter one it begins with."""
        t = self.t
        children: dict[int, int] = {}
        at_node, node_of = [-1], {}
        parts_of: dict[int, list[int]] = {i: [i] for i in range(t.base)}
        for i in range(t.base, len(t.ids)):
            parts_of[i] = parts_of[t.left[i]] + parts_of[t.right[i]]
        alone = {t.order[x] for x in t.whole}
        for i, parts in parts_of.items():
            node = 0
            for x in parts:
                key = node * t.base + x
                node = children.get(key, -1)
                if node < 0:
                    node = children[key] = len(at_node)
                    at_node.append(-1)
            if i in alone:
                at_node[node] = i
        shorter = np.full(len(t.ids), -1, np.int32)
        for i in alone:
            node, best = 0, -1
            for x in parts_of[i][:-1]:
                node = children[node * t.base + x]
                best = at_node[node] if at_node[node] >= 0 else best
            shorter[i] = best
        self.children = _Numbers(max(4, (2 * len(children)).bit_length()))
        self.children.put(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int32, len(children)))
        self.at_node, self.shorter = np.array(at_node, np.int32), shorter
        self.lengths = np.array([len(parts_of[i]) for i in range(len(t.ids))], np.int64)
        self.inner, self.final = np.full(0x300, -1, np.int32), np.full(0x300, -1, np.int32)  # symbol of a stand-in within a word, and at its end
        for c in self.bytes:
            self.inner[ord(c)], self.final[ord(c)] = t.order.get(c, -1), t.order.get(c + t.suffix, -1)
        self.seams = _Numbers(19)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible of many pairs."""
        keys = a.astype(np.int64) << 20 | b
        known = self.seams.get(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            distinct, place = np.unique(keys[new], return_inverse=True)
            values = np.array([self._seam(k >> 20, k & 0xFFFFF) for k in distinct.tolist()], np.int32)
            known[new] = values[place]
            if self.seams.taken + len(distinct) > 1 << 18:
                self.seams = _Numbers(19)
            if len(distinct) <= 1 << 18:
                self.seams.put(distinct, values)
        return known > 0

    def many(self, words: list[str]) -> list[tuple[int, ...]]:
        """_short of many words that are not one token, side by side: each turn tries one token of every word that has not come to its end."""
        if self.children is None:
            self._trie()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.inner[points]
        symbols[ends - 1] = self.final[points[ends - 1]]
        if (symbols < 0).any():
            raise ValueError(f"the vocabulary lacks {chr(points[symbols < 0][0])!r}")
        stop = np.repeat(ends, sizes)
        # the longest token from each place on
        longest = np.full(len(points), -1, np.int32)
        place, node, ahead = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        while len(place):
            node = self.children.get(node * self.t.base + symbols[place + ahead])
            on = node >= 0
            place, node = place[on], node[on].astype(np.int64)
            token = self.at_node[node]
            longest[place[token >= 0]] = token[token >= 0]
            ahead += 1
            on = place + ahead < stop[place]
            place, node = place[on], node[on]
        # where a word stands, the token to try there, the last one and where that began; of each place the token that ends there
        dead, ending = np.zeros(len(points) + 1, bool), np.full(len(points) + 1, -1, np.int32)
        begin = ends - sizes
        at, w = begin.copy(), np.arange(len(words))
        trial, last = longest[at], np.full(len(words), -1, np.int32)
        while len(w):
            back = trial < 0
            if back.any():
                if (last[back] < 0).any():
                    raise ValueError(f"the vocabulary lacks {words[w[back][last[back] < 0][0]]!r}")
                dead[at[back]] = True
                at[back] -= self.lengths[last[back]]
                trial[back] = self.shorter[last[back]]
                last[back] = np.where(at[back] > begin[w[back]], ending[at[back]], -1)
            on = np.flatnonzero(trial >= 0)
            end = at[on] + self.lengths[trial[on]]
            good = ~dead[end]
            check = np.flatnonzero(good & (last[on] >= 0))
            good[check] = self._fit(last[on[check]], trial[on[check]])
            bad = on[~good]
            on, end = on[good], end[good]
            trial[bad] = self.shorter[trial[bad]]
            ending[end] = last[on] = trial[on]
            at[on] = end
            done = np.zeros(len(w), bool)
            done[on] = end == ends[w[on]]
            going = on[~done[on]]
            trial[going] = longest[at[going]]
            if done.any():
                left = ~done
                w, at, trial, last = w[left], at[left], trial[left], last[left]
        # back from each end along the tokens that end there
        kept = np.zeros(len(points) + 1, bool)
        at, w = ends.copy(), np.arange(len(words))
        while len(w):
            kept[at] = True
            at = at - self.lengths[ending[at]]
            left = at > begin[w]
            at, w = at[left], w[left]
        flat = [*map(self.t.ids.__getitem__, ending[kept].tolist())]  # the tables' own numbers: memos hold no further copies
        bounds = np.cumsum(kept)[ends].tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *bounds], bounds)]

    def learn(self, chunks: Iterable[str]) -> None:
        """Encodes side by side what is new to the memo of pre-tokens among the plain words of the chunks."""
        pieces, tokens, suffix, new = self.pieces, self.tokens, self.t.suffix, set()
        for c in chunks:
            words = self.plain(c)
            if words and words[0] not in pieces and words[0] not in pieces.older and len(words[0]) <= 64 and words[0] + suffix not in tokens:
                new.add(words[0])
        if new:
            new = list(new)
            for x, ids in zip(new, self.many(new)):
                pieces.add(x, ids)

    def library(self):
        """The file's own normalizer and pre-tokenizer rules, run by its library, whose Unicode tables differ from Python's."""
        if self.beyond_ascii is None:
            from tokenizers import Tokenizer

            self.beyond_ascii = Tokenizer.from_str(self.t.rules)
        return self.beyond_ascii

    def plain(self, chunk: str) -> tuple[str, ...]:
        """Pre-tokens of the commonest chunks, letters and perhaps a full stop or comma after them; none of any other."""
        word, mark = (chunk[:-1], chunk[-1]) if chunk[-1:] in (".", ",") else (chunk, "")
        if word.isascii():
            if not word.isalpha():
                return ()
            word = word.lower()
        else:
            word = word.translate(self.letters)
            if "\0" in word:
                return ()
        return (word, mark) if mark else (word,)

    def runs(self, chunk: str) -> Iterator[str | int]:
        """Pre-tokens of a text, as stand-ins of their bytes, or the ids of special strings in it, in order."""
        parts = [chunk] if self.begins.isdisjoint(chunk) else self.special.split(chunk)
        for p in parts:
            if (i := self.t.specials.get(p)) is not None:
                yield i
            elif p.isascii():
                for x in self.split(p.lower()):
                    yield x if x.isprintable() else "".join([self.bytes[b] for b in x.encode()])
            elif p:
                library = self.library()
                for x, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(p)):
                    yield x

    def ids(self, chunk: str) -> list[int] | tuple[int, ...]:
        words = self.plain(chunk)
        if words:
            return self.piece(words[0]) if len(words) == 1 else self.piece(words[0]) + self.piece(words[1])
        out: list[int] = []
        for x in self.runs(chunk):
            if isinstance(x, int):
                out.append(x)
            else:
                out += self.piece(x)
        return out

    def count(self, chunk: str) -> int:
        """Number of ids: pre-tokens proved to be one token count as they are, only the rest are merged."""
        whole, n = self.t.whole, 0
        for x in self.plain(chunk) or self.runs(chunk):
            if isinstance(x, int) or x + self.t.suffix in whole:
                n += 1
            else:
                n += len(self.piece(x))
        return n


class Decoder:
    """Ids to text, one at a time. Joined: token strings with a blank between; else bytes through a UTF-8 state machine."""

    def __init__(self, tables: BpeTables):
        self.t = tables
        self.back = {s: b for b, s in enumerate(_byte_symbols())}
        self.reset()

    def reset(self) -> None:
        self.begun = False
        self.need, self.held = 0, b""

    def feed(self, i: int) -> str:
        name = self.t.names.get(i, "")
        if self.t.joined_decoding:
            out = (" " if self.begun else "") + name
            self.begun = True
            return out
        if i in self.t.specials.values():
            return self.close() + name
        return "".join(self._byte(self.back[c]) for c in name.removesuffix(self.t.suffix))

    def feed_all(self, ids: Iterable[int]) -> str:
        """What feed gives for each in turn, as one string; joined names at once."""
        if not self.t.joined_decoding:
            return "".join(map(self.feed, ids))
        names = list(map(self.t.names.__getitem__, ids))
        if names and self.begun:
            names.insert(0, "")
        self.begun = self.begun or bool(names)
        return " ".join(names)

    def _byte(self, b: int) -> str:
        if b & 0xC0 == 0x80 and self.need:
            self.held += bytes([b])
            self.need -= 1
            return self.close() if not self.need else ""
        out = self.close()
        self.held, self.need = bytes([b]), 1 if b >> 5 == 6 else 2 if b >> 4 == 14 else 3 if b >> 3 == 30 else 0
        return out if self.need else out + self.close()

    def close(self) -> str:
        out, self.held, self.need = self.held.decode("utf-8", "replace"), b"", 0
        return out


def blocks(text: str) -> Iterator[list[str]]:
    """White-space separated chunks of a text, a bounded number of characters at a time."""
    odd = None if text.isascii() and not _ODD_SPACE.search(text) else _ODD_SPACE.search(text)
    at = 0
    while at < len(text):
        end = at + BLOCK_CHARS
        if end < len(text):
            m = _SPACES.search(text, end)
            end = m.start() if m else len(text)
        part = text[at:end] if at or end < len(text) else text
        yield [x for x in _SPACES.split(part) if x] if odd else part.split()
        at = end


def windows(texts: Iterable) -> Iterator[list[tuple[int, list[str]]]]:
    """Chunks of blocks with the places of their texts, in order, some WINDOW chunks or one block at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for chunks in blocks(text.as_py() or ""):
            held.append((i, chunks))
            size += len(chunks)
            if size >= WINDOW:
                yield held
                held, size = [], 0
    yield held


def read_tables(path: str) -> BpeTables:
    with open(path, encoding="utf-8") as f:
        return BpeTables(json.load(f), path)


def _worker(shared, memo_bytes: int = MEMO_BYTES) -> dict:
    """Per Python worker: the transducer and its memos, kept between tasks."""

    def make() -> dict:
        t, d = Transducer(shared.value, memo_bytes), Decoder(shared.value)
        ids, count = _Memo(lambda c: struct.pack(f"<{len(x := t.ids(c))}I", *x), memo_bytes * 3 // 5), _Memo(t.count, memo_bytes * 3 // 5)

        def learn(held):
            chunks = {c for _, x in held for c in x}
            t.learn(c for c in chunks if c not in ids and c not in ids.older and c not in count and c not in count.older)

        return {"ids": ids, "count": count, "decoder": d, "learn": learn}

    return keep("bpe", (shared.value.source, memo_bytes), make)


_SHARED: dict = {}


def _share(spark, path: str):
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(read_tables(path))
    return _SHARED[key]


def bpe_roundtrip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encode whole texts with a `tokenizers` BPE file and decode the ids again.

    Returns id_col, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256, and with keep_ids the
    ids and the decoded text. One row for each row of docs, repeated rows and null ids included. A null text is an empty one:
    no tokens, digests of nothing. Other columns are not read. Special strings inside texts become their ids, as the library does.
    Narrow: no shuffle; a worker's memory is its memos (some memo_bytes, which never change results), the tables and one window of a text.
    """
    shared = _share(docs.sparkSession, tokenizer)

    def run(batches):
        w = _worker(shared, memo_bytes)
        ids_of, decoder, learn = w["ids"].__getitem__, w["decoder"], w["learn"]

        def finish(rows, row):
            if row >= 0 and (rest := decoder.close()):
                rows[row][1].update(rest.encode())
                rows[row][3].append(rest)
            decoder.reset()

        for batch in batches:
            rows = [(hashlib.sha256(), hashlib.sha256(), [], []) for _ in range(batch.num_rows)]
            n, now = [0] * batch.num_rows, -1
            for held in windows(batch.column(1)):
                learn(held)
                for row, chunks in held:
                    a, b, raw, out = rows[row]
                    if row != now:
                        finish(rows, now)
                        now = row
                    one = b"".join(map(ids_of, chunks))
                    two = decoder.feed_all(struct.unpack(f"<{len(one) // 4}I", one))
                    a.update(one)
                    b.update(two.encode())
                    n[row] += len(one) // 4
                    if keep_ids:
                        raw.append(one)
                        out.append(two)
            finish(rows, now)
            hid, hdec = [x[0].hexdigest() for x in rows], [x[1].hexdigest() for x in rows]
            if keep_ids:
                kid = [list(struct.unpack(f"<{k}I", b"".join(x[2]))) for k, x in zip(n, rows)]
                ktext = ["".join(x[3]) for x in rows]
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(hid, pa.string()), pa.array(hdec, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array(kid, pa.list_(pa.int64())), pa.array(ktext, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    plain = docs.select(col(id_col).alias("id"), text_bytes(text_col).cast("string").alias("t"))
    return plain.mapInArrow(tidy(run, "bpe"), schema).withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of BPE tokens of whole texts, with the whole-token shortcut.

    Returns id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); one row for each row of docs, repeated rows and
    null ids included. A null or empty text has 0 bytes and 0 tokens. Other columns are not read. Narrow: no shuffle.
    """
    shared = _share(docs.sparkSession, tokenizer)

    def run(batches):
        w = _worker(shared)
        count, learn = w["count"].__getitem__, w["learn"]
        for batch in batches:
            texts = batch.column(1)
            n = [0] * len(texts)
            for held in windows(texts):
                learn(held)
                for row, chunks in held:
                    n[row] += sum(map(count, chunks))
            size = [t.as_buffer().size if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    plain = docs.select(col(id_col).alias("id"), text_bytes(text_col).cast("string").alias("t"))
    return plain.mapInArrow(tidy(run, "bpe"), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
