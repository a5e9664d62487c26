"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags, and the way back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, tidy

#: Marks of a turn by role, whether its text is trained on, and the marks of any other role. Every mark starts with one of `starts`
#: and has none of them further on, so no mark can arise across the border of a text and a mark.
TEMPLATE = {
    "escape": "\\",
    "starts": "<[",
    "roles": {
        "system": {"open": "[SYS]", "close": "[/SYS]", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "<s>", "close": "</s>", "loss": True},
    },
    "other": {"open": "[ROLE]", "middle": "[:]", "close": "[/ROLE]"},
}

#: Which role may follow which; "" is the start.
TURNS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


class Template:
    """Writes and reads conversations by a template. An occurrence of a mark in a text gets one escape after its first character,
    as does one that already has escapes there; reading takes one away."""

    def __init__(self, spec: dict):
        self.spec, esc = spec, re.escape(spec["escape"])
        marks = [m for r in spec["roles"].values() for m in (r["open"], r["close"])] + list(spec["other"].values())
        if any(m[0] not in spec["starts"] or set(m[1:]) & set(spec["starts"] + spec["escape"]) for m in marks):
            raise ValueError("each mark must start with a start character and have none, and no escape, further on")
        heads = "|".join(f"{re.escape(c)}{{}}(?=(?:{'|'.join(re.escape(m[1:]) for m in marks if m[0] == c)}))" for c in spec["starts"] if any(m[0] == c for m in marks))
        self.plain = re.compile(heads.replace("{}", f"{esc}*"))
        self.escaped = re.compile(heads.replace("{}", f"{esc}+"))
        self.marks = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True))))
        self.opens = {r["open"]: name for name, r in spec["roles"].items()}

    def escape(self, text: str) -> str:
        return self.plain.sub(lambda m: m[0] + self.spec["escape"], text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][:-1], text)

    def segments(self, role: str, text: str):
        """(string, loss flag) of one turn, in order."""
        r, other = self.spec["roles"].get(role), self.spec["other"]
        if r:
            yield r["open"], False
            yield self.escape(text), r["loss"]
            yield r["close"], False
        else:
            yield other["open"] + self.escape(role) + other["middle"], False
            yield self.escape(text), False
            yield other["close"], False

    def read(self, formatted: str):
        """(role, text) of each turn of a formatted conversation."""
        state, role, at = "between", "", 0
        for m in self.marks.finditer(formatted):
            inner = self.unescape(formatted[at : m.start()])
            if state == "between" and m[0] in self.opens and not inner:
                state, role = "text", self.opens[m[0]]
            elif state == "between" and m[0] == self.spec["other"]["open"] and not inner:
                state = "role"
            elif state == "role" and m[0] == self.spec["other"]["middle"]:
                state, role = "other", inner
            elif (state == "text" and m[0] == self.spec["roles"][role]["close"]) or (state == "other" and m[0] == self.spec["other"]["close"]):
                yield role, inner
                state = "between"
            else:
                raise ValueError(f"{m[0]} at {m.start()} cannot stand there")
            at = m.end()
        if state != "between" or at != len(formatted):
            raise ValueError("the conversation ends inside a turn")


def format_conversations(turns: DataFrame, template: dict = TEMPLATE, order: dict = TURNS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: id_col, n_turns, valid, error (the first turn out of order, else null), complete (valid and
    ends with a trained role), formatted, loss (start and end of each trained text in formatted, in code points).

    Turns are taken by turn, then role, then text, so ties have one order; nulls come first. Repeated rows are turns of their
    own. A null text is empty, a null role is the role "". All rows with a null id make up one conversation. Roles that the
    template lacks are written with their name; conversations out of order are formatted too and marked. An empty table gives
    no rows; other columns are not read. One shuffle by id; a worker streams its sorted rows and holds one conversation.
    """
    t = Template(template)
    trained = {k for k, r in template["roles"].items() if r["loss"]}

    def run(batches):
        state: dict = {}
        begun, key = False, None

        def start():
            return {"n": 0, "role": "", "error": None, "out": [], "at": 0, "loss": []}

        def row(key, s):
            return (key, s["n"], s["error"] is None, s["error"], s["error"] is None and s["role"] in trained, "".join(s["out"]), s["loss"])

        def batch(rows):
            cols = list(zip(*rows))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [kind, pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), span]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "n_turns", "valid", "error", "complete", "formatted", "loss"])

        rows, held, kind = [], 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for k, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not begun or k != key:
                    if begun:
                        rows.append(row(key, state))
                        held += state["at"]
                    begun, key, state = True, k, start()
                    if held > 4_000_000 or len(rows) >= 2000:
                        yield batch(rows)
                        rows, held = [], 0
                if state["error"] is None and role not in order.get(state["role"], ()):
                    state["error"] = f"turn {state['n']}: {role or 'no role'} after {state['role'] or 'the start'}"
                for part, loss in t.segments(role, text):
                    state["out"].append(part)
                    if loss:
                        state["loss"].append({"start": state["at"], "end": state["at"] + len(part)})
                    state["at"] += len(part)
                state["n"] += 1
                state["role"] = role
        if begun:
            rows.append(row(key, state))
            yield batch(rows)

    plain = turns.select(col(id_col).alias("id"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), col(turn_col).alias("turn"))
    dealt = plain.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_turns long, valid boolean, error string, complete boolean, formatted string, loss array<struct<start:long,end:long>>"
    return dealt.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def chat_digests(formatted: DataFrame, template: dict = TEMPLATE, id_col: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back: digests of their turns and of the text under the loss mask. Narrow."""
    import hashlib

    t = Template(template)

    def run(batches):
        for b in batches:
            ids, n, turns, chars, losses, size = b.column(0), [], [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                h, count = hashlib.sha256(), 0
                for role, inner in t.read(text):
                    h.update(f"{role}\n{inner}\n".encode())
                    count += 1
                g, total = hashlib.sha256(), 0
                for s in spans:
                    inner = t.unescape(text[s["start"] : s["end"]])
                    g.update(inner.encode())
                    total += len(inner)
                n.append(count)
                turns.append(h.hexdigest())
                chars.append(total)
                losses.append(g.hexdigest())
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(losses, pa.string()), pa.array(size, pa.int64())], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    plain = formatted.select(col(id_col).alias("id"), "formatted", "loss")
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(tidy(run), f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
