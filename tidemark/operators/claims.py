"""The claims record: its fields, validation of JSON answers, parsing of typed answers, and extractors that call something outside."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import BOOLEAN, CATEGORICAL, NUMERIC, ORDINAL

#: Type of each field of a claims record. Enumerations and flags are required, numbers may be null, ordinals are 0 to 3.
TYPES = dict.fromkeys(CATEGORICAL, "string") | dict.fromkeys(BOOLEAN, "boolean") | dict.fromkeys([*ORDINAL, "confidence"], "int") | {"revenue_yoy_pct": "double", "guidance_horizon_quarters": "int"}
CLAIMS = "struct<" + ",".join(f"{f}:{t}" for f, t in TYPES.items()) + ">"


def _problem(f: str, raw: Column) -> Column:
    """True where a field's JSON text is not a value of its kind."""
    if f in CATEGORICAL:
        return ~F.coalesce(raw.isin(*CATEGORICAL[f]), F.lit(False))
    if f in BOOLEAN:
        return ~F.coalesce(raw.isin("true", "false"), F.lit(False))
    whole = F.coalesce(raw.try_cast("double") == F.floor(raw.try_cast("double")), F.lit(False))
    if f in ORDINAL or f == "confidence":
        return ~(whole & raw.try_cast("double").between(0, 3))
    return raw.isNotNull() & (~whole if f == "guidance_horizon_quarters" else raw.try_cast("double").isNull())


def validate(answer: Column) -> Column:
    """Struct ok, error, claims of a JSON text: claims if every field is valid, else the first that is not, in the record's order."""
    raw = F.from_json(answer, "map<string,string>")
    field = lambda f: F.element_at(raw, f)
    error = F.when(raw.isNull(), "unreadable: not a JSON object")
    for f in TYPES:
        error = error.when(_problem(f, field(f)), F.lit(f"invalid: {f}"))
    value = lambda f, t: field(f).try_cast("double").cast(t) if t in ("int", "double") else field(f).cast(t)
    claims = F.struct(*[F.when(error.isNull(), value(f, t)).alias(f) for f, t in TYPES.items()])
    return F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), claims).alias("claims"))


def to_json(results: Column) -> Column:
    """A result as JSON text, null fields included."""
    return F.to_json(results, {"ignoreNullFields": "false"})


def from_json(text: Column, schema: str = CLAIMS) -> Column:
    """The result that a JSON text holds; null where it is none (a corrupt entry counts as a miss)."""
    return F.from_json(text, schema)


def parse_answer(kind: Column, raw: Column, choices: Column, nullable: Column, whole: Column) -> Column:
    """Struct ok, value (as text) of a typed answer. Enumerations and flags take a choice or its number; ordinals 0 to 3; numbers,
    whole ones where `whole`; null, none and - are null where nullable. An invalid answer is not ok and null."""
    text = F.lower(F.trim(raw))
    number = text.try_cast("double")
    digits = text.rlike(r"\A[0-9]+\z")
    option = F.when(digits & number.between(1, F.size(choices)), F.get(choices, number.cast("int") - 1)).otherwise(text)
    value = (
        F.when(kind.isin("enum", "bool"), F.when(F.array_contains(choices, option), option))
        .when(kind == "ordinal", F.when(digits & number.between(0, 3), number.cast("int").cast("string")))
        .when(number.isNull() | F.isnan(number), F.lit(None).cast("string"))
        .when(whole, F.when(number == F.floor(number), number.cast("long").cast("string"))).otherwise(number.cast("string"))
    )
    none = nullable & text.isin("null", "none", "-")
    return F.struct((none | value.isNotNull()).alias("ok"), F.when(~none, value).alias("value"))


def inline_refs(schema: dict) -> dict:
    """A JSON schema without references: each $ref gives way to its definition, and keys beside it win."""
    known = schema.get("$defs", {})

    def plain(node):
        if isinstance(node, list):
            return list(map(plain, node))
        if not isinstance(node, dict):
            return node
        own = {k: plain(v) for k, v in node.items() if k not in ("$ref", "$defs")}
        return {**plain(known.get(node["$ref"].split("/")[-1], {})), **own} if "$ref" in node else own

    return plain(schema)


def claims_schema() -> dict:
    """The record as a JSON schema, for decoders that take one."""
    def one(f):
        if f in CATEGORICAL:
            return {"enum": CATEGORICAL[f]}
        if f in BOOLEAN:
            return {"type": "boolean"}
        if f in NUMERIC:
            return {"type": ["number" if f == "revenue_yoy_pct" else "integer", "null"]}
        return {"type": "integer", "minimum": 0, "maximum": 3}

    return {"type": "object", "properties": {f: one(f) for f in TYPES}, "required": [f for f in TYPES if f not in NUMERIC], "additionalProperties": False}


#: Rows that cross to a task at a time, and how many of them, or twice that, are unpacked and asked about; texts may be long.
BATCH_ROWS, ASKED = 1000, 100


class Busy(Exception):
    """What a service raises that would answer later: it is asked again after `wait` seconds, or after the usual wait."""

    def __init__(self, why: str = "busy", wait: float | None = None):
        super().__init__(why)
        self.wait = wait


#: Errors that may pass; all others (a refusal, a fault in the program) are final at once.
PASSING = (ConnectionError, TimeoutError, Busy)


class Bucket:
    """Leave to call, at a steady rate, for the threads of one task."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                at = self.next = max(time.monotonic(), self.next + self.gap)
            time.sleep(max(0.0, at - time.monotonic()))


def called(
    docs: DataFrame, call: Callable[[str], dict], key: str = "accession", text: str = "text", retries: int = 4, wait: float = 4.0, most_wait: float = 60.0,
    in_flight: int = 1, per_second: float | None = None, tasks: int | None = None, passing: tuple = PASSING, check: Callable[[], None] | None = None,
) -> DataFrame:
    """docs' keys with ok, error, answer (JSON text), token counts and latency of call(text), which gives a dict with `answer` and
    perhaps counts, or raises. A document never ends the run: a row whose tries all fail, or that has no text, is not ok and says why. Errors of
    the classes `passing` are tried `retries` times, with waits that double; any other is final. Answers are validated apart (validate).

    A task has up to in_flight calls at a time, and gives its rows in their order. per_second bounds the calls of the whole run: the rows are dealt
    to `tasks` tasks, each of which has its share of the rate (so both must be given). check is called once, before the run, and ends it if it
    raises: a service that isn't there, or lacks a model, is told of before any document is read."""
    if per_second and not tasks:
        raise ValueError("a rate is shared among a stated number of tasks")
    if check:
        check()
    counts = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    share = per_second / tasks if per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(share)

        def one(value):
            began, error = time.perf_counter(), "ValueError: no text"
            for attempt in range(retries if value is not None else 0):
                bucket.wait()
                try:
                    got = call(value)
                    return (True, None, got["answer"], *(int(got.get(c, 0)) for c in counts), time.perf_counter() - began)
                except Exception as e:  # whatever a service raises
                    error = f"{type(e).__name__}: {e}"
                    if not isinstance(e, passing):
                        break
                    if attempt + 1 < retries:
                        told = getattr(e, "wait", None)
                        time.sleep(min(most_wait, wait * 2**attempt) if told is None else told)
            return (False, error, None, 0, 0, 0, 0, time.perf_counter() - began)

        most = max(ASKED, in_flight)
        window: deque = deque()  # keys and calls, in order; as many as are answered below are under way meanwhile

        def answered(n):
            keys, rows = zip(*((k, call.result()) for k, call in (window.popleft() for _ in range(n))))
            columns = [pa.array([k.as_py() for k in keys], keys[0].type), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
            return pa.RecordBatch.from_arrays(columns, names)

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for k, x in zip(batch.column(0), batch.column(1)):
                    window.append((k, pool.submit(one, x.as_py())))
                    if len(window) == 2 * most:
                        yield answered(most)
            if window:
                yield answered(len(window))

    kind = dict(docs.dtypes)[key]
    kinds = [pa.bool_(), pa.string(), pa.string(), *(pa.int64() for _ in counts), pa.float64()]
    names = [key, "ok", "error", "answer", *counts, "latency_s"]
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(most)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(most, str(BATCH_ROWS))
    rows = docs.select(key, F.col(text).cast("string").alias("\0text"))
    rows = rows.repartition(tasks) if tasks else rows
    return rows.mapInArrow(run, f"`{key}` {kind}, ok boolean, error string, answer string, " + ", ".join(f"{c} long" for c in counts) + ", latency_s double")


def extracted_by(docs: DataFrame, call: Callable[[str], dict], **how) -> DataFrame:
    """What call answers for each document, validated: ok, error and claims; an answer that is no valid record is not ok."""
    rows = called(docs, call, **how).withColumn("v", validate(F.col("answer")))
    return rows.withColumn("error", F.when(F.col("ok"), F.col("v.error")).otherwise(F.col("error"))).withColumn("claims", F.col("v.claims")).withColumn("ok", F.col("ok") & F.col("v.ok")).drop("v", "answer")
