"""Service calls: bounded numbers at a time, a shared rate, errors that pass and errors that don't, and the report's manifest."""

import threading
import time
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators import claims as C
from tidemark.operators import grading, reporting


@pytest.fixture()
def service():
    """A server that counts its callers; it takes 0.1 s for an answer."""
    lock, seen = threading.Lock(), {"now": 0, "most": 0, "calls": 0, "asked": {}}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            said = self.rfile.read(int(self.headers["Content-Length"])).decode()
            with lock:
                seen["now"] += 1
                seen["calls"] += 1
                seen["most"] = max(seen["most"], seen["now"])
                seen["asked"][said] = seen["asked"].get(said, 0) + 1
                busy = said.startswith("busy") and seen["asked"][said] < 3
            time.sleep(0.1)
            with lock:
                seen["now"] -= 1
            self.send_response(503 if busy else 400 if said.startswith("bad") else 200)
            self.end_headers()
            self.wfile.write(said.upper().encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def call(text):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, text.encode())) as got:
                return {"answer": got.read().decode()}
        except urllib.error.HTTPError as e:
            if e.code == 503:
                raise C.Busy("503", wait=0.01) from e
            raise ValueError(e.code) from e

    yield call, seen
    server.shutdown()


def docs(spark, texts):
    return spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "accession string, text string").coalesce(1)


def test_calls_at_a_time(spark, service):
    call, seen = service
    rows, took = docs(spark, [f"t{i}" for i in range(24)]), {}
    for bound in (1, 8):
        seen["most"], began = 0, time.perf_counter()
        got = C.called(rows, call, in_flight=bound).collect()
        took[bound] = time.perf_counter() - began
        assert [r.answer for r in got] == [f"T{i}" for i in range(24)] and seen["most"] <= bound
    assert took[8] < took[1] / 2


def test_errors_that_pass_and_errors_that_are_final(spark, service):
    call, seen = service
    got = {r.accession: r for r in C.called(docs(spark, ["busy", "bad", "fine", None, "busy too"]), call, in_flight=3, retries=3, wait=0.0).collect()}
    assert [got[f"{i:03}"].ok for i in range(5)] == [True, False, True, False, True]
    assert got["001"].error == "ValueError: 400" and seen["asked"] == {"busy": 3, "bad": 1, "fine": 1, "busy too": 3}


def test_the_rate_is_shared_among_tasks(spark, service):
    call, seen = service
    rows = docs(spark, [f"t{i}" for i in range(20)])
    began = time.perf_counter()
    C.called(rows, call, in_flight=8, per_second=10, tasks=2).collect()
    assert time.perf_counter() - began > 1.5 and seen["calls"] >= 20
    with pytest.raises(ValueError, match="stated number"):
        C.called(rows, call, per_second=10)


def test_a_service_that_is_not_there_ends_the_run_before_it_begins(spark, service):
    call, seen = service

    def check():
        raise RuntimeError("no such model")

    with pytest.raises(RuntimeError, match="no such model"):
        C.called(docs(spark, ["a"]), call, check=check)
    assert seen["calls"] == 0


def test_one_run_has_no_agreement(spark):
    one = spark.createDataFrame([(0, 1, "tone", "a")], "run int, id int, field string, answer string")
    with pytest.raises(ValueError, match="two runs"):
        grading.modal_agreement(one)


def test_the_report_shows_what_has_run(spark, tmp_path):
    at = str(tmp_path / "r")
    assert reporting.assembled_report(spark, at, "T") == "# T\n"
    reporting.record_stage(spark.createDataFrame([("tone", 0.5)], "field string, accuracy double"), at, "extraction_fields", "claude")
    reporting.record_stage(spark.createDataFrame([("tone", 0.25)], "field string, accuracy double"), at, "extraction_fields", "baseline", "1")
    reporting.record_stage(spark.createDataFrame([("tone", 0.75)], "field string, accuracy double"), at, "extraction_fields", "baseline", "2")
    reporting.record_stage(spark.createDataFrame([(7,)], "n int"), at, "events")
    reporting.record_stage(spark.createDataFrame([(1,)], "n int"), at, "something new")
    said = reporting.assembled_report(spark, at, "T")
    heads = [x for x in said.split("\n") if x.startswith("##")]
    assert heads == ["## Dataset", "## Accuracy by field - baseline", "## Accuracy by field - claude", "## something new"] and "| tone | 0.75 |" in said and "0.25" not in said


def test_consistency_without_grading(spark):
    rows = spark.createDataFrame([("b", 0.5, 0.1), ("a", 0.5, 0.2), ("c", 0.1, 0.0)], "field string, agreement double, unanimous double")
    assert [(r.field, r.place) for r in reporting.consistency_table(rows).orderBy("place").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert reporting.consistency_table(rows).where(F.col("accuracy").isNotNull()).count() == 0
