import datetime as dt
import html
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evaluation as E
from tidemark.operators import extraction, grading
from tidemark.operators import panel as P
from tidemark.sources import landed as L
from tidemark.sources import tables

RELEASE = (
    "Brightwater Tools reports its third quarter. Revenue fell 4.5% from a year ago, to 88 million euros.\nOperating margin contracted by two points.\n"
    "The board is lowering its guidance for the year, and approved a restructuring of two plants.\n"
    "Safe harbor: we believe, expect, anticipate, may, could, should."
)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_rules_on_a_release(spark):
    c = one(spark, RELEASE, X.extract_claims)
    assert (c.revenue_direction, c.revenue_yoy_pct, c.margin_direction, c.guidance_action) == ("decreased", -4.5, "decreased", "lowered")
    assert c.announced_restructuring and not c.announced_buyback and c.hedging_intensity == 0 and c.guidance_horizon_quarters == 1
    empty = one(spark, "", X.extract_claims)
    assert empty.tone == "not_stated" and empty.revenue_yoy_pct is None and empty.guidance_horizon_quarters is None


@pytest.mark.parametrize("heading", ["Business Outlook", "Financial Outlook", "2025 Financial Guidance", "Full-Year 2025 Financial Outlook", "Fiscal 2024 full year guidance", "2022Outlook", "Outlook:"])
def test_guidance_is_carried_back(spark, heading):
    text = "x" * 1600 + "\nCONDENSED CONSOLIDATED STATEMENTS\n1 2 3\n" + heading + "\nWe see more.\n"
    p = one(spark, text, X.prepare)
    assert p.trimmed_at_marker and p.guidance_recovered and heading in p.text and "1 2 3" not in p.text


def test_prepare_limits(spark):
    assert not one(spark, "x" * 1600 + "\nCONSOLIDATED BALANCE SHEETS\nRECONCILIATION OF GAAP TO NON-GAAP OUTLOOK\n", X.prepare).guidance_recovered
    early = one(spark, "CONSOLIDATED BALANCE SHEETS\n" + "y" * 3000, X.prepare)
    assert not early.trimmed_at_marker and early.original_chars == len(early.text)
    p = one(spark, "a" * 90 + "\n\n" + "b" * 50, lambda c: X.prepare(c, 100))
    assert p.hard_truncated and p.text == "a" * 90
    assert not one(spark, "z" * 9000, lambda c: X.prepare(c, None)).hard_truncated


def test_html(spark):
    raw = "<html><script>x<1</script><p>AT&amp;T</p><table><tr><td>a</td><td>b</td></tr></table>EX-99.1<br>2<style>p{}</style>"
    out = one(spark, raw, X.html_to_text)
    assert "AT&T" in out and "x<1" not in out and re.search(r"a\s+b", out)
    assert one(spark, "EX-99.1\n2\nfile.htm\n\nNews", X.html_to_text) == "News"
    assert html.unescape("&copy;") == X.ENTITIES["&copy;"]


def test_timing(spark):
    """Sessions are the weekdays of May to November 2031; wall clocks change with daylight saving on November 2."""
    days = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2031-05-01", "2031-11-28")], "date date")
    wall = [("08:59:59", "pre_market", 0), ("09:29:59", "pre_market", 0), ("09:30:00", "intraday", 0), ("15:59:59", "intraday", 0), ("16:00:00", "after_hours", 1), ("23:10:00", "after_hours", 1)]
    cases = {}
    for day, ahead, offset in (("2031-05-13", "2031-05-14", "-04:00"), ("2031-11-13", "2031-11-14", "-05:00"), ("2031-06-06", "2031-06-09", "-04:00")):
        for clock, timing, late in wall:
            utc = pd.Timestamp(f"{day}T{clock}{offset}").tz_convert("UTC").strftime("%Y-%m-%dT%H:%M:%SZ")
            cases[utc] = (timing, ahead if late else day)
            cases[f"{day}T{clock}"] = cases[day.replace("-", "") + clock.replace(":", "")] = cases[utc]
    cases |= {"2031-07-05T15:00:00Z": ("non_session", "2031-07-07"), "unreadable": ("after_hours", "2031-08-20"), "": ("after_hours", "2031-08-20")}
    e = spark.createDataFrame([(a, dt.date(2031, 8, 19)) for a in cases], "accepted string, filing_date date")
    got = {r.accepted: (r.release_timing, str(r.t0)) for r in P.event_timing(e, P.calendar(days)).collect()}
    assert got == cases


def test_windows_do_not_look_ahead(spark):
    import numpy as np

    rng, days = np.random.default_rng(0), pd.bdate_range("2023-11-01", "2024-03-15")
    rows = []
    for ticker in ("TEST", "SPY"):
        price = 100.0
        for d in days:
            price *= float(np.exp(rng.normal(0, 0.05 if d >= pd.Timestamp("2024-02-01") else 0.001)))
            rows.append((ticker, d.date(), price, 1e6))
    w = P.event_windows(P.log_returns(spark.createDataFrame(rows, "ticker string, date date, close double, volume double")))
    events = spark.createDataFrame([("a", "TEST", dt.date(2024, 2, 1)), ("b", "TEST", dt.date(2023, 11, 2)), ("c", "NOPE", dt.date(2024, 2, 1)), ("d", "TEST", None)], "id string, ticker string, t0 date")
    got = {r.id: r for r in P.event_labels(events, w.where("ticker = 'TEST'"), w.where("ticker = 'SPY'")).collect()}
    assert got["a"].drop_reason is None and got["a"].rv_pre < 0.10 and got["a"].rv_post > 0.30 and got["a"].y == 1
    assert [got[k].drop_reason for k in "bcd"] == ["insufficient_pre_window", "no_price_history", "unresolvable_event_day"]


def test_purged_splits(spark):
    days = pd.bdate_range("2020-01-01", periods=400)
    rows = spark.createDataFrame([(i, d.date()) for i, d in enumerate(days)], "id long, date date").orderBy(F.rand(1))
    got = E.purged_splits(rows).toPandas()
    for _, f in got.groupby("fold"):
        train, test = f[f.role == "train"].id, f[f.role == "test"].id
        assert not set(train) & set(test) and (days[test.min()] - days[train.max()]).days > 10
    assert E.purged_splits(rows.limit(4)).count() == 0


def test_bootstrap_of_equal_models(spark):
    rows = spark.createDataFrame([(i, i % 2, (i * 37 % 11) / 11, (i * 37 % 11) / 11) for i in range(60)], "i long, y int, p_base double, p_cand double")
    r = E.paired_bootstrap(rows, 20).first()
    assert (r.auc_low, r.auc_high, r.d_brier) == (0.0, 0.0, 0.0)


def test_matching(spark):
    rows = [("numeric", "9.1", "9.0", True), ("numeric", "12", "9", False), ("numeric", None, None, True), ("numeric", None, "1", False), ("numeric", "0.01", "0", True), ("categorical", "a", "a", True), ("categorical", None, "a", False), ("ordinal", "2", "two", False)]
    got = spark.createDataFrame(rows, "kind string, p string, g string, want boolean").withColumn("hit", grading.values_match(F.col("kind"), F.col("p"), F.col("g"))).collect()
    assert all(r.hit == r.want for r in got)


def test_landed(spark, tmp_path):
    sgml = "<TYPE>EX-99.2\n<SEQUENCE>3\n<FILENAME>b.htm\n<TYPE>ex-99.1\n<SEQUENCE>2\n<FILENAME>a.htm\n"
    e = L.document_table(spark.createDataFrame([("x", sgml)], "accession string, sgml string"))
    assert e.count() == 2 and L.choose_exhibit(e).first().filename == "a.htm"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/acc1.txt").write_text("hello\nyou")
    docs = L.read_documents(spark, str(tmp_path / "docs"))
    assert docs.first().asDict() == {"accession": "acc1", "text": "hello\nyou"}
    keyed = extraction.with_keys(docs, "baseline", "", "1")
    assert [tables.append(keyed, str(tmp_path / "cache"), "key") for _ in range(2)] == [1, 0]
    assert extraction.pending(keyed, tables.read(spark, str(tmp_path / "cache"))).count() == 0


def test_stream_is_idempotent(spark, tmp_path):
    from tidemark.streaming.incremental import extract_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", RELEASE), ("b", RELEASE)], "accession string, text string").write.parquet(src)
    for k in range(2):
        q = extract_stream(spark.readStream.schema("accession string, text string").parquet(src), str(tmp_path / "out"), str(tmp_path / f"ck{k}"))
        q.awaitTermination(120)
    assert tables.read(spark, str(tmp_path / "out")).count() == 1
