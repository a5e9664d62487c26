"""Readers, writers, the claims record, outside extractors and reports, on small fixtures."""

import datetime as dt
import html
import json
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.oracle import canonical
from tidemark.functions import text as X
from tidemark.operators import claims as C
from tidemark.operators import evaluation as E
from tidemark.operators import extraction
from tidemark.operators import features as FT
from tidemark.operators import grading
from tidemark.operators import panel as P
from tidemark.operators import reporting as R
from tidemark.plans import text_sql
from tidemark.sources import landed as L
from tidemark.sources import sinks as S

VALID = {"revenue_direction": "flat", "eps_direction": "flat", "margin_direction": "not_stated", "dividend_action": "flat", "guidance_action": "raised", "tone": "neutral"} | dict.fromkeys(FT.BOOLEAN, False)
VALID |= {"non_gaap_emphasis": 0, "hedging_intensity": 3, "confidence": 2, "revenue_yoy_pct": None, "guidance_horizon_quarters": 4}


def test_claims_are_validated(spark):
    cases = {"fine": (VALID, None), "tone": (VALID | {"tone": "angry"}, "invalid: tone"), "flag": (VALID | {"one_time_items": None}, "invalid: one_time_items"), "high": (VALID | {"hedging_intensity": 4}, "invalid: hedging_intensity"), "half": (VALID | {"guidance_horizon_quarters": 1.5}, "invalid: guidance_horizon_quarters"), "text": (VALID | {"revenue_yoy_pct": "six"}, "invalid: revenue_yoy_pct"), "less": ({k: v for k, v in VALID.items() if k != "eps_direction"}, "invalid: eps_direction"), "none": ({k: v for k, v in VALID.items() if k != "revenue_yoy_pct"}, None)}
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("broken", "{"), ("null", None)]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k string, a string").select("k", C.validate(F.col("a")).alias("v")).collect()}
    assert {k: got[k].error for k in cases} == {k: e for k, (_, e) in cases.items()} and not got["broken"].ok and not got["null"].ok
    assert got["fine"].claims.hedging_intensity == 3 and got["tone"].claims is None
    assert set(C.claims_schema()["properties"]) == set(VALID) == set(C.TYPES)


def test_references_are_inlined():
    schema = {"$defs": {"D": {"enum": ["a"], "x": {"$ref": "#/$defs/N"}}, "N": {"type": "null"}}, "p": [{"$ref": "#/$defs/D", "description": "d"}, 3]}
    assert C.inline_refs(schema) == {"p": [{"enum": ["a"], "x": {"type": "null"}, "description": "d"}, 3]}


def test_a_service_that_fails_never_ends_a_run(spark, tmp_path):
    tries = str(tmp_path / "tries")

    def call(text):
        with open(tries, "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise ConnectionError("gone")
        return {"answer": json.dumps(VALID) if text == "good" else "[]", "input_tokens": 5}

    docs = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "odd"), ("d", None)], "accession string, text string")
    got = {r.accession: r for r in C.extracted_by(docs, call, retries=3, wait=0.0).collect()}
    assert [(got[k].ok, (got[k].error or "").split(":")[0]) for k in "abcd"] == [(True, ""), (False, "ConnectionError"), (False, "unreadable"), (False, "ValueError")]
    assert got["a"].claims.guidance_action == "raised" and got["a"].input_tokens == 5 and open(tries).read().count("bad") == 3


def test_sinks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    claims = F.when(F.col("ok"), F.struct(F.lit("flat").alias("tone"), F.lit(1).alias("confidence")))
    rows = spark.createDataFrame([("a", "T", True, None, 1.0, 2.0), ("b", "T", False, "E: x", 3.0, 0.0)], "accession string, ticker string, ok boolean, error string, latency_s double, cost_usd double").withColumn("claims", claims)
    rows = rows.select("*", *[F.lit(4).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")])
    stats, reasons = S.write_extractions(rows, p("x"))
    assert [tuple(r) for r in S.read_table(spark, p("x")).collect()] == [("a", "T", "flat", 1)] and stats.first().n_failed == 1 and reasons.first().reason == "E"
    S.write_table(spark.range(3), p("t"))
    S.write_table(spark.range(2), p("t"))
    assert S.read_table(spark, p("t")).count() == 2
    S.write_csv(spark.createDataFrame([("a", 1.5), ("b", float("nan")), (None, 2.0)], "k string, v double"), p("c"))
    assert sorted(spark.read.text(p("c")).toPandas().value) == sorted(["k,v", "a,1.5", "b,", ",2.0"])
    new = spark.createDataFrame([("a", None), ("b", "y"), ("b", "y")], "accession string, note string")
    assert [S.append_jsonl(new, p("j"), "accession") for _ in range(2)] == [2, 0]
    assert '"note":null' in "".join(spark.read.text(p("j")).toPandas().value)
    S.cache_results(rows.withColumn("key", F.md5("accession")), p("cache"))
    assert [r.accession for r in S.read_table(spark, p("cache")).collect()] == ["a"]


def test_json_lines_tell_of_broken_rows(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"a": 1, "_reviewed": true}\n\n{"a": 2, "_reviewed": false}\n')
    schema = "a long, _reviewed boolean"
    assert [r.a for r in L.read_jsonl(spark, str(path), schema).collect()] == [1] and L.read_jsonl(spark, str(path), schema, None).count() == 2
    path.write_text('{"a": 1, "_reviewed": true}\n{"a":\n')
    with pytest.raises(ValueError, match="1 lines"):
        L.read_jsonl(spark, str(path), schema)
    path.write_text('{"a": 2}\n')
    with pytest.raises(ValueError, match="no reviewed"):
        L.read_jsonl(spark, str(path), schema)


def test_settings():
    text = "# head\nlabels:\n  pre: 20   # sessions\n  thr: 1.5\n  on: true\nnames: [a, 'b c', 3]\nempty:\nlist:\n- {ticker: AB, cik: 12}\n- ticker: CD\n  cik: 7\nurl: http://x/#y\n"
    assert L.read_settings(text) == {"labels": {"pre": 20, "thr": 1.5, "on": True}, "names": ["a", "b c", 3], "empty": None, "list": [{"ticker": "AB", "cik": 12}, {"ticker": "CD", "cik": 7}], "url": "http://x/#y"}
    assert L.read_settings("") == {}


def test_character_references(spark):
    cases = ["a&#8217;b &#x2014;&euro;&Eacute;", "&amp;lt; & &bogus; &", "&#0;&#x110000;&#150;&#128512;", "&#65 &#x41;", "none", "", "&frac12;&notin;&NotEqualTilde;"]
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.unescape(F.col("t")).alias("u"))
    assert all(r.u == html.unescape(r.t) for r in rows.collect())


def test_events_before_and_between_sessions(spark):
    day = lambda s: dt.date.fromisoformat(s)
    days = P.calendar(spark.createDataFrame([(day("2030-03-04"),), (day("2030-03-05"),)], "date date"))
    events = spark.createDataFrame([("2029-11-20T15:00:00Z", day("2029-11-20")), ("2030-03-03T15:00:00Z", day("2030-03-03")), ("2030-03-05T22:30:00Z", day("2030-03-05"))], "accepted string, filing_date date")
    assert [str(r.t0) for r in P.event_timing(events, days).orderBy("accepted").collect()] == ["2030-03-04", "2030-03-04", "None"]
    market = spark.createDataFrame([(day("2030-03-01"), 0.1), (day("2030-03-05"), None), (day("2030-03-08"), 0.3)], "date date, rv_pre double")
    asked = spark.createDataFrame([(day(f"2030-03-0{i}"),) for i in (1, 2, 5, 6, 9)], "date date")
    got = {r.date.day: r.rv_market_pre for r in P.market_before(asked, market).collect()}
    assert got == {1: 0.1, 2: None, 5: None, 6: 0.3, 8: 0.3, 9: None}


def test_coercions(spark):
    rows = spark.createDataFrame([(2.9, float("inf")), (-1.5, float("nan")), (None, None)], "claim_hedging_intensity double, claim_revenue_yoy_pct double")
    got = rows.select(*[c.alias(n) for n, c in FT.claim_block(rows.columns).items()]).collect()
    assert [(r.hedging_intensity, r.revenue_yoy_pct_missing) for r in got] == [(2.0, 0), (-1.0, 1), (0.0, 1)]


def test_paired_predictions_must_agree(spark):
    a = spark.createDataFrame([(1, 0, 0.2), (2, 1, 0.7)], "id long, y int, p double")
    assert E.paired(a, a).count() == 2
    for other in (a.where("id = 1"), a.withColumn("y", 1 - F.col("y"))):
        with pytest.raises(ValueError):
            E.paired(a, other)


def test_auc_and_positions_equal_plain_versions(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 1), round(r.random(), 3) if i % 3 else 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, p double").repartition(4)
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    assert E.auc(df).first().auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    got = {x.id: x.pos for x in E.positions(df, ["p", "id"]).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((p, i) for i, _, p in rows))}


def test_quantiles_equal_sorted_values(spark):
    r = random.Random(8)
    shares = [0.0, 0.025, 0.1, 0.5, 0.77, 1.0]
    for values in ([round(r.random(), 2) for _ in range(501)], [3.5] * 7, [1.0, 2.0], [-4.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "p double").repartition(5)
        assert E.quantiles(df, "p", shares).first().quantiles == pytest.approx(pd.Series(values).quantile(shares).tolist())
    assert E.quantiles(df.limit(0), "p", shares).first().quantiles is None


def test_reports(spark):
    rows = [("a", "tone", "categorical", "x", "x", True), ("a", "n", "numeric", "1", "2", False), ("b", "tone", "categorical", "x", "y", False), ("b", "n", "numeric", "1", "1", True)]
    graded = spark.createDataFrame(rows, "id string, field string, kind string, pred string, gold string, hit boolean")
    s = R.extraction_summary(graded).first()
    assert (s.n_documents, s.n_fields, s.mean_field_accuracy, s.worst_field, s.document_exact_match) == (2, 2, 0.5, "n", 0.0)
    with pytest.raises(ValueError):
        R.extraction_summary(graded.limit(0))
    text = R.markdown_report("Results", [("Fields", grading.field_accuracy(graded).orderBy("field").select("field", "accuracy")), ("Absent", None)])
    assert text == "# Results\n\n## Fields\n\n| field | accuracy |\n| --- | --- |\n| n | 0.5 |\n| tone | 0.5 |\n"


def plain_rules(text: str) -> dict:
    """The rules once more, over a string, from the same fixed values."""
    body = re.sub(r"\s+", " ", re.split(X.SAFE_HARBOR, text, maxsplit=1, flags=re.I)[0]).strip()
    low = body.lower()
    cues = lambda words: sum(low.count(w) for w in words)
    level = lambda n, limits: sum(n >= x for x in limits)

    def near(subject):
        for m in re.finditer(subject, body, re.I):
            for name, words in (("flat", X.FLAT), ("increased", X.UP), ("decreased", X.DOWN)):
                if re.search(words, body[m.end() : m.end() + 120], re.I):
                    return name
        return "not_stated"

    m = re.search(X.REVENUE_PCT, body, re.I)
    guidance = next((name for name, rule in X.GUIDANCE_RULES if re.search(rule, low)), "not_provided")
    sure, wary = cues(X.CONFIDENT), cues(X.CAUTIOUS)
    tone = "confident" if sure > 2 * wary and sure >= 2 else "cautious" if wary >= max(2, sure) else "neutral" if sure + wary else "not_stated"
    dividend = "not_stated" if "dividend" not in low else {"not_stated": "flat"}.get(near("dividend"), near("dividend"))
    return {
        "revenue_direction": near("revenue"), "eps_direction": near("(?:earnings per share|EPS)"), "margin_direction": near("margin"), "dividend_action": dividend, "guidance_action": guidance, "tone": tone,
        "revenue_yoy_pct": m and float(m[2]) * (-1 if m[1].lower() in ("decreased", "declined", "fell", "down") else 1), "guidance_horizon_quarters": None if guidance == "not_provided" else 4 if re.search("full[- ]year|fiscal year", low) else 1,
        "non_gaap_emphasis": level(low.count("non-gaap") + low.count("adjusted"), (1, 6, 15)), "hedging_intensity": level(cues(X.HEDGES), (2, 6, 14)), "macro_headwind_cited": cues(X.MACRO) >= 2,
        **{name: bool(re.search(rule, low)) for name, rule in X.FLAG_RULES.items()}, "confidence": 2,
    }


BITS = """Revenue|Margins|earnings per share|EPS|dividend|guidance|the outlook|for fiscal year|full-year|increased|declined|unchanged|grew 12.5%|fell 3 percent|up|lower|raised|lowering|reaffirmed|withdrew|suspended|we expect|from its prior|record|strong|
challenging|soft|headwind|believe|may|approximately|inflation|tariff|non-GAAP|adjusted|repurchase program|authorized|restructuring|cost reduction|impairment|write-down|appointed a new chief executive|the segment|weakness|one-time|unusual item|in line with|.|,|$109.4| |\n|Safe Harbor|MARGİN|ſtrong""".replace("\n|", "|").split("|")


def test_rules_equal_their_plain_version(spark):
    r = random.Random(12)
    texts = [" ".join(r.choice(BITS) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", "plain words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", extraction.EXTRACTORS["baseline"](F.col("t")).alias("c")).collect()
    for x in rows:
        got, want = x.c.asDict(), plain_rules(texts[x.i])
        assert got == want, (texts[x.i], {k: (got[k], want[k]) for k in want if got[k] != want[k]})


def test_direction_and_context_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150)
    got = docs.select("text", X.search_context(F.col("text"), "license", 10, 3).alias("hits")).collect()
    for r in got:
        assert r.hits == [m[0] for m in re.finditer(r"(?is).{0,10}license.{0,10}", r.text)][:3]


def by_sql(sql, texts):
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"i": range(len(texts)), "t": texts}))
    return con.sql(sql).df()


def test_sql_of_rules_equals_the_rules(spark):
    r = random.Random(13)
    texts = [" ".join(r.choice(BITS) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["", "plain words"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.extract_claims(F.col("t")).alias("c")).select("i", "c.*").toPandas()
    want = by_sql(text_sql.claims("given", "i", "t"), texts)
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_sql_of_markup_equals_the_rules(spark):
    r = random.Random(14)
    bits = "<p>|</p>|<br/>|<td>x</td>|</tr>|<div\n>|<script>a<b</script>|<STYLE x>p{}</style>|&amp;|&#8217;|&#x2014;|&euro;|&#128;|&#0;|&#99999999;|&#x110000;|&nope;|&amp|&|&#;|&nbsp;|&notin;".split("|")
    bits += ["<!-- a > b -->", "<!--", "-->", "<p title='1>2'>", '<a b="x>y" c>', "</SCRIPT >", "</td >", "<br clear='>'/>", "&ampb", "&notit;", "&notinx", "<ul>", "</ul>", "< ", "<!x>", "<?y?>"]
    bits += [" ", "\t", "\n", "\r\n", "\x1f", "\x85", "\u2009", "\u2019", "Document", "EX-99.1", "12", "a.htm", "word"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1000)] + [""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.html_to_text(F.col("t")).alias("text")).toPandas()
    assert canonical(got) == canonical(by_sql(text_sql.markup("given", "i", "t"), texts))


def test_markup_is_read_as_browsers_do(spark):
    import html

    cases = {
        "<!-- a > b -->x": "x", "<p title='1>2'>y": "y", "a<SCRIPT>z</p></SCRIPT >b": "ab", "a < b > c": "a < b > c", "<!-- <script> -->k<p>z</p>": "k z", "<style>q": "", "<!-- q": "",
        "<td class=\"a>b\">1</td><td>2</td >3<br clear='>'/>4": "1 2 3\n4", "<a href=x'>it's</a> ok's": "it's ok's", "<script>'<!--'</script>x<!-- y -->": "x", "<li>one</li></ul>two": "one\n\ntwo", "<p a='<script>'>t</p>": "t",
    }
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("t", X.html_to_text(F.col("t")).alias("text")).collect()
    assert {r.t: r.text for r in got} == cases
    said = ["&ampb", "&notit;", "&copy &copyx &amp;lt; &am &notin; &notinx &AMP; &ltgt &hellip &hellip;", "&" + "a" * 40, "&sup2x&sup2;&sup", "&Aacutex;&Aacut"]
    got = spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(X.unescape(F.col("t"))).collect()
    assert [r[0] for r in got] == [html.unescape(x) for x in said]
