"""Queries of what stands between stages: tables of steps, the cache, service calls, the report's tables; and gradings that need several runs."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.text import content_key
from tidemark.operators import extraction, grading, reporting
from tidemark.operators import panel as P
from tidemark.operators.claims import Busy, called
from tidemark.plans import text_sql
from tidemark.plans.queries import GRADED, MODAL_ALL, SCORED, T, all_runs, graded, prices, query, r6, scored
from tidemark.sources import landed as L
from tidemark.sources import sinks, tables
from tidemark.sources.scratch import root


def _place(spark, name: str) -> str:
    return f"{root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, sum(n) AS n, max(part) AS last_part FROM (SELECT doc_id, 1 AS n, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS part FROM documents) GROUP BY doc_id")
def table_appended(spark, d):
    """Documents in English, then all, appended by key: the second step adds those that the first lacks; then both are put into one."""
    docs, path = T(spark, d, "documents").select("doc_id", "lang"), _place(spark, "appended")
    tables.append(docs.where("lang = 'en'").withColumn("part", F.lit(1)), path, "doc_id")
    tables.append(docs.withColumn("part", F.lit(2)), path, "doc_id")
    tables.compact(spark, path)
    return tables.read(spark, path).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("part").alias("last_part"))


@query("SELECT doc_id, sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents JOIN labels USING (doc_id) WHERE quality = 1) AS cached FROM documents")
def cache_lookup(spark, d):
    """Which documents have a result in a cache that holds those of well-labelled ones; only the wanted keys' folders are read."""
    docs = T(spark, d, "documents").select("doc_id", content_key(F.lit("baseline"), F.col("text")).alias("key"))
    done = docs.join(T(spark, d, "labels"), "doc_id").select("key", F.col("doc_id").alias("of"), (F.col("quality") == 1).alias("ok"))
    path = _place(spark, "cache")
    sinks.cache_results(done.where("ok"), path)
    there = sinks.cached_in(docs, path, done.schema).select("key", F.lit(True).alias("there"))
    return docs.join(there, "key", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("cached"))


_LAST = threading.local()


def _asked(text: str) -> dict:
    """A made-up service: it refuses every fifth length, and is busy when it is first asked for every third."""
    if len(text) % 5 == 0:
        raise ValueError("refused")
    if len(text) % 3 == 0 and getattr(_LAST, "text", None) != text:
        _LAST.text = text
        raise Busy(wait=0.0)
    return {"answer": f'{{"chars": {len(text)}}}', "input_tokens": len(text) // 4}


@query("""SELECT doc_id, length(coalesce(text, '')) % 5 > 0 AND text IS NOT NULL AS ok, CASE WHEN text IS NULL THEN 'ValueError: no text' WHEN length(text) % 5 = 0 THEN 'ValueError: refused' END AS error,
CASE WHEN length(text) % 5 > 0 THEN '{"chars": ' || length(text) || '}' END AS answer, CASE WHEN length(text) % 5 > 0 THEN length(text) // 4 ELSE 0 END AS input_tokens FROM documents""")
def service_calls(spark, d):
    """Every document put to a service with 16 calls at a time in a task; refusals are final, busy answers are asked again."""
    return called(T(spark, d, "documents"), _asked, "doc_id", in_flight=16, retries=3, wait=0.0).select("doc_id", "ok", "error", "answer", "input_tokens")


@query(f"""WITH {GRADED}, r AS (SELECT field, coalesce(pred IN ('not_stated', 'not_provided'), true) AS p, coalesce(gold IN ('not_stated', 'not_provided'), true) AS q FROM g WHERE kind IN ('categorical', 'numeric'))
SELECT field, round(avg(q::INT), 6) AS gold_abstention_rate, round(avg(p::INT), 6) AS pred_abstention_rate, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p), 0), 6) AS abstain_precision,
round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (q), 0), 6) AS abstain_recall FROM r GROUP BY 1""")
def abstention_rates(spark, d):
    """How often gold and prediction abstain, for the fields that can: categories and numbers."""
    out = grading.abstention(graded(spark, d).where("kind in ('categorical', 'numeric')"))
    return out.select("field", *[r6(c).alias(c) for c in ("gold_abstention_rate", "pred_abstention_rate", "abstain_precision", "abstain_recall")])


@query(f"""WITH {MODAL_ALL}, {GRADED}, c2 AS (SELECT field, avg(ag) AS agreement, avg((ag = 1)::INT) AS unanimous FROM m GROUP BY 1), acc AS (SELECT field, avg(hit::INT) AS accuracy FROM h GROUP BY 1)
SELECT field, round(agreement, 6) AS agreement, round(unanimous, 6) AS unanimous, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY round(agreement, 9), field) AS INTEGER) AS place FROM c2 LEFT JOIN acc USING (field)""")
def consistency_table(spark, d):
    agreement = grading.modal_agreement(all_runs(spark, d)).withColumn("agreement", F.round("agreement", 9))
    out = reporting.consistency_table(agreement, grading.field_accuracy(graded(spark, d)))
    return out.select("field", *[r6(c).alias(c) for c in ("agreement", "unanimous", "accuracy")], "place")


SETS = f"{SCORED}, f AS (SELECT y, unnest([{{'k': 'controls_only', 'p': p}}, {{'k': 'controls_plus_claims', 'p': (p + p2) / 2}}]) AS m FROM s), z AS (SELECT m.k AS feature_set, y, m.p AS p FROM f)"


def scored_sets(spark, d):
    two = F.array(F.struct(F.lit("controls_only").alias("feature_set"), F.col("p").alias("p")), F.struct(F.lit("controls_plus_claims").alias("feature_set"), ((F.col("p") + F.col("p2")) / 2).alias("p")))
    return scored(spark, d).select("y", F.explode(two).alias("m")).select("m.feature_set", "y", "m.p")


@query(f"""WITH {SETS}, r AS (SELECT feature_set, y, p, rank() OVER (PARTITION BY feature_set ORDER BY p) + (count(*) OVER (PARTITION BY feature_set, p) - 1) / 2.0 AS rk FROM z),
a AS (SELECT feature_set, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc, avg((p - y) ** 2) AS brier, 1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))) AS brier_skill FROM r GROUP BY 1),
b AS (SELECT auc AS a0, brier_skill AS s0 FROM a WHERE feature_set = 'controls_only')
SELECT feature_set, round(auc, 6) AS auc, round(brier, 6) AS brier, round(brier_skill, 6) AS brier_skill, round(auc - a0, 6) AS d_auc, round(brier_skill - s0, 6) AS d_skill FROM a, b""")
def ablation_table(spark, d):
    out = reporting.ablation_table(scored_sets(spark, d))
    return out.select("feature_set", *[r6(c).alias(c) for c in ("auc", "brier", "brier_skill", "d_auc", "d_skill")])


@query("SELECT stage, extractor, n FROM (SELECT 'events' AS stage, '' AS extractor, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'consistency', 'baseline', 4 UNION ALL SELECT 'ablation', 'baseline', 2)")
def report_stages(spark, d):
    """The stages that a report would show, in its order, with the rows of each: results are kept and found again by the manifest."""
    at = _place(spark, "report")
    reporting.record_stage(scored_sets(spark, d).limit(1), at, "ablation", "baseline", "0")  # an older version, which the next one takes over
    reporting.record_stage(reporting.ablation_table(scored_sets(spark, d)), at, "ablation", "baseline")
    reporting.record_stage(grading.modal_agreement(all_runs(spark, d)), at, "consistency", "baseline")
    reporting.record_stage(T(spark, d, "orders").select("o_orderkey"), at, "events")
    found = [tables.read(spark, r.path).select(F.lit(r.stage).alias("stage"), F.lit(r.extractor).alias("extractor")) for r in reporting.stage_results(spark, at).collect()]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("stage", "extractor").agg(F.count("*").alias("n"))


@query("""WITH mx AS (SELECT CAST(l_shipdate AS DATE) AS dt, avg(l_extendedprice / l_quantity) AS cl FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1),
ml AS (SELECT dt, ln(cl / lag(cl) OVER (ORDER BY dt)) AS lret FROM mx), e AS (SELECT dt FROM mx UNION SELECT max(dt) + CAST(k AS INTEGER) FROM mx, range(1, 4) t(k) GROUP BY k),
w AS (SELECT e.dt AS d, (SELECT stddev_samp(lret) * sqrt(252) FROM (SELECT lret FROM ml WHERE ml.dt < e.dt ORDER BY ml.dt DESC LIMIT 20)) AS rv FROM e)
SELECT d AS date, round(rv, 6) AS rv_market_pre FROM w""")
def market_windows(spark, d):
    """The market's window before each of its sessions and before three days past the last one."""
    returns = P.log_returns(prices(spark, d, True))
    past = P.window_past_end(returns)
    days = past.select(F.explode(F.sequence(F.date_add("last_session", 1), F.date_add("last_session", 3))).alias("date"))
    return P.market_before(days, P.event_windows(returns), past).select("date", r6("rv_market_pre").alias("rv_market_pre"))


#: Sentences that hold the rules' words; each document gets three of them, by its number.
SENTENCES = [
    "Revenue increased 12.5 percent to a record level.", "Revenue for the quarter declined by 3% as demand was soft.", "Revenue was roughly flat with the prior year.",
    "Earnings per share grew to 2.10, higher than before.", "EPS fell sharply on restructuring charges.", "Gross margin improved and momentum was strong.", "Operating margin contracted under pressure.",
    "We are raising our full-year guidance.", "The company lowered its outlook for fiscal 2024.", "We reaffirm our guidance for the quarter.", "We suspend our prior guidance given macroeconomic uncertainty and inflation.",
    "The board approved a dividend, up from last year.", "The quarterly dividend was lower.", "A repurchase program was authorized with an increase of two billion.", "Results include an impairment and a goodwill charge.",
    "The chief financial officer will step down; we are naming a new CFO and chief executive.", "The consumer segment saw weak sales.", "This was a one-time, non-recurring item.", "Adjusted and non-GAAP figures, adjusted for currency and tariff effects, are given.",
    "We believe and expect, and may plan to, though it could be uncertain.", "An exceptional, outstanding and excellent year; we are pleased and proud.", "It was a challenging, difficult and disappointing quarter with headwinds.",
    "This release contains forward-looking statements; revenue increased 99%.", "Nothing else is said here.",
]
_PICK = [("doc_id", 1), ("doc_id * 7 + 3", 1), ("doc_id", 24)]


@query(text_sql.claims("(SELECT doc_id, coalesce(text, '') || " + " || ".join(f"' ' || [{', '.join(text_sql._quoted(x) for x in SENTENCES)}][({e}) // {by} % {len(SENTENCES)} + 1]" for e, by in _PICK) + " AS text FROM documents)", "doc_id", "text"))
def rule_extract_said(spark, d):
    """rule_extract over whole documents that each say three sentences made of the rules' words."""
    said = F.array(*map(F.lit, SENTENCES))
    picks = [F.element_at(said, F.expr(f"CAST(({e}) div {by} % {len(SENTENCES)} + 1 AS INT)")) for e, by in _PICK]
    docs = T(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), *picks).alias("text"))
    return extraction.extract(docs).select("doc_id", "claims.*")


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?is).{0,10}(?:license|copyright).{0,10}')[1:3], chr(10)) AS hits FROM documents WHERE text IS NOT NULL")
def regex_context(spark, d):
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(X.search_context(F.col("text"), "license|copyright", 10, 3), "\n").alias("hits"))


@query("SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def jsonl_reviewed(spark, d):
    """Labelled documents written as JSON lines by two appends that overlap, of which the reviewed ones are read."""
    rows = T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("_reviewed"))
    path = _place(spark, "lines")
    sinks.append_jsonl(rows.where("lang = 'en'"), path, "doc_id")
    sinks.append_jsonl(rows, path, "doc_id")
    return L.read_jsonl(spark, path, "doc_id long, lang string, _reviewed boolean").select("doc_id", "lang")


@query("SELECT l_returnflag AS flag, count(*) AS n, CASE WHEN l_returnflag = 'A' THEN NULL ELSE round(avg(l_discount), 6) END AS mean FROM lineitem GROUP BY 1")
def csv_table(spark, d):
    """A table of results through the CSV writer, with a NaN for one row, which is an empty cell."""
    flags = T(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), r6(F.avg("l_discount")).alias("mean"))
    path = _place(spark, "csv")
    sinks.write_csv(flags.withColumn("mean", F.when(F.col("flag") == "A", F.lit(float("nan"))).otherwise(F.col("mean"))), path)
    return spark.read.option("header", True).schema("flag string, n long, mean double").csv(path)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS accession, CASE k WHEN 1 THEN 'EX-99.' || (o_orderkey % 3 + 1) ELSE '10-K' END AS type, k AS sequence, 'f' || o_custkey || '-' || k || '.htm' AS filename
FROM orders, (VALUES (1), (2)) t(k)""")
def filing_documents(spark, d):
    """The document tables of filings, one for each order, read from their headers."""
    entry = lambda kind, k: F.concat(F.lit("<TYPE>"), kind, F.lit(f"\n<SEQUENCE>{k}\n<FILENAME>f"), F.col("o_custkey").cast("string"), F.lit(f"-{k}.htm\n<TEXT>\n"))
    sgml = F.concat(entry(F.concat(F.lit("EX-99."), (F.col("o_orderkey") % 3 + 1).cast("string")), 1), entry(F.lit("10-K"), 2))
    return L.document_table(T(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("accession"), sgml.alias("sgml")))
