"""Queries of the sources, the claims record, reports and samples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import claims as C
from tidemark.operators import evaluation as E
from tidemark.operators import features as FT
from tidemark.operators import grading, sampling
from tidemark.operators import panel as P
from tidemark.operators import reporting as R
from tidemark.plans import queries as Q
from tidemark.plans.queries import GRADED, MODAL_ALL, ORACLE_SQL, PANEL, SCORED, T, query, r6
from tidemark.sources import landed as L


@query(f"""WITH {PANEL}, c AS (SELECT *, least(greatest(coalesce(date_diff('day', lag(t0) OVER (PARTITION BY ticker ORDER BY t0, id), t0), 91), 0), 250) AS dsp FROM lab WHERE drop_reason IS NULL)
SELECT id, round(ln(greatest(rv_pre, 1e-4)), 6) AS log_rv_pre, coalesce(round(ln(greatest(rv_market_pre, 1e-4)), 6), 0) AS log_rv_market_pre, coalesce(round(rv_pre / greatest(rv_market_pre, 1e-4), 6), 0) AS rv_ratio_to_market,
round(ln(greatest(adv, 1.0)), 6) AS log_dollar_volume, round(ln(greatest(prior_close, 0.01)), 6) AS log_price, CAST(quarter(t0) AS DOUBLE) AS quarter, CAST(month(t0) AS DOUBLE) AS month, CAST(dsp AS DOUBLE) AS days_since_prev,
0.0::DOUBLE AS timing__pre_market, 1.0::DOUBLE AS timing__intraday, 0.0::DOUBLE AS timing__after_hours, 0.0::DOUBLE AS timing__non_session FROM c""")
def features_control_all(spark, d):
    """All twelve control features."""
    events = P.days_since_previous(Q.labelled(spark, d).where("drop_reason is null")).withColumn("release_timing", F.lit("intraday"))
    m, blocks = FT.build_features(events, ["id"])
    return m.select("id", *[r6(c).alias(c) for c in blocks["control"]])


RECORD = {
    "revenue_direction": "CASE doc_id % 5 WHEN 0 THEN 'increased' WHEN 1 THEN 'decreased' WHEN 2 THEN 'flat' WHEN 3 THEN 'not_stated' ELSE 'sideways' END",
    "eps_direction": "'flat'", "margin_direction": "'not_stated'", "dividend_action": "'increased'", "guidance_action": "'raised'", "tone": "CASE WHEN doc_id % 7 = 0 THEN 'angry' ELSE 'neutral' END",
    **{f: "'true'" if i % 2 else "'false'" for i, f in enumerate(FT.BOOLEAN)},
    "non_gaap_emphasis": "CAST(n_chars % 5 AS {s})", "hedging_intensity": "CASE WHEN doc_id % 11 = 0 THEN '1.5' ELSE '2' END", "confidence": "'3'",
    "revenue_yoy_pct": "CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '-6.5' END", "guidance_horizon_quarters": "CASE WHEN doc_id % 13 = 0 THEN '2.5' ELSE '4' END",
}
_TEXT = {*FT.CATEGORICAL}


def _answers(spark, d):
    """Made-up JSON answers about the documents, some of them broken or out of range."""
    part = lambda f, e: F.concat(F.lit(f'"{f}": ' + ('"' if f in _TEXT else "")), F.expr(e.replace("{s}", "STRING")), F.lit('"' if f in _TEXT else ""))
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *[part(f, e) for f, e in RECORD.items()]), F.lit("}"))
    return T(spark, d, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 17 == 0, "not json").otherwise(whole).alias("answer"))


_FIRST = [("doc_id % 17 = 0", "unreadable: not a JSON object"), ("doc_id % 5 = 4", "invalid: revenue_direction"), ("doc_id % 7 = 0", "invalid: tone"), ("n_chars % 5 = 4", "invalid: non_gaap_emphasis"), ("doc_id % 11 = 0", "invalid: hedging_intensity"), ("doc_id % 13 = 0", "invalid: guidance_horizon_quarters")]
ERROR = "CASE " + " ".join(f"WHEN {c} THEN '{e}'" for c, e in _FIRST) + " END"


@query(f"WITH e AS (SELECT doc_id, n_chars, {ERROR} AS error FROM documents) SELECT doc_id, error IS NULL AS ok, error, CASE WHEN error IS NULL AND doc_id % 3 <> 0 THEN -6.5::DOUBLE END AS revenue_yoy_pct, CASE WHEN error IS NULL THEN n_chars % 5 END::INTEGER AS non_gaap_emphasis FROM e")
def claims_validation(spark, d):
    v = _answers(spark, d).select("doc_id", C.validate(F.col("answer")).alias("v"))
    return v.select("doc_id", "v.ok", "v.error", F.col("v.claims.revenue_yoy_pct").alias("revenue_yoy_pct"), F.col("v.claims.non_gaap_emphasis").alias("non_gaap_emphasis"))


@query(f"WITH e AS (SELECT doc_id, n_chars, {ERROR} AS error FROM documents) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'increased' WHEN 1 THEN 'decreased' WHEN 2 THEN 'flat' ELSE 'not_stated' END AS revenue_direction, CASE WHEN doc_id % 3 <> 0 THEN -6.5::DOUBLE END AS revenue_yoy_pct, true AS same FROM e WHERE error IS NULL")
def claims_json(spark, d):
    """Valid claims written as JSON and read back."""
    v = _answers(spark, d).select("doc_id", C.validate(F.col("answer")).alias("v")).where("v.ok")
    again = v.withColumn("c", C.from_json(C.to_json(F.col("v.claims"))))
    return again.select("doc_id", "c.revenue_direction", "c.revenue_yoy_pct", F.col("c").eqNullSafe(F.col("v.claims")).alias("same"))


@query(f"""WITH e AS (SELECT doc_id, n_chars, CASE WHEN text LIKE '%license%' THEN 'RuntimeError' ELSE split_part({ERROR.replace("n_chars % 5 = 4", "false")}, ':', 1) END AS error FROM documents)
SELECT coalesce(error, 'ok') AS outcome, count(*) AS n, CAST(sum(CASE WHEN error = 'RuntimeError' THEN 0 ELSE 10 END) AS BIGINT) AS output_tokens FROM e GROUP BY 1""")
def remote_extraction(spark, d):
    """Every document through an extractor that is called from workers: one of its own here, which fails on some and answers others wrongly."""
    docs = _answers(spark, d).join(T(spark, d, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.select("doc_id", F.concat(F.when(F.col("text").contains("license"), "!").otherwise(""), F.regexp_replace("answer", '"non_gaap_emphasis": 4', '"non_gaap_emphasis": 3')).alias("asked"))

    def answer(asked: str) -> dict:
        if asked.startswith("!"):
            raise RuntimeError("no answer")
        return {"answer": asked, "output_tokens": 10}

    got = C.extracted_by(docs, answer, key="doc_id", text="asked", retries=2, wait=0.0)
    return got.groupBy(F.coalesce(F.substring_index("error", ":", 1), F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"))


_RAW = "CASE doc_id % 9 WHEN 0 THEN ' 2 ' WHEN 1 THEN 'NULL' WHEN 2 THEN 'up' WHEN 3 THEN '7' WHEN 4 THEN '2.5' WHEN 5 THEN '-' WHEN 6 THEN 'true' WHEN 7 THEN '1' ELSE 'x' END"
_KIND = "CASE doc_id % 4 WHEN 0 THEN 'enum' WHEN 1 THEN 'bool' WHEN 2 THEN 'ordinal' ELSE 'numeric' END"


@query(f"""WITH r AS (SELECT doc_id, lower(trim({_RAW})) AS t, {_KIND} AS k FROM documents), v AS (SELECT doc_id, k = 'numeric' AND t IN ('null', '-') AS none,
CASE WHEN k = 'enum' THEN CASE WHEN t IN ('up', 'down') THEN t WHEN t = '1' THEN 'up' WHEN t = '2' THEN 'down' END WHEN k = 'bool' THEN CASE WHEN t IN ('true', 'false') THEN t WHEN t = '1' THEN 'true' WHEN t = '2' THEN 'false' END
WHEN k = 'ordinal' THEN CASE WHEN t IN ('1', '2') THEN t END ELSE CASE WHEN t IN ('1', '2', '7') THEN t END END AS value FROM r) SELECT doc_id, none OR value IS NOT NULL AS ok, value FROM v""")
def gold_answers(spark, d):
    r = T(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("raw"), F.expr(_KIND).alias("kind"))
    choices = F.when(F.col("kind") == "bool", F.array(F.lit("true"), F.lit("false"))).otherwise(F.array(F.lit("up"), F.lit("down")))
    return r.select("doc_id", C.parse_answer(F.col("kind"), F.col("raw"), choices, F.col("kind") == "numeric", F.lit(True)).alias("v")).select("doc_id", "v.ok", "v.value")


@query(f"""WITH {GRADED}, a AS (SELECT field, avg(hit::INT) AS acc FROM h GROUP BY 1), t AS (SELECT field, coalesce(gold, 'None') AS g, coalesce(pred, 'None') AS p FROM g WHERE kind IN ('categorical', 'boolean')),
k AS (SELECT field, g AS c FROM t UNION SELECT field, p FROM t), f AS (SELECT k.field, k.c, 2.0 * count(*) FILTER (g = c AND p = c) / (count(*) FILTER (g = c) + count(*) FILTER (p = c)) AS f1 FROM k JOIN t ON t.field = k.field GROUP BY 1, 2),
m AS (SELECT field, avg(f1) AS f1 FROM f GROUP BY 1), x AS (SELECT id, min(hit::INT) AS a FROM h GROUP BY 1)
SELECT (SELECT count(*) FROM x) AS n_documents, (SELECT round(avg(a), 6) FROM x) AS document_exact_match, (SELECT count(*) FROM a) AS n_fields, (SELECT round(avg(acc), 6) FROM a) AS mean_field_accuracy, (SELECT round(avg(f1), 6) FROM m) AS mean_macro_f1,
(SELECT field FROM a ORDER BY acc, field LIMIT 1) AS worst_field, (SELECT round(min(acc), 6) FROM a) AS worst_field_accuracy""".replace("CAST(pred AS DOUBLE)", "TRY_CAST(pred AS DOUBLE)").replace("CAST(gold AS DOUBLE)", "TRY_CAST(gold AS DOUBLE)").replace("TRY_TRY_", "TRY_"))
def extraction_summary(spark, d):
    s = R.extraction_summary(Q.graded(spark, d))
    return s.select("n_documents", r6("document_exact_match").alias("document_exact_match"), "n_fields", r6("mean_field_accuracy").alias("mean_field_accuracy"), r6("mean_macro_f1").alias("mean_macro_f1"), "worst_field", r6("worst_field_accuracy").alias("worst_field_accuracy"))


@query(f"WITH {MODAL_ALL}, t AS (SELECT field, avg(ag) AS a FROM m GROUP BY 1) SELECT round(avg(a), 6) AS mean_agreement, arg_min(field, a) AS least_stable_field FROM t")
def consistency_summary(spark, d):
    s = R.consistency_summary(grading.modal_agreement(Q.all_runs(spark, d)))
    return s.select(r6("mean_agreement").alias("mean_agreement"), "least_stable_field")


@query(ORACLE_SQL["textprep_full"].split("SELECT doc_id, length(text) AS original_chars")[0] + """, z AS (SELECT length(text) AS n, trimmed, length(whole) > 70000 AS hard, length(trim(CASE WHEN length(whole) <= 70000 THEN whole WHEN back > 0 AND 70000 - back - 1 > 56000 THEN left(part, 70000 - back - 1) ELSE part END, chr(32) || chr(10) || chr(9))) AS k FROM w)
SELECT round(1 - sum(k) / sum(n), 6) AS saved, count(*) FILTER (trimmed) AS n_trimmed, count(*) FILTER (hard) AS n_truncated, count(*) AS n FROM z""")
def character_savings(spark, d):
    p = T(spark, d, "documents").select(X.prepare(F.col("text"), markers=["(?:licensed|released) under"], guidance="(?:Public|MIT) License").alias("p"))
    return R.character_savings(p).withColumn("saved", r6("saved"))


@query("""WITH r AS (SELECT n_chars, doc_id % 11 <> 0 AS ok, n_chars / 1000.0 AS lat, row_number() OVER (ORDER BY n_chars) - 1 AS p, count(*) OVER () AS n FROM documents)
SELECT count(*) AS docs, count(*) FILTER (ok) AS ok, CAST(sum(n_chars) FILTER (ok) AS BIGINT) AS prompt_tokens, round(sum(n_chars) FILTER (ok) / 60.0, 6) AS prompt_per_s, CAST(sum(n_chars % 7) FILTER (ok) AS BIGINT) AS output_tokens, round(sum(n_chars % 7) FILTER (ok) / 60.0, 6) AS output_per_s,
round(60.0 / count(*), 6) AS s_per_doc, CAST(max(lat) AS DOUBLE) AS latency_max, CAST(max(lat) FILTER (p = n // 2) AS DOUBLE) AS latency_median FROM r""")
def throughput(spark, d):
    t = R.throughput(Q.results(spark, d), 60.0)
    return t.select(*[r6(c).alias(c) if c.endswith("_per_s") or c == "s_per_doc" else c for c in t.columns])


@query(f"""WITH {GRADED.replace('CAST(pred', 'TRY_CAST(pred').replace('CAST(gold', 'TRY_CAST(gold')}, a AS (SELECT field, avg(hit::INT) AS acc FROM h GROUP BY 1) SELECT field, round(acc, 6) AS accuracy, CASE WHEN field <> 'revenue' THEN 1.0::DOUBLE END AS baseline FROM a""")
def quality_table(spark, d):
    """Accuracies beside those of a run that equals gold and lacks a field."""
    gold = Q.answers(spark, d, 0).withColumn("kind", F.expr(Q.KINDS))
    own = grading.field_accuracy(grading.graded(Q.answers(spark, d, 0).where("field != 'revenue'"), gold))
    return R.quality_table(grading.field_accuracy(Q.graded(spark, d)), own).select("field", r6("accuracy").alias("accuracy"), "baseline")


def _landed(spark, d):
    """Histories of users as landed JSON: their even events in the recent block, the odd ones in a shard; one shard in five has not landed."""
    arrays = {"accessionNumber": "CAST(event_id AS STRING)", "form": "CASE WHEN event_id % 3 = 0 THEN '8-K' ELSE '10-Q' END", "filingDate": "CAST(CAST(ts AS DATE) AS STRING)", "reportDate": "CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(date_sub(CAST(ts AS DATE), 1) AS STRING) END", "items": "CASE WHEN event_id % 2 = 0 THEN '2.02,9.01' ELSE concat('2.0', CAST(event_id % 3 AS STRING)) END"}
    rows = T(spark, d, "events").select("user_id", (F.col("event_id") % 2 == 0).alias("recent"), F.struct(*[F.expr(e).alias(a) for a, e in arrays.items()]).alias("s"))
    block = rows.groupBy("user_id", "recent").agg(F.collect_list("s").alias("s")).select("user_id", "recent", F.struct(*[F.col(f"s.{a}").alias(a) for a in arrays]).alias("b"))
    name = F.concat(F.lit("older-"), F.col("user_id").cast("string"), F.lit(".json"))
    files = block.groupBy("user_id").agg(F.max(F.when(F.col("recent"), F.col("b"))).alias("recent"), F.max((~F.col("recent")).cast("int")).alias("older"))
    files = files.withColumn("files", F.when(F.col("older") == 1, F.array(F.struct(name.alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")))
    histories = files.select(F.col("user_id").cast("string").alias("ticker"), F.col("user_id").alias("cik"), F.to_json(F.struct(F.struct("recent", "files").alias("filings"))).alias("value"))
    return histories, block.where("not recent and user_id % 5 != 0").select(name.alias("name"), F.to_json("b").alias("value"))


@query("SELECT CAST(user_id AS VARCHAR) AS ticker, user_id AS cik, CAST(event_id AS VARCHAR) AS accession, '' AS \"primaryDocument\" FROM events WHERE event_id % 2 = 0 OR user_id % 5 <> 0")
def submissions(spark, d):
    return L.submissions(*_landed(spark, d)).select("ticker", "cik", F.col("accessionNumber").alias("accession"), "primaryDocument")


@query("SELECT DISTINCT 'older-' || user_id || '.json' AS name FROM events WHERE event_id % 2 = 1 AND user_id % 5 = 0")
def missing_shards(spark, d):
    return L.missing_shards(*_landed(spark, d))


@query("""SELECT CAST(event_id AS VARCHAR) AS accession, CAST(CAST(ts AS DATE) AS VARCHAR) AS filed, CASE WHEN event_id % 4 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE CAST(CAST(ts AS DATE) - 1 AS VARCHAR) END AS reported FROM events
WHERE (event_id % 2 = 0 OR user_id % 5 <> 0) AND event_id % 3 = 0 AND event_id % 2 = 0 AND CAST(CAST(ts AS DATE) AS VARCHAR) BETWEEN '2024-01-02' AND '2024-01-20'""")
def filings_selected(spark, d):
    some = L.select_filings(L.submissions(*_landed(spark, d)), "2.02", "2024-01-02", "2024-01-20")
    return some.select(F.col("accessionNumber").alias("accession"), F.col("filingDate").alias("filed"), F.col("reportDate").alias("reported"))


@query("SELECT 'T' || c_custkey // 2 AS ticker, max(c_custkey) AS cik, arg_max(c_name, c_custkey) AS title FROM customer GROUP BY 1")
def ticker_map(spark, d):
    """Landed maps, one for each of a few files, in which every second ticker comes again."""
    c = T(spark, d, "customer").select(F.format_string("%06d", F.floor(F.col("c_custkey") / 500).cast("int")).alias("file"), F.col("c_custkey"), F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("T"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("ticker"), F.col("c_name").alias("title")).alias("e"))
    entry = F.struct(F.format_string("%012d", "c_custkey").alias("key"), F.col("e").alias("value"))
    return L.ticker_map(c.groupBy("file").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")))


@query("SELECT doc_id, length(left(text, 2000)) AS n, sha256(left(text, 2000)) AS text_sha256 FROM documents WHERE length(text) >= 500")
def press_releases(spark, d):
    r = L.press_releases(T(spark, d, "documents").select("doc_id", "text"), most=2000)
    return r.select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT t AS ticker FROM (SELECT CAST(c_custkey AS VARCHAR) AS t FROM customer UNION SELECT 'SPY') WHERE t NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)")
def missing_symbols(spark, d):
    wanted = L.wanted_symbols(T(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker")))
    return L.missing_symbols(wanted, T(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ticker")))


@query("SELECT l.doc_id, l.quality, length(d.text) AS n FROM labels l JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL")
def filings_with_documents(spark, d):
    docs = T(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("accession"), "text")
    out = L.with_documents(T(spark, d, "labels").select(F.col("doc_id").alias("accession"), "quality"), docs)
    return out.select(F.col("accession").alias("doc_id"), "quality", F.length("text").cast("long").alias("n"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_by_key(spark, d):
    return L.first_by(T(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT event_id, replace(substr(lpad(CAST(event_id AS VARCHAR), 18, '0'), 1, 10) || '-' || substr(lpad(CAST(event_id AS VARCHAR), 18, '0'), 11, 2) || '-' || substr(lpad(CAST(event_id AS VARCHAR), 18, '0'), 13), '-', '') AS accession, 'CIK' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS cik FROM events")
def accession_names(spark, d):
    n = F.lpad(F.col("event_id").cast("string"), 18, "0")
    dashed = F.concat_ws("-", F.substring(n, 1, 10), F.substring(n, 11, 2), F.substring(n, 13, 6))
    return T(spark, d, "events").select("event_id", X.straighten_accession(dashed).alias("accession"), X.cik_name(F.col("user_id")).alias("cik"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 40")
def simple_sample(spark, d):
    return sampling.simple_sample(T(spark, d, "orders").select("o_orderkey"), "o_orderkey", 40)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def first_rows(spark, d):
    return sampling.first_rows(T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), 25, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"WITH {SCORED} SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg((p - y) ** 2) - avg((p2 - y) ** 2), 6) AS d_brier, max(i) AS last FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM s)")
def paired_predictions(spark, d):
    s = Q.scored(spark, d).withColumnRenamed("doc_id", "id")
    both = E.paired(s.select("id", "y", "p"), s.select("id", "y", F.col("p2").alias("p")))
    return both.agg(F.count("*").alias("n"), F.sum("y").alias("positives"), r6(F.avg((F.col("p_base") - F.col("y")) ** 2) - F.avg((F.col("p_cand") - F.col("y")) ** 2)).alias("d_brier"), F.max("i").alias("last"))


@query(ORACLE_SQL["paired_bootstrap"].replace("sum((m.p - y) ** 2) AS err FROM", "sum((m.p - y) ** 2) AS err, sum((0.4 - y) ** 2) AS ref FROM").replace("sum(err) / sum(pos + neg) AS brier FROM", "1 - sum(err) / sum(ref) AS brier FROM").split("x AS (SELECT b")[0]
       + "x AS (SELECT b, sum(CASE WHEN c = 1 THEN brier ELSE -brier END) AS ds FROM a WHERE auc IS NOT NULL GROUP BY 1) SELECT count(*) AS rounds, round(avg(ds), 6) AS d_skill, round(quantile_cont(ds, 0.025), 6) AS skill_low, round(quantile_cont(ds, 0.975), 6) AS skill_high, round(avg((ds > 0)::INT), 6) AS p_skill FROM x")
def paired_bootstrap_skill(spark, d):
    """The change of Brier skill against a constant of 0.4, in 100 rounds."""
    s = Q.scored(spark, d).withColumnRenamed("doc_id", "id")
    out = E.paired_bootstrap(E.paired(s.select("id", "y", "p"), s.select("id", "y", F.col("p2").alias("p"))), 100, base_rate=0.4)
    return out.select("rounds", *[r6(c).alias(c) for c in ("d_skill", "skill_low", "skill_high", "p_skill")])


@query("SELECT p_partkey, round_even(p_retailprice / 7, 2) AS shown FROM part")
def display_rounding(spark, d):
    return R.display(T(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 7).alias("shown")), 2)


@query("WITH n AS (SELECT DISTINCT CASE c_custkey % 6 WHEN 0 THEN 'x_local.json' WHEN 1 THEN 'x_baseline.json' WHEN 2 THEN 'x_zeta.json' WHEN 3 THEN 'x_alpha.json' WHEN 4 THEN 'y_local.json' ELSE 'x_local-sample.json' END AS f FROM customer) SELECT f[3:-6] AS name, CASE f[3:-6] WHEN 'baseline' THEN 0 WHEN 'local' THEN 1 WHEN 'local-sample' THEN 2 ELSE 4 END AS place FROM n WHERE f LIKE 'x\\_%' ESCAPE '\\'")
def artifacts_found(spark, d):
    e = "CASE c_custkey % 6 WHEN 0 THEN 'x_local.json' WHEN 1 THEN 'x_baseline.json' WHEN 2 THEN 'x_zeta.json' WHEN 3 THEN 'x_alpha.json' WHEN 4 THEN 'y_local.json' ELSE 'x_local-sample.json' END"
    return R.extractor_names(T(spark, d, "customer").select(F.expr(e).alias("file")).distinct(), "x_", ".json")


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS n FROM documents")
def tolerant_json(spark, d):
    """Landed JSON of which a third is cut off."""
    whole = F.to_json(F.struct(F.col("doc_id").alias("n")))
    landed = T(spark, d, "documents").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 3 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("value"))
    return L.tolerant_json(landed, "n long").select(F.col("file").alias("doc_id"), "data.n")


@query(f"WITH {PANEL} SELECT DISTINCT t0 AS date, t0 - 120 AS since FROM ev")
def padded_starts(spark, d):
    return Q.panel_events(spark, d).select(F.col("t0").alias("date")).distinct().withColumn("since", P.padded_start(F.col("date")))
