"""Named queries of the operators over the driver's tables, each with SQL for an independent engine where SQL can express it.

lineitem stands for prices (ticker = supplier, weekdays are sessions), the last session of each supplier's quarter for events,
events for timed filings, documents and labels for extractions and gold answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evaluation as E
from tidemark.operators import extraction, grading, sampling
from tidemark.operators import features as FT
from tidemark.operators import panel as P
from tidemark.operators.asof import asof_join
from tidemark.operators.ranks import placed
from tidemark.plans import text_sql
from tidemark.sources import landed as L
from tidemark.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def prices(spark, d, market: bool = False) -> DataFrame:
    ticker = F.lit("MKT") if market else F.col("l_suppkey").cast("string")
    days = T(spark, d, "lineitem").where(F.expr("weekday(l_shipdate) < 5")).select(ticker.alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity")
    return days.groupBy("ticker", "date").agg(F.avg("px").alias("close"), F.sum("l_quantity").alias("volume"))


def panel_events(spark, d) -> DataFrame:
    p = prices(spark, d).groupBy("ticker", F.year("date").alias("yr"), F.quarter("date").alias("q")).agg(F.max("date").alias("t0"))
    return p.select(F.concat_ws("-", "ticker", "t0").alias("id"), "ticker", "t0")


def labelled(spark, d) -> DataFrame:
    market = P.event_windows(P.log_returns(prices(spark, d, True)))
    return P.event_labels(panel_events(spark, d), P.event_windows(P.log_returns(prices(spark, d))), market)


PANEL = """
px AS (SELECT CAST(l_suppkey AS VARCHAR) ticker, CAST(l_shipdate AS DATE) AS dt, avg(l_extendedprice / l_quantity) AS cl, sum(l_quantity) AS vol
       FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1, 2),
mx AS (SELECT CAST(l_shipdate AS DATE) AS dt, avg(l_extendedprice / l_quantity) AS cl FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1),
lr AS (SELECT *, ln(cl / lag(cl) OVER (PARTITION BY ticker ORDER BY dt)) AS lret FROM px),
ml AS (SELECT *, ln(cl / lag(cl) OVER (ORDER BY dt)) AS lret FROM mx),
mw AS (SELECT dt, stddev_samp(lret) OVER (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * sqrt(252) AS rv_market_pre FROM ml),
win AS (SELECT ticker, dt, stddev_samp(lret) OVER a * sqrt(252) AS rv_pre, stddev_samp(lret) OVER b * sqrt(252) AS rv_post, count(lret) OVER a AS n_pre, count(lret) OVER b AS n_post,
        lag(cl) OVER (PARTITION BY ticker ORDER BY dt) AS prior_close, avg(cl * vol) OVER a AS adv
        FROM lr WINDOW a AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
ev AS (SELECT ticker || '-' || max(dt) AS id, ticker, max(dt) AS t0 FROM px GROUP BY ticker, year(dt), quarter(dt)),
lab0 AS (SELECT ev.*, w.*EXCLUDE (ticker, dt), mw.rv_market_pre, CASE WHEN n_pre < 15 THEN 'insufficient_pre_window' WHEN n_post < 5 THEN 'insufficient_post_window'
         WHEN rv_pre IS NULL OR rv_post IS NULL OR rv_pre <= 0 THEN 'degenerate_volatility' END AS drop_reason
         FROM ev JOIN win w ON w.ticker = ev.ticker AND w.dt = ev.t0 LEFT JOIN mw ON mw.dt = ev.t0),
lab AS (SELECT *, CASE WHEN drop_reason IS NULL THEN rv_post / rv_pre END AS vol_expansion FROM lab0)
"""


@query(f"WITH {PANEL} SELECT ticker, dt AS date, round(lret, 6) AS log_return FROM lr")
def log_returns(spark, d):
    return P.log_returns(prices(spark, d)).select("ticker", "date", r6("log_return").alias("log_return"))


@query(f"WITH {PANEL} SELECT ticker, dt AS date, round(rv_pre, 6) AS rv_pre, round(rv_post, 6) AS rv_post, n_pre, n_post, round(prior_close, 6) AS prior_close, round(adv, 2) AS avg_dollar_volume FROM win")
def pre_post_vol(spark, d):
    w = P.event_windows(P.log_returns(prices(spark, d)))
    return w.select("ticker", "date", r6("rv_pre").alias("rv_pre"), r6("rv_post").alias("rv_post"), "n_pre", "n_post", r6("prior_close").alias("prior_close"), F.round("avg_dollar_volume", 2).alias("avg_dollar_volume"))


TIMING = """
e AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS wall FROM events),
dd AS (SELECT DISTINCT CAST(wall AS DATE) AS s FROM e WHERE isodow(wall) <= 5),
f AS (SELECT event_id, CAST(wall AS DATE) AS dy, CAST(wall AS TIME) AS tm, dd.s IS NOT NULL AS is_session FROM e LEFT JOIN dd ON dd.s = CAST(wall AS DATE)),
g AS (SELECT *, CASE WHEN NOT is_session THEN 'non_session' WHEN tm < TIME '09:30:00' THEN 'pre_market' WHEN tm < TIME '16:00:00' THEN 'intraday' ELSE 'after_hours' END AS release_timing FROM f),
h AS (SELECT g.*, n.s AS nxt FROM g ASOF LEFT JOIN dd n ON g.dy < n.s)
"""


def timed(spark, d) -> DataFrame:
    e = T(spark, d, "events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("accepted"), F.to_date("ts").alias("filing_date"))
    local = e.select(F.to_date(P.parse_acceptance(F.col("accepted"))).alias("date")).where(F.expr("weekday(date) < 5"))
    return P.event_timing(e, P.calendar(local))


@query(f"WITH {TIMING} SELECT event_id, release_timing, CASE WHEN release_timing IN ('pre_market', 'intraday') THEN dy ELSE nxt END AS t0 FROM h")
def event_t0_asof(spark, d):
    return timed(spark, d).select("event_id", "release_timing", "t0")


@query(f"WITH {TIMING} SELECT release_timing, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM h GROUP BY 1")
def timing_share(spark, d):
    from pyspark.sql import Window

    n = timed(spark, d).groupBy("release_timing").agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(f"WITH {PANEL} SELECT id, ticker, t0, round(rv_pre, 6) AS rv_pre, round(rv_post, 6) AS rv_post, round(rv_market_pre, 6) AS rv_market_pre, drop_reason, round(vol_expansion, 6) AS vol_expansion, CAST(vol_expansion > 1.5 AS INTEGER) AS y FROM lab")
def event_labels(spark, d):
    return labelled(spark, d).select("id", "ticker", "t0", *[r6(c).alias(c) for c in ("rv_pre", "rv_post", "rv_market_pre")], "drop_reason", r6("vol_expansion").alias("vol_expansion"), "y")


@query(f"WITH {PANEL} SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n, count(*) FILTER (vol_expansion > 1.5) AS positives FROM lab GROUP BY 1")
def drop_reasons(spark, d):
    return labelled(spark, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("y") == 1, F.lit(False))).alias("positives"))


@query(f"WITH {PANEL} SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, min(t0) AS first_day, max(t0) AS last_day, round(avg(CAST(vol_expansion > 1.5 AS INTEGER)), 6) AS positive_share, round(median(vol_expansion), 6) AS median_expansion FROM lab WHERE drop_reason IS NULL")
def label_summary(spark, d):
    kept = written(labelled(spark, d).where("drop_reason is null").select("ticker", "t0", "y", "vol_expansion"), "labels")
    return kept.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("t0").alias("first_day"), F.max("t0").alias("last_day"), r6(F.avg("y")).alias("positive_share")).join(F.broadcast(E.quantiles(kept, "vol_expansion", [0.5]).select(r6(F.col("quantiles")[0]).alias("median_expansion"))))


@query(f"WITH {PANEL} SELECT id, least(greatest(coalesce(date_diff('day', lag(t0) OVER (PARTITION BY ticker ORDER BY t0, id), t0), 91), 0), 250) AS days_since_prev FROM ev")
def days_since_prev(spark, d):
    return P.days_since_previous(panel_events(spark, d)).select("id", F.col("days_since_prev").cast("long").alias("days_since_prev"))


@query(f"""WITH {PANEL}, c AS (SELECT *, least(greatest(coalesce(date_diff('day', lag(t0) OVER (PARTITION BY ticker ORDER BY t0, id), t0), 91), 0), 250) AS dsp FROM lab WHERE drop_reason IS NULL)
SELECT id, round(ln(greatest(rv_pre, 1e-4)), 6) AS log_rv_pre, coalesce(round(ln(greatest(rv_market_pre, 1e-4)), 6), 0) AS log_rv_market_pre, coalesce(round(rv_pre / greatest(rv_market_pre, 1e-4), 6), 0) AS rv_pre_ratio,
round(ln(greatest(adv, 1.0)), 6) AS log_dollar_volume, round(ln(greatest(prior_close, 0.01)), 6) AS log_price, CAST(quarter(t0) AS DOUBLE) AS quarter, CAST(month(t0) AS DOUBLE) AS month, CAST(dsp AS DOUBLE) AS days_since_prev,
1.0::DOUBLE AS timing__intraday, 0.0::DOUBLE AS timing__pre_market FROM c""")
def features_control(spark, d):
    events = P.days_since_previous(labelled(spark, d).where("drop_reason is null")).withColumn("release_timing", F.lit("intraday"))
    m, _ = FT.build_features(events, ["id"])
    m = m.withColumnRenamed("rv_ratio_to_market", "rv_pre_ratio")  # as this query's SQL names it
    return m.select("id", *[r6(c).alias(c) for c in ("log_rv_pre", "log_rv_market_pre", "rv_pre_ratio", "log_dollar_volume", "log_price", "quarter", "month", "days_since_prev", "timing__intraday", "timing__pre_market")])


ANSWERS = """CASE doc_id % 5 WHEN 0 THEN 'confident' WHEN 1 THEN 'neutral' WHEN 2 THEN 'cautious' WHEN 3 THEN 'not_stated' END"""


def claims(spark, d) -> DataFrame:
    """Made-up claims of the documents: a categorical with nulls, a flag, an ordinal and a nullable number."""
    return T(spark, d, "documents").select("doc_id", F.expr(ANSWERS).alias("claim_tone"), (F.col("doc_id") % 3 == 0).alias("claim_announced_buyback"), (F.col("n_chars") % 4).cast("int").alias("claim_hedging_intensity"), F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 41 - 20).cast("double")).alias("claim_revenue_yoy_pct"))


@query(f"""WITH c AS (SELECT doc_id, {ANSWERS} AS t, n_chars FROM documents)
SELECT doc_id, coalesce(t = 'confident', false)::INT AS tone__confident, coalesce(t = 'neutral', false)::INT AS tone__neutral, coalesce(t = 'cautious', false)::INT AS tone__cautious, coalesce(t = 'not_stated', false)::INT AS tone__not_stated,
(doc_id % 3 = 0)::INT AS announced_buyback, (n_chars % 4)::DOUBLE AS hedging_intensity, CASE WHEN doc_id % 2 = 0 THEN (n_chars % 41 - 20)::DOUBLE ELSE 0 END AS revenue_yoy_pct, (doc_id % 2 <> 0)::INT AS revenue_yoy_pct_missing, CASE WHEN doc_id % 2 = 0 THEN abs(n_chars % 41 - 20)::DOUBLE ELSE 0 END AS revenue_yoy_abs FROM c""")
def features_claim_onehot(spark, d):
    c = claims(spark, d)
    return c.select("doc_id", *[v.alias(k) for k, v in FT.claim_block(c.columns).items()])


def dated(spark, d) -> DataFrame:
    return T(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.max("o_orderdate")).alias("date"))


ORDERED = "o AS (SELECT o_custkey AS id, CAST(max(o_orderdate) AS DATE) AS dt FROM orders GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY dt, id) - 1 AS pos, count(*) OVER () AS n FROM o)"


@query(f"""WITH {ORDERED}, f AS (SELECT unnest(range(1, 6)) AS fold), q AS (SELECT fold, n // 6 AS size, fold * (n // 6) AS cut, dt AS start FROM f, p WHERE pos = fold * (n // 6)),
r AS (SELECT fold, id, CASE WHEN pos >= cut AND pos < cut + size THEN 'test' WHEN pos < cut AND dt < start - INTERVAL 10 DAY THEN 'train' END AS role FROM p, q)
SELECT CAST(fold AS INTEGER) AS fold, id, role FROM r WHERE role IS NOT NULL AND fold IN (SELECT fold FROM r WHERE role = 'train' GROUP BY 1 HAVING count(*) >= 20)""")
def purged_splits(spark, d):
    return E.purged_splits(dated(spark, d))


@query(f"""WITH {ORDERED}, c AS (SELECT dt AS start, pos AS cut FROM p WHERE pos = CAST(floor(n * 0.8) AS BIGINT))
SELECT id, CASE WHEN pos >= cut THEN 'test' ELSE 'train' END AS role FROM p, c WHERE pos >= cut OR dt < start - INTERVAL 10 DAY""")
def holdout_split(spark, d):
    return E.holdout_split(dated(spark, d))


def scored(spark, d) -> DataFrame:
    """Made-up probabilities, with ties, for the labelled documents."""
    both = T(spark, d, "labels").join(T(spark, d, "documents"), "doc_id")
    return both.select("doc_id", F.col("quality").alias("y"), (((F.col("n_chars") * 7919 + F.col("doc_id")) % 100) / 100.0).cast("double").alias("p"), ((F.col("n_chars") % 97) / 97.0).cast("double").alias("p2"))


SCORED = "s AS (SELECT doc_id, quality AS y, CAST(((n_chars * 7919 + doc_id) % 100) / 100.0 AS DOUBLE) AS p, CAST((n_chars % 97) / 97.0 AS DOUBLE) AS p2 FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r")
def auc_rank(spark, d):
    return E.auc(scored(spark, d)).select(r6("auc").alias("auc"))


@query(f"WITH {SCORED} SELECT round(avg((p - y) ** 2), 6) AS brier, round(1 - avg((p - y) ** 2) / avg((0.4 - y) ** 2), 6) AS brier_skill FROM s")
def brier_skill(spark, d):
    return E.brier_skill(scored(spark, d), F.lit(0.4).cast("double")).select(r6("brier").alias("brier"), r6("brier_skill").alias("brier_skill"))


@query(f"WITH {SCORED}, c AS (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM s) SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM c")
def log_loss(spark, d):
    return E.log_loss(scored(spark, d)).select(r6("log_loss").alias("log_loss"))


BINS = f"{SCORED}, e AS (SELECT list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS ed FROM s), i AS (SELECT list_sort(ed)[2:len(ed) - 1] AS inner_e FROM e), b AS (SELECT y, p, len(list_filter(inner_e, lambda x: x <= p)) AS bin FROM s, i), r AS (SELECT bin, avg(p) AS mean_p, avg(y) AS observed, count(*) AS n FROM b GROUP BY 1)"


@query(f"WITH {BINS} SELECT CAST(bin AS INTEGER) AS bin, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed, n FROM r")
def reliability_curve(spark, d):
    return E.reliability(scored(spark, d)).select("bin", r6("mean_p").alias("mean_p"), r6("observed").alias("observed"), "n")


@query(f"WITH {BINS} SELECT round(sum(n * abs(observed - mean_p)) / sum(n), 6) AS ece FROM r")
def ece_quantile(spark, d):
    return E.expected_calibration_error(scored(spark, d)).select(r6("ece").alias("ece"))


@query(f"""WITH {SCORED}, i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, y, p, p2 FROM s), n AS (SELECT count(*) AS n FROM i),
w AS (SELECT b, CAST('0x' || substr(md5('42|' || b || '|' || k), 1, 8) AS BIGINT) % n AS i FROM n, range(100) t(b), LATERAL (SELECT unnest(range(n)) AS k)),
m AS (SELECT b, y, unnest([{{'c': 0, 'p': p}}, {{'c': 1, 'p': p2}}]) AS m FROM w JOIN i USING (i)),
l AS (SELECT b, m.c AS c, m.p AS p, sum(y) AS pos, sum(1 - y) AS neg, sum((m.p - y) ** 2) AS err FROM m GROUP BY ALL),
v AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b, c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l),
a AS (SELECT b, c, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc, sum(err) / sum(pos + neg) AS brier FROM v GROUP BY 1, 2),
x AS (SELECT b, sum(CASE WHEN c = 1 THEN auc ELSE -auc END) AS da, sum(CASE WHEN c = 1 THEN -brier ELSE brier END) AS db FROM a GROUP BY 1)
SELECT count(*) AS rounds, round(avg(da), 6) AS d_auc, round(quantile_cont(da, 0.025), 6) AS auc_low, round(quantile_cont(da, 0.975), 6) AS auc_high, round(avg((da > 0)::INT), 6) AS p_auc, round(avg(db), 6) AS d_brier, round(quantile_cont(db, 0.025), 6) AS brier_low, round(quantile_cont(db, 0.975), 6) AS brier_high FROM x""")
def paired_bootstrap(spark, d):
    pairs = placed(scored(spark, d), [F.col("doc_id")], name="i")
    out = E.paired_bootstrap(pairs.select("i", "y", F.col("p").alias("p_base"), F.col("p2").alias("p_cand")), 100)
    return out.select("rounds", *[r6(c).alias(c) for c in out.columns[1:]])


_MOD, _M1, _M2, _M3 = 1 << 64, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def poisson_sql(rounds: int) -> str:
    """Weights of rows by round and what they give, as bootstrap_vectors draws them."""
    mixed = lambda z, k, m: f"CAST(CAST(xor({z}, {z} >> {k}) AS UHUGEINT) * {m} % {_MOD} AS UBIGINT)"
    weight = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in E.POISSON)
    return f"""WITH {SCORED}, z0 AS (SELECT doc_id, y, p, p2, b, CAST((CAST(doc_id AS UHUGEINT) * {_M1} % {_MOD} + {42 * _M3 % _MOD} + CAST(b AS UHUGEINT) * {_M2} % {_MOD}) % {_MOD} AS UBIGINT) AS z FROM s, range({rounds}) t(b)),
z1 AS (SELECT * REPLACE ({mixed('z', 30, _M2)} AS z) FROM z0), z2 AS (SELECT * REPLACE ({mixed('z', 27, _M3)} AS z) FROM z1), w AS (SELECT *, xor(z, z >> 31) >> 11 AS u FROM z2),
m AS (SELECT b, y, {weight} AS w, unnest([{{'c': 0, 'p': p}}, {{'c': 1, 'p': p2}}]) AS m FROM w),
l AS (SELECT b, m.c AS c, m.p AS p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg, sum(w * (m.p - y) ** 2) AS err FROM m GROUP BY ALL),
v AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b, c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l),
a AS (SELECT b, c, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc, sum(err) / sum(pos + neg) AS brier FROM v GROUP BY 1, 2),
x AS (SELECT b, sum(CASE WHEN c = 1 THEN auc ELSE -auc END) AS da, sum(CASE WHEN c = 1 THEN -brier ELSE brier END) AS db FROM a GROUP BY 1)
SELECT count(*) AS rounds, round(avg(da), 6) AS d_auc, round(quantile_cont(da, 0.025), 6) AS auc_low, round(quantile_cont(da, 0.975), 6) AS auc_high, round(avg((da > 0)::INT), 6) AS p_auc,
round(avg(db), 6) AS d_brier, round(quantile_cont(db, 0.025), 6) AS brier_low, round(quantile_cont(db, 0.975), 6) AS brier_high FROM x"""


def resampled(spark, d, rounds: int) -> DataFrame:
    out = E.bootstrap_vectors(scored(spark, d).select(F.col("doc_id").alias("i"), "y", F.col("p").alias("p_base"), F.col("p2").alias("p_cand")), rounds)
    return out.select("rounds", *[r6(c).alias(c) for c in out.columns[1:]])


@query(poisson_sql(100))
def bootstrap_vectors(spark, d):
    return resampled(spark, d, 100)


@query()
def bootstrap_vectors_10000(spark, d):
    """bootstrap_vectors with 10,000 rounds."""
    return resampled(spark, d, 10_000)


@query()
def paired_bootstrap_10000(spark, d):
    """paired_bootstrap with 10,000 resamples."""
    pairs = placed(scored(spark, d), [F.col("doc_id")], name="i")
    out = E.paired_bootstrap(pairs.select("i", "y", F.col("p").alias("p_base"), F.col("p2").alias("p_cand")), 10_000)
    return out.select("rounds", *[r6(c).alias(c) for c in out.columns[1:]])


def answers(spark, d, shift: int) -> DataFrame:
    """Long answers of a made-up run: tone, a flag, an ordinal and a number, differing with shift."""
    base = T(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(f"CASE (doc_id + {shift} * (n_chars % 2)) % 4 WHEN 0 THEN 'confident' WHEN 1 THEN 'neutral' WHEN 2 THEN 'not_stated' END").alias("tone"), F.expr(f"CAST((n_chars + {shift}) % 3 = 0 AS STRING)").alias("buyback"), F.expr(f"CAST((n_chars + {shift} * (doc_id % 2)) % 4 AS STRING)").alias("hedging"), F.expr(f"CASE WHEN doc_id % 5 > 0 THEN CAST(n_chars % 50 + {shift} * 0.5 AS STRING) END").alias("revenue"))
    return base.unpivot("id", ["tone", "buyback", "hedging", "revenue"], "field", "answer")


KINDS = "CASE field WHEN 'tone' THEN 'categorical' WHEN 'buyback' THEN 'boolean' WHEN 'hedging' THEN 'ordinal' ELSE 'numeric' END"


def graded(spark, d) -> DataFrame:
    return grading.graded(answers(spark, d, 1), answers(spark, d, 0).withColumn("kind", F.expr(KINDS)))


def _run(shift: int) -> str:
    one = f"SELECT doc_id AS id, 'tone' AS field, CASE (doc_id + {shift} * (n_chars % 2)) % 4 WHEN 0 THEN 'confident' WHEN 1 THEN 'neutral' WHEN 2 THEN 'not_stated' END AS answer FROM documents"
    two = f"SELECT doc_id, 'buyback', CAST((n_chars + {shift}) % 3 = 0 AS VARCHAR) FROM documents"
    three = f"SELECT doc_id, 'hedging', CAST((n_chars + {shift} * (doc_id % 2)) % 4 AS VARCHAR) FROM documents"
    four = f"SELECT doc_id, 'revenue', CASE WHEN doc_id % 5 > 0 THEN CAST(n_chars % 50 + {shift} * 0.5 AS VARCHAR) END FROM documents"
    return f"({one} UNION ALL {two} UNION ALL {three} UNION ALL {four})"


GRADED = f"""g AS (SELECT a.id, a.field, {KINDS.replace('field', 'a.field')} AS kind, b.answer AS pred, a.answer AS gold FROM {_run(0)} a JOIN {_run(1)} b ON a.id = b.id AND a.field = b.field),
h AS (SELECT *, CASE WHEN kind = 'numeric' THEN coalesce((pred IS NULL AND gold IS NULL) OR abs(CAST(pred AS DOUBLE) - CAST(gold AS DOUBLE)) <= 0.02 * greatest(abs(CAST(gold AS DOUBLE)), 1), false) ELSE pred IS NOT DISTINCT FROM gold END AS hit FROM g)"""


@query(f"WITH {GRADED.replace('CAST(pred AS DOUBLE)', 'TRY_CAST(pred AS DOUBLE)').replace('CAST(gold AS DOUBLE)', 'TRY_CAST(gold AS DOUBLE)').replace('TRY_TRY_', 'TRY_')} SELECT field, round(avg(hit::INT), 6) AS accuracy, round(avg(CASE WHEN kind = 'ordinal' THEN abs(TRY_CAST(pred AS DOUBLE) - TRY_CAST(gold AS DOUBLE)) END), 6) AS mae, count(*) AS n FROM h GROUP BY 1")
def field_accuracy(spark, d):
    return grading.field_accuracy(graded(spark, d)).select("field", r6("accuracy").alias("accuracy"), r6("mae").alias("mae"), "n")


@query(f"""WITH {GRADED}, t AS (SELECT field, coalesce(gold, 'None') AS g, coalesce(pred, 'None') AS p FROM g WHERE kind IN ('categorical', 'boolean')),
k AS (SELECT field, g AS c FROM t UNION SELECT field, p FROM t), f AS (SELECT k.field, k.c, 2.0 * count(*) FILTER (g = c AND p = c) / (count(*) FILTER (g = c) + count(*) FILTER (p = c)) AS f1 FROM k JOIN t ON t.field = k.field GROUP BY 1, 2)
SELECT field, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1""")
def macro_f1(spark, d):
    return grading.macro_f1(graded(spark, d)).select("field", r6("macro_f1").alias("macro_f1"))


@query(f"WITH {GRADED}, x AS (SELECT id, min(hit::INT) AS a FROM h GROUP BY 1) SELECT round(avg(a), 6) AS exact_match, count(*) AS n FROM x")
def exact_match(spark, d):
    return grading.exact_match(graded(spark, d)).select(r6("exact_match").alias("exact_match"), "n")


@query(f"""WITH {GRADED}, r AS (SELECT field, coalesce(pred IN ('not_stated', 'not_provided'), true) AS p, coalesce(gold IN ('not_stated', 'not_provided'), true) AS q FROM g)
SELECT field, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p), 0), 6) AS abstain_precision, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (q), 0), 6) AS abstain_recall, round(count(*) FILTER (NOT p AND q) / nullif(count(*) FILTER (q), 0), 6) AS over_answer_rate FROM r GROUP BY 1""")
def abstention(spark, d):
    return grading.abstention(graded(spark, d)).select("field", *[r6(c).alias(c) for c in ("abstain_precision", "abstain_recall", "over_answer_rate")])


@query(f"WITH {GRADED}, x AS (SELECT id, avg(hit::INT) AS a FROM h GROUP BY 1) SELECT n_chars % 4 AS confidence, count(*) AS n, round(avg(a), 6) AS accuracy FROM x JOIN documents ON doc_id = id GROUP BY 1")
def confidence_calibration(spark, d):
    conf = T(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 4).alias("confidence"))
    return grading.confidence_calibration(graded(spark, d), conf).select("confidence", "n", r6("accuracy").alias("accuracy"))


def runs(spark, d) -> DataFrame:
    out = None
    for k in range(3):
        r = answers(spark, d, k).withColumn("run", F.lit(k))
        r = r.where("id % 7 != 3") if k == 2 else r
        out = r if out is None else out.unionByName(r)
    return out


def all_runs(spark, d) -> DataFrame:
    first, *rest = (answers(spark, d, k).withColumn("run", F.lit(k)) for k in range(3))
    for r in rest:
        first = first.unionByName(r)
    return first


MODAL = f"""r AS (SELECT 0 AS run, * FROM {_run(0)} UNION ALL SELECT 1, * FROM {_run(1)} UNION ALL SELECT 2, * FROM {_run(2)} WHERE id % 7 <> 3),
c AS (SELECT id, field, answer, count(*) AS c FROM r WHERE id IN (SELECT id FROM r GROUP BY 1 HAVING count(DISTINCT run) = 3) GROUP BY 1, 2, 3), m AS (SELECT id, field, max(c) / 3 AS ag FROM c GROUP BY 1, 2)"""


@query(f"WITH {MODAL} SELECT field, round(avg(ag), 6) AS agreement, round(avg((ag = 1)::INT), 6) AS unanimous FROM m GROUP BY 1")
def consistency_modal(spark, d):
    return grading.modal_agreement(runs(spark, d)).select("field", r6("agreement").alias("agreement"), r6("unanimous").alias("unanimous"))


@query(f"""WITH {GRADED}, {MODAL}, a AS (SELECT field, avg(hit::INT) AS x FROM h GROUP BY 1), b AS (SELECT field, avg(ag) AS y FROM m GROUP BY 1),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM a JOIN b USING (field)) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k""")
def agreement_corr(spark, d):
    rows = grading.field_accuracy(graded(spark, d)).join(grading.modal_agreement(runs(spark, d)), "field")
    return E.rank_correlation(rows, "accuracy", "agreement").select(r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


MODAL_ALL = MODAL.replace(" WHERE id % 7 <> 3", "")


@query(f"WITH {MODAL_ALL} SELECT field, round(avg(ag), 6) AS agreement, round(avg((ag = 1)::INT), 6) AS unanimous FROM m GROUP BY 1")
def consistency_modal_all(spark, d):
    """consistency_modal with every document in all three runs."""
    return grading.modal_agreement(all_runs(spark, d)).select("field", r6("agreement").alias("agreement"), r6("unanimous").alias("unanimous"))


@query(f"""WITH {GRADED}, {MODAL_ALL}, a AS (SELECT field, avg(hit::INT) AS x FROM h GROUP BY 1), b AS (SELECT field, round(avg(ag), 12) AS y FROM m GROUP BY 1),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM a JOIN b USING (field)) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k""")
def agreement_corr_all(spark, d):
    rows = grading.field_accuracy(graded(spark, d)).join(grading.modal_agreement(all_runs(spark, d)).withColumn("agreement", F.round("agreement", 12)), "field")  # equal means tie, whatever the order of their sums
    return E.rank_correlation(rows, "accuracy", "agreement").select(r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@query(r"""WITH m AS (SELECT doc_id, text, n_chars, regexp_extract(text, '(?s)^(.*?)\b(?:license|copyright)\b', 1) AS head, regexp_matches(text, '\b(?:license|copyright)\b') AS has FROM documents),
k AS (SELECT doc_id, text, has AND length(head) >= 200 AS trimmed, CASE WHEN has AND length(head) >= 200 THEN regexp_replace(head, '\s+$', '') ELSE text END AS kept FROM m)
SELECT doc_id, length(text) AS original_chars, trimmed AS trimmed_at_marker, length(kept) > 3000 AS hard_truncated, sha256(trim(CASE WHEN length(kept) > 3000 THEN left(kept, 3000) ELSE kept END, chr(32) || chr(10) || chr(9))) AS prepared_sha256 FROM k""")
def textprep(spark, d):
    p = T(spark, d, "documents").select("doc_id", X.prepare(F.col("text"), 3000, [r"\b(?-i:license|copyright)\b"], r"\bno such section\b", 200).alias("p"))
    return p.select("doc_id", F.col("p.original_chars").cast("long").alias("original_chars"), "p.trimmed_at_marker", "p.hard_truncated", F.sha2("p.text", 256).alias("prepared_sha256"))


@query(r"""WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)(?i:(?:licensed|released) under)', 1) AS head, regexp_matches(text, '(?i)(?:licensed|released) under') AS has FROM documents),
k AS (SELECT *, has AND length(head) >= 1500 AS trimmed, CASE WHEN has AND length(head) >= 1500 THEN regexp_replace(head, '\s+$', '') ELSE text END AS kept, CASE WHEN has AND length(head) >= 1500 THEN substr(text, length(head) + 1) ELSE '' END AS gone FROM m),
s AS (SELECT *, trim(left(regexp_extract(gone, '(?im)^([^\n]*?(?:(?:Public|MIT) License)(?s:.*))', 1), 5000), chr(32) || chr(10) || chr(9)) AS section FROM k),
g AS (SELECT *, trimmed AND NOT regexp_matches(kept, '(?i)(?:Public|MIT) License') AND section <> '' AS recovered FROM s),
f AS (SELECT *, CASE WHEN recovered THEN kept || chr(10) || chr(10) || section ELSE kept END AS whole FROM g),
w AS (SELECT *, left(whole, 70000) AS part, strpos(reverse(left(whole, 70000)), chr(10) || chr(10)) AS back FROM f)
SELECT doc_id, length(text) AS original_chars, trimmed AS trimmed_at_marker, length(whole) > 70000 AS hard_truncated, recovered AS guidance_recovered, sha256(trim(CASE WHEN length(whole) <= 70000 THEN whole WHEN back > 0 AND 70000 - back - 1 > 56000 THEN left(part, 70000 - back - 1) ELSE part END, chr(32) || chr(10) || chr(9))) AS prepared_sha256 FROM w""")
def textprep_full(spark, d):
    """textprep with the operator's own cap of 70,000 characters, and markers and a section to carry back that stand in the documents."""
    p = T(spark, d, "documents").select("doc_id", X.prepare(F.col("text"), markers=["(?:licensed|released) under"], guidance="(?:Public|MIT) License").alias("p"))
    return p.select("doc_id", F.col("p.original_chars").cast("long").alias("original_chars"), "p.trimmed_at_marker", "p.hard_truncated", "p.guidance_recovered", F.sha2("p.text", 256).alias("prepared_sha256"))


CUES = ["the", "license", "tion", "en"]


@query("SELECT doc_id, CAST(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', ''))) / {len(c)}" for c in CUES) + " AS INTEGER) AS cues, CASE WHEN cues < 50 THEN 0 WHEN cues < 200 THEN 1 WHEN cues < 800 THEN 2 ELSE 3 END AS level FROM documents")
def cue_counts(spark, d):
    n = X.count_cues(F.col("text"), CUES)
    return T(spark, d, "documents").select("doc_id", n.alias("cues"), X.bucket(n, (50, 200, 800)).alias("level"))


@query(f"SELECT doc_id, {text_sql.direction('text', 'license', up='the', down='with', flat='and')} AS direction FROM documents")
def direction_near(spark, d):
    return T(spark, d, "documents").select("doc_id", X.direction_near(F.col("text"), "license", up="the", down="with", flat="and").alias("direction"))


@query(text_sql.claims("documents", "doc_id", "text"))
def rule_extract(spark, d):
    return extraction.extract(T(spark, d, "documents").select("doc_id", "text")).select("doc_id", "claims.*")


@query(text_sql.markup("pages", "page_id", "html"))
def html_to_text(spark, d):
    return T(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(r"SELECT doc_id, left(sha256(encode('baseline') || '\x00'::BLOB || '\x00'::BLOB || encode('1') || '\x00'::BLOB || encode(text) || '\x00'::BLOB), 32) AS key FROM documents")
def content_key(spark, d):
    return extraction.with_keys(T(spark, d, "documents").select("doc_id", "text"), "baseline", "", "1").select("doc_id", "key")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source IN ('src0', 'src1'))")
def cache_pending(spark, d):
    docs = extraction.with_keys(T(spark, d, "documents").select("doc_id", "text", "source"), "baseline", "", "1")
    return extraction.pending(docs, docs.where("source in ('src0', 'src1')")).select("doc_id")


def results(spark, d) -> DataFrame:
    """Made-up accounting of a run over the documents."""
    rows = T(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "small").when(F.col("doc_id") % 3 == 1, "large").otherwise("free").alias("model"), (F.col("doc_id") % 11 != 0).alias("ok"), F.concat(F.lit("kind"), (F.col("doc_id") % 2).cast("string"), F.lit(": detail")).alias("error"), F.col("n_chars").alias("input_tokens"), (F.col("n_chars") % 7).alias("output_tokens"), (F.col("n_chars") % 100).alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), (F.col("n_chars") / 1000.0).alias("latency_s"))
    return extraction.cost(rows, spark.sql("SELECT * FROM VALUES ('small', 1.0D, 5.0D), ('large', 3.0D, 15.0D) AS t(model, usd_in, usd_out)"))


COST = "c AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN (n_chars * 1.0 + n_chars % 100 * 0.1 + n_chars % 7 * 5.0) / 1e6 WHEN 1 THEN (n_chars * 3.0 + n_chars % 100 * 0.3 + n_chars % 7 * 15.0) / 1e6 ELSE 0 END AS cost FROM documents)"


@query(f"WITH {COST} SELECT doc_id, round(cost, 9) AS cost_usd FROM c")
def cost_estimate(spark, d):
    return results(spark, d).select("doc_id", F.round("cost_usd", 9).alias("cost_usd"))


@query(f"WITH {COST} SELECT count(*) FILTER (doc_id % 11 <> 0) AS n_ok, count(*) FILTER (doc_id % 11 = 0) AS n_failed, round(sum(cost) / greatest(count(*) FILTER (doc_id % 11 <> 0), 1), 9) AS cost_per_doc, round(avg(n_chars / 1000.0), 6) AS mean_latency_s, round(sum(n_chars % 100) / sum(n_chars + n_chars % 100), 6) AS cache_hit_rate FROM c")
def run_stats(spark, d):
    return extraction.run_stats(results(spark, d)).select("n_ok", "n_failed", F.round("cost_per_doc", 9).alias("cost_per_doc"), r6("mean_latency_s").alias("mean_latency_s"), r6("cache_hit_rate").alias("cache_hit_rate"))


@query("SELECT 'kind' || doc_id % 2 AS reason, count(*) AS n FROM documents WHERE doc_id % 11 = 0 GROUP BY 1")
def failure_reasons(spark, d):
    return extraction.failure_reasons(results(spark, d))


@query("""WITH k AS (SELECT count(DISTINCT year(o_orderdate)) AS k FROM orders), r AS (SELECT o_orderkey, year(o_orderdate) AS yr, md5('42|' || o_orderkey) AS h FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY h, o_orderkey) AS rn FROM r) SELECT o_orderkey, CAST(yr AS INTEGER) AS yr FROM s, k WHERE rn <= greatest(1, ceil(60 / k)) ORDER BY h, o_orderkey LIMIT 60""")
def stratified_equal(spark, d):
    rows = T(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"))
    return sampling.equal_strata(rows, "yr", "o_orderkey", 60)


@query("""WITH z AS (SELECT c_mktsegment, greatest(1, round_even(count(*) * 100 / sum(count(*)) OVER (), 0)) AS take FROM customer GROUP BY 1),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS rn FROM customer) SELECT c_custkey, c_mktsegment FROM r JOIN z USING (c_mktsegment) WHERE rn <= take""")
def stratified_proportional(spark, d):
    return sampling.proportional_strata(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 100)


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents), p AS (SELECT *, r // greatest(1, n // 40) AS i FROM r WHERE r % greatest(1, n // 40) = 0)
SELECT doc_id, n_chars, CASE WHEN i % 4 IN (0, 3) THEN 'A' ELSE 'B' END AS arm FROM p WHERE i < 40""")
def abba_arms(spark, d):
    return sampling.abba_arms(T(spark, d, "documents"), "n_chars", "doc_id", 20)


@query("""WITH e AS (SELECT user_id AS accession, CASE event_id % 4 WHEN 0 THEN 'EX-99.1' WHEN 1 THEN 'ex-99' WHEN 2 THEN 'EX-99.2' ELSE 'EX-10' END AS type, event_id % 13 AS seq, event_id AS filename FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY list_position(['EX-99.1', 'EX-99', 'EX-99.2'], upper(type)), seq, filename) AS rn FROM e WHERE type <> 'EX-10') SELECT accession, type, seq AS sequence, filename FROM r WHERE rn = 1""")
def top1_exhibit(spark, d):
    e = T(spark, d, "events").select(F.col("user_id").alias("accession"), F.when(F.col("event_id") % 4 == 0, "EX-99.1").when(F.col("event_id") % 4 == 1, "ex-99").when(F.col("event_id") % 4 == 2, "EX-99.2").otherwise("EX-10").alias("type"), (F.col("event_id") % 13).alias("sequence"), F.col("event_id").alias("filename"))
    return L.choose_exhibit(e)


@query("SELECT user_id, CAST(event_id AS VARCHAR) AS \"accessionNumber\", CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS items FROM events")
def block_explode(spark, d):
    blocks = T(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("i"))).alias("s"))
    return L.filing_rows(blocks.select("user_id", F.col("s.a").alias("accessionNumber"), F.col("s.i").alias("items")), ["accessionNumber", "items"])


@query("WITH w AS (SELECT l_shipdate::DATE AS date, l_suppkey AS s, avg(l_extendedprice) AS c, sum(l_quantity) AS v FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1, 2) SELECT date, 't' || s AS ticker, round(c, 6) AS close, CASE WHEN s <> 3 THEN v END AS volume FROM w")
def price_unpivot(spark, d):
    wide = T(spark, d, "lineitem").where("l_suppkey in (1, 2, 3)").groupBy(F.col("l_shipdate").alias("date")).pivot("l_suppkey", [1, 2, 3])
    close, volume = (wide.agg(f).select("date", *[F.col(str(i)).alias(f"t{i}") for i in (1, 2, 3)]) for f in (F.avg("l_extendedprice"), F.sum("l_quantity")))
    return L.tidy_prices(close, volume.withColumn("t3", F.lit(None).cast("double")), ["t1", "t2", "t3"]).select("date", "ticker", r6("close").alias("close"), "volume")


@query("SELECT l_shipdate::DATE AS date, 't' || l_suppkey AS ticker, round(avg(l_extendedprice), 6) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1, 2 HAVING avg(l_extendedprice) IS NOT NULL")
def price_unpivot_all(spark, d):
    """price_unpivot over every supplier: a row for each date with maps of closes and volumes, taken apart by one explode."""
    day = T(spark, d, "lineitem").where("l_suppkey is not null").groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("t"), "l_suppkey").alias("ticker"))
    cells = day.agg(F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").cast("double").alias("volume"))
    wide = lambda name: cells.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("ticker", name))).alias(name))  # noqa: E731  a row for each day
    return L.tidy_maps(wide("close"), wide("volume")).select("date", "ticker", r6("close").alias("close"), "volume")


ASOF = "px AS (SELECT l_suppkey AS tick, CAST(l_shipdate AS DATE) AS dt, round(avg(l_extendedprice), 6) AS cl FROM lineitem WHERE month(l_shipdate) % 2 = 0 GROUP BY 1, 2), o AS (SELECT o_orderkey, o_custkey AS tick, CAST(o_orderdate AS DATE) AS dt FROM orders)"


def sessions_of_orders(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders (a customer stands for the supplier of its number) and that supplier's days of even months, so that orders stand before, between and
    past them, and some have none."""
    px = T(spark, d, "lineitem").where("month(l_shipdate) % 2 = 0").groupBy(F.col("l_suppkey").alias("tick"), F.to_date("l_shipdate").alias("dt")).agg(r6(F.avg("l_extendedprice")).alias("cl"))
    return T(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("tick"), F.to_date("o_orderdate").alias("dt")), px


@query(f"WITH {ASOF} SELECT o_orderkey, px.dt AS matched_dt, cl FROM o ASOF LEFT JOIN px ON o.tick = px.tick AND o.dt >= px.dt")
def asof_backward(spark, d):
    return asof_join(*sessions_of_orders(spark, d), "dt", ["tick"]).select("o_orderkey", "matched_dt", "cl")


@query(f"WITH {ASOF} SELECT o_orderkey, px.dt AS matched_dt, cl FROM o ASOF LEFT JOIN px ON o.tick = px.tick AND o.dt < px.dt")
def asof_forward_strict(spark, d):
    return asof_join(*sessions_of_orders(spark, d), "dt", ["tick"], "forward", strict=True).select("o_orderkey", "matched_dt", "cl")


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS ticker, CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS cik, coalesce(n, 0) AS n_filings,
CASE WHEN c_custkey % 10 = 0 THEN 'no CIK' WHEN coalesce(n, 0) < 8 THEN 'only ' || coalesce(n, 0) END AS skip_reason FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def universe_filter(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), F.col("c_custkey").alias("cik"))
    counts = T(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(F.count("*").alias("n_filings"))
    return L.universe(c.select("ticker"), c.where("cik % 10 > 0"), counts)


@query(f"""WITH {PANEL}, r AS (SELECT ticker, t0, id, n_post AS v FROM lab), u AS (SELECT ticker AS k, max(t0) AS t FROM r GROUP BY 1) SELECT ev.id, u.t::VARCHAR AS claim_last FROM ev JOIN u ON u.k = ev.ticker""")
def claims_join(spark, d):
    ev = panel_events(spark, d)
    made = ev.select("ticker", F.col("t0").cast("string").alias("last"), F.col("t0").alias("created"))
    return FT.flatten_claims(ev, made, "ticker").select("id", "claim_last")


@query(f"WITH {TIMING}, b AS (SELECT min(s) AS a, max(s) AS z FROM dd), c AS (SELECT CAST(unnest(range(a - INTERVAL 7 DAY, z + INTERVAL 61 DAY, INTERVAL 1 DAY)) AS DATE) AS dy FROM b) SELECT c.dy AS \"day\", c.dy IN (SELECT s FROM dd) AS is_session, n.s AS next_session FROM c ASOF LEFT JOIN dd n ON c.dy < n.s")
def session_calendar(spark, d):
    e = T(spark, d, "events").select(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York").alias("w"))
    return P.calendar(e.select(F.to_date("w").alias("date")).where(F.expr("weekday(date) < 5")))


def learning_rows(spark, d) -> tuple[DataFrame, dict[str, list[str]]]:
    events = P.days_since_previous(labelled(spark, d).where("drop_reason is null")).withColumn("release_timing", F.lit("intraday"))
    events = events.withColumn("claim_tone", F.expr("CASE WHEN vol_expansion * 10 % 2 < 1 THEN 'confident' ELSE 'cautious' END"))
    m, blocks = FT.build_features(events, ["id", F.col("t0").alias("date"), F.col("y").cast("double").alias("y")])
    return m, blocks


@query()
def ablation(spark, d):
    from tidemark.operators.ml import run_ablation

    m, blocks = learning_rows(spark, d)
    out = run_ablation(m, blocks, kind="gbm")
    return E.auc(out.withColumn("y", F.col("y").cast("long")), ["feature_set"])


@query()
def perm_importance(spark, d):
    from tidemark.operators.ml import permutation_importance

    m, blocks = learning_rows(spark, d)
    return permutation_importance(m.withColumn("y", F.col("y").cast("int")), blocks["control"], kind="gbm")


from tidemark.plans import service, stored  # noqa: E402, F401  more queries, registered beside these
