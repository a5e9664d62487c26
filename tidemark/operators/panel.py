"""Time-series panels: returns, event windows, the trading calendar and alignment of timestamps to sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def finite(c: Column) -> Column:
    """c where it is a finite number, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def log_returns(prices: DataFrame) -> DataFrame:
    """prices (ticker, date, close, volume) with log_return; the first session of a ticker has none."""
    w = Window.partitionBy("ticker").orderBy("date")
    ratio = F.try_divide("close", F.lag("close").over(w))
    return prices.withColumn("log_return", F.when(ratio > 0, F.ln(ratio)))


def realized_vol(c: Column) -> Column:
    """Annualised sample deviation of the finite values; null with fewer than two. An aggregate, also over windows."""
    return F.stddev_samp(finite(c)) * F.sqrt(F.lit(float(TRADING_DAYS)))


def event_windows(returns: DataFrame, pre: int = 20, post: int = 5) -> DataFrame:
    """Per session: what an event on it would see before (pre sessions, itself excluded) and after (post sessions, itself included).

    All windows share one partitioning and order, so one sort serves them.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    before, after = w.rowsBetween(-pre, -1), w.rowsBetween(0, post - 1)
    vol = lambda frame: F.stddev_samp(finite(F.col("log_return"))).over(frame) * F.sqrt(F.lit(float(TRADING_DAYS)))
    return returns.select(
        "ticker", "date",
        vol(before).alias("rv_pre"), vol(after).alias("rv_post"),
        F.count(finite(F.col("log_return"))).over(before).alias("n_pre"), F.count(finite(F.col("log_return"))).over(after).alias("n_post"),
        F.lag("close").over(w).alias("prior_close"), F.avg(F.col("close") * F.col("volume")).over(before).alias("avg_dollar_volume"),
    )


def calendar(sessions: DataFrame) -> DataFrame:
    """One row for each calendar day from a week before the first session to 60 days past the last: is_session, next_session
    (strictly after). sessions: a column date. The result is as large as the span of days, whatever the size of the data.
    """
    days = sessions.select("date").distinct()
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    dense = span.where("a is not null").select(F.explode(F.sequence(F.date_sub("a", 7), F.date_add("b", 60))).alias("day"))
    dense = dense.join(days.withColumn("session", F.col("date")), dense["day"] == days["date"], "left").select("day", "session")
    ahead = Window.partitionBy().orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return dense.select("day", F.col("session").isNotNull().alias("is_session"), F.first("session", ignorenulls=True).over(ahead).alias("next_session"))


def parse_acceptance(c: Column, zone: str = "America/New_York") -> Column:
    """Wall-clock timestamp of an acceptance string: UTC if it ends in Z, else already local; null if unreadable."""
    local = F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(c))
    return F.when(c.endswith("Z"), F.from_utc_timestamp(F.try_to_timestamp(c), zone)).otherwise(local)


def event_timing(events: DataFrame, days: DataFrame, accepted: str = "accepted", filed: str = "filing_date") -> DataFrame:
    """events with release_timing and t0. Before 09:30 and until 16:00 of a session the event belongs to that session, else to
    the next one, however far ahead; t0 is null if there is none. An unreadable time is 17:00 of the filing date."""
    wall = F.coalesce(parse_acceptance(F.col(accepted)), F.to_timestamp(F.concat(F.col(filed).cast("string"), F.lit(" 17:00:00"))))
    at = events.withColumn("wall", wall).withColumn("release_day", F.to_date("wall"))
    first = days.where("is_session").agg(F.min("day").alias("first_session"))
    at = at.join(F.broadcast(days), at["release_day"] == days["day"], "left").drop("day").join(F.broadcast(first))
    at = at.withColumn("next_session", F.coalesce("next_session", F.when(F.col("release_day") < F.col("first_session"), F.col("first_session")))).drop("first_session")
    clock = F.date_format("wall", "HH:mm:ss")
    session = F.coalesce("is_session", F.lit(False))
    timing = F.when(~session, "non_session").when(clock < "09:30:00", "pre_market").when(clock < "16:00:00", "intraday").otherwise("after_hours")
    at = at.withColumn("release_timing", timing)
    t0 = F.when(F.col("release_timing").isin("pre_market", "intraday"), F.col("release_day")).otherwise(F.col("next_session"))
    return at.withColumn("t0", t0).drop("wall", "is_session", "next_session")


def window_past_end(returns: DataFrame, pre: int = 20) -> DataFrame:
    """One row (last_session, rv_past): what the first day after the last session would see before it."""
    last = returns.select("date", "log_return").orderBy(F.desc("date")).limit(pre)
    return last.agg(F.max("date").alias("last_session"), realized_vol(F.col("log_return")).alias("rv_past"))


def market_before(days: DataFrame, market: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """(date, rv_market_pre) of the days and of the market's sessions. On a day that is none, the sessions before it are those before
    the market's next session, whose window is taken; past the last session it is that of `past` (window_past_end), or null without it. Both
    tables are as large as a span of days."""
    known = market.select("date", F.struct("rv_pre").alias("seen"))
    both = known.unionByName(days.where("date is not null").distinct().join(known, "date", "left_anti").withColumn("seen", F.lit(None).cast(known.schema["seen"].dataType)))
    ahead = Window.partitionBy().orderBy("date").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = both.select("date", F.first("seen", ignorenulls=True).over(ahead)["rv_pre"].alias("rv_market_pre"))
    if past is None:
        return out
    after = F.col("date") > F.col("last_session")
    return out.join(F.broadcast(past)).select("date", F.when(after, F.col("rv_past")).otherwise(F.col("rv_market_pre")).alias("rv_market_pre"))  # one row


def padded_start(day: Column, days: int = 120) -> Column:
    """The day from which prices are needed so that windows before `day` are full."""
    return F.date_sub(day, days)


def event_labels(events: DataFrame, windows: DataFrame, market: DataFrame, threshold: float = 1.5, min_pre: int = 15, min_post: int = 5, past: DataFrame | None = None) -> DataFrame:
    """events (id, ticker, t0, ...) with both volatilities, controls, drop_reason (null: kept), vol_expansion and label y.

    The first reason that holds is given, in a fixed order. windows: event_windows of the tickers; market: of the market proxy;
    past: its window_past_end.
    """
    known = windows.select("ticker").distinct().withColumn("has_prices", F.lit(True))
    market = market_before(events.select(F.col("t0").alias("date")), market, past).withColumnRenamed("date", "t0")
    at = windows.withColumnRenamed("date", "t0").withColumn("has_day", F.lit(True))
    out = events.join(known, "ticker", "left").join(at, ["ticker", "t0"], "left").join(market, "t0", "left")
    reason = (
        F.when(F.col("has_prices").isNull(), "no_price_history").when(F.col("t0").isNull(), "unresolvable_event_day").when(F.col("has_day").isNull(), "event_day_missing_for_ticker")
        .when(F.col("n_pre") < min_pre, "insufficient_pre_window").when(F.col("n_post") < min_post, "insufficient_post_window")
        .when(finite(F.col("rv_pre")).isNull() | finite(F.col("rv_post")).isNull() | (F.col("rv_pre") <= 0), "degenerate_volatility")
    )
    out = out.withColumn("drop_reason", reason).drop("has_prices", "has_day")
    ratio = F.when(F.col("drop_reason").isNull(), F.try_divide("rv_post", "rv_pre"))
    return out.withColumn("vol_expansion", ratio).withColumn("y", (F.col("vol_expansion") > threshold).cast("int"))


def days_since_previous(events: DataFrame, default: int = 91, most: int = 250) -> DataFrame:
    """Days since the ticker's previous event, by (t0, id): default for the first, clipped to 0..most."""
    w = Window.partitionBy("ticker").orderBy("t0", "id")
    gap = F.coalesce(F.datediff("t0", F.lag("t0").over(w)), F.lit(default))
    return events.withColumn("days_since_prev", F.when(gap < 0, 0).when(gap > most, most).otherwise(gap))
