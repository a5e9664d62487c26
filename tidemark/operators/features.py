"""Feature blocks with fixed levels: nothing is learned from the data, so a plan never needs a first pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.panel import finite

# Levels of the enumerated fields.
DIRECTION = ["increased", "decreased", "flat", "not_stated"]
GUIDANCE = ["raised", "lowered", "maintained", "initiated", "withdrawn", "not_provided"]
TONE = ["confident", "neutral", "cautious", "not_stated"]
TIMING = ["pre_market", "intraday", "after_hours", "non_session"]
CATEGORICAL = {"revenue_direction": DIRECTION, "eps_direction": DIRECTION, "margin_direction": DIRECTION, "dividend_action": DIRECTION, "guidance_action": GUIDANCE, "tone": TONE}
BOOLEAN = ["announced_buyback", "announced_restructuring", "announced_impairment", "executive_transition", "macro_headwind_cited", "segment_weakness_disclosed", "one_time_items"]
ORDINAL = ["non_gaap_emphasis", "hedging_intensity"]
NUMERIC = ["revenue_yoy_pct", "guidance_horizon_quarters"]


def clip_low(c: Column, low: float) -> Column:
    """c raised to low; null stays null."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def one_hot(c: str, levels: list[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column for each level; values outside of the levels and nulls are 0 in all."""
    return {f"{prefix}__{x}": F.coalesce((F.col(c) == x).cast("int"), F.lit(0)) for x in levels}


def control_block() -> dict[str, Column]:
    out = {
        "log_rv_pre": F.ln(clip_low(F.col("rv_pre"), 1e-4)), "log_rv_market_pre": F.ln(clip_low(F.col("rv_market_pre"), 1e-4)),
        "rv_ratio_to_market": F.try_divide(F.col("rv_pre"), clip_low(F.col("rv_market_pre"), 1e-4)), "log_dollar_volume": F.ln(clip_low(F.col("avg_dollar_volume"), 1.0)),
        "log_price": F.ln(clip_low(F.col("prior_close"), 0.01)), "quarter": F.quarter("t0"), "month": F.month("t0"), "days_since_prev": F.col("days_since_prev"),
    }
    return out | one_hot("release_timing", TIMING, "timing")


def claim_block(columns: list[str], prefix: str = "claim_") -> dict[str, Column]:
    """Claim features of those claim columns that are there."""
    has = lambda f: prefix + f in columns
    out: dict[str, Column] = {}
    for f, levels in CATEGORICAL.items():
        out |= one_hot(prefix + f, levels, f) if has(f) else {}
    for f in BOOLEAN:
        out |= {f: F.coalesce(F.col(prefix + f).cast("int"), F.lit(0))} if has(f) else {}
    for f in ORDINAL:
        if has(f):
            x = finite(F.col(prefix + f).try_cast("double"))
            out |= {f: F.coalesce(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), F.lit(0.0))}
    for f in NUMERIC:
        if has(f):
            x = F.nanvl(F.col(prefix + f).try_cast("double"), F.lit(None).cast("double"))
            out |= {f: F.coalesce(x, F.lit(0.0)), f"{f}_missing": x.isNull().cast("int")}
    if has("revenue_yoy_pct"):
        out["revenue_yoy_abs"] = F.abs(F.coalesce(F.col(prefix + "revenue_yoy_pct").try_cast("double"), F.lit(0.0)))
    if has("confidence"):
        out["extractor_confidence"] = F.coalesce(F.col(prefix + "confidence").try_cast("double"), F.lit(0.0))
    return out


def build_features(events: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """One projection to a finite matrix beside the columns `keep`, and the names of its blocks."""
    blocks = {"control": control_block(), "claim": claim_block(events.columns)}
    cols = [F.coalesce(finite(c.cast("double")), F.lit(0.0)).alias(n) for b in blocks.values() for n, c in b.items()]
    return events.select(*keep, *cols), {b: list(x) for b, x in blocks.items()}


def flatten_claims(events: DataFrame, claims: DataFrame, key: str = "accession") -> DataFrame:
    """events joined with their claims, prefixed; of several claims of a key the last by created wins."""
    last = claims.groupBy(key).agg(F.max_by(F.struct(*[c for c in claims.columns if c not in (key, "created")]), "created").alias("c"))
    names = [c for c in claims.columns if c not in (key, "created")]
    return events.join(last, key).select(*events.columns, *[F.col(f"c.{n}").alias(f"claim_{n}") for n in names])
