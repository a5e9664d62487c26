"""Running extractors over documents: a registry, the content-addressed cache, and accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import content_key, extract_claims

#: Extractors by name: column of the prepared text -> struct of claims. Remote ones join as functions over DataFrames.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {"baseline": extract_claims}

# Price factors of cached input.
CACHE_READ, CACHE_WRITE = 0.10, 1.25


def with_keys(docs: DataFrame, extractor: str, model: str, version: str, text: str = "text") -> DataFrame:
    return docs.withColumn("key", content_key(F.lit(extractor), F.lit(model), F.lit(version), F.col(text)))


def pending(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents whose content key the cache lacks."""
    return docs.join(cache.select("key").distinct(), "key", "left_anti")


def cached(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents with their cached result; equal texts each keep a row."""
    return docs.join(cache, "key")


def extract(docs: DataFrame, extractor: str = "baseline", text: str = "text") -> DataFrame:
    return docs.withColumn("claims", EXTRACTORS[extractor](F.col(text)))


def cost(results: DataFrame, prices: DataFrame) -> DataFrame:
    """results with cost_usd, by price per million tokens; a model without a price costs 0."""
    out = results.join(F.broadcast(prices), "model", "left")
    spent = F.col("input_tokens") * F.col("usd_in") + F.col("cache_read_tokens") * F.col("usd_in") * CACHE_READ + F.col("cache_write_tokens") * F.col("usd_in") * CACHE_WRITE + F.col("output_tokens") * F.col("usd_out")
    return out.withColumn("cost_usd", F.coalesce(spent / 1e6, F.lit(0.0))).drop("usd_in", "usd_out")


def run_stats(results: DataFrame) -> DataFrame:
    """Counts, cost a document, latency and cache hit rate of a run."""
    tokens = F.sum(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))
    ok = F.count_if("ok")
    return results.agg(
        ok.alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), (F.sum("cost_usd") / F.greatest(ok, F.lit(1))).alias("cost_per_doc"),
        F.avg("latency_s").alias("mean_latency_s"), F.coalesce(F.try_divide(F.sum("cache_read_tokens").cast("double"), tokens.cast("double")), F.lit(0.0)).alias("cache_hit_rate"),
    )


def failure_reasons(results: DataFrame) -> DataFrame:
    """Failures by the part of the error before its first colon."""
    return results.where("not ok").groupBy(F.substring_index("error", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
