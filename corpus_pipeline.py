"""A training-corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns the columns of docs (the last one:
what the tokenizer gives). A document is a row; stages that group or mark rows find them again by doc_id and text, so rows with a
null or repeated id are handled too. Of every stage: a null text is an empty one, which has no clauses, words or tokens, so only exact
dedup can remove it; rows with a null id are judged like others; columns of any name pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_roundtrip
from tidemark.llm.common import settle, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact import exact_distinct
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.toxicity import fit_toxicity, toxic_rows_removed


KEY = "\0row"  # a name that no table has


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the identity of each row: its id, of any type, nulls last, and a hash of its text. Never null."""
    none = F.lit("0").cast(docs.schema["doc_id"].dataType)
    return docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", none).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")))


def _without(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows whose __key verdicts lacks, without it."""
    return keyed.join(verdicts.select(KEY).distinct(), KEY, "left_anti").drop(KEY)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from labels, scores 0.7 or more go."""
    grammar, weights = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxic_rows_removed(docs, grammar, weights, threshold=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null as empty, one row with the largest doc_id stays, with all its columns; an empty table stays empty."""
    return exact_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    keyed = _keyed(docs)
    return _without(keyed, settle(near_duplicates(keyed, words=5, percent=80, id_col=KEY).where("NOT kept").select(KEY), "near-copies"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    keyed = _keyed(docs)
    return _without(keyed, settle(decontaminate(keyed, table(spark, sf_dir, "benchmark"), window=10, id_col=KEY).where("contaminated").select(KEY), "contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of what is left."""
    # by now the heap of an executor is at its full size, so its workers hold less than in a job of their own
    return bpe_roundtrip(docs, tokenizer_path(), memo_bytes=100_000_000)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokens)]

#: The stages' scores, sketches and tokens have no SQL form; tests hold each stage and the whole against plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
