"""Extraction over a stream of new documents; the content key makes repeats harmless. An extension: the batch form is the same."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.extraction import extract, with_keys
from tidemark.sources.tables import append


def extract_stream(docs: DataFrame, table: str, checkpoint: str, extractor: str = "baseline", version: str = "1"):
    """Start a query that adds each new document's claims to the table (tidemark.sources.tables) once. docs: streaming (accession, text)."""

    def batch(df: DataFrame, _: int) -> None:
        append(extract(with_keys(df, extractor, "", version), extractor), table, "key")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
