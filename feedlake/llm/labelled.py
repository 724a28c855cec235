"""Rows that classifiers may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a classifier is fitted on; the ones with the smallest hashes of their ids are taken.
SAMPLE_ROWS = 40_000


def held_out(doc_id: Column) -> Column:
    """Documents no label is learnt from: remainder 1 of the checksum of the id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, label)`` of a sample of labelled documents that are not held out.

    Labels other than 0 and 1 and null ids are left aside; an id with several labels counts as 1 if one of them is. The
    ids are at most ``rows``, so they are broadcast and the documents are only scanned.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")
