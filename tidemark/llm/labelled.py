"""The bounded training sample that the classifiers share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

#: Most labelled rows that a classifier is fitted on: those with the smallest hash of doc_id.
FIT_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1


def held_out():
    """Whether a row is kept from training: crc32 of doc_id as text, mod 3, is 1. False for null."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents that are not held out.

    Labels that are null, other than 0 and 1, or without a document don't count; of rows that repeat a
    doc_id the label 1 wins. The bound makes the chosen labels small enough to broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", as_text().alias("text")).join(F.broadcast(chosen), "doc_id")
