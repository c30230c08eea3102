"""A bounded sample of labelled texts for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_TEXTS = 3000


def held_out() -> Column:
    """Documents of the fifth that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE_TEXTS) -> DataFrame:
    """At most ``limit`` labelled texts outside the held-out fifth, those with the smallest hash of their id.

    An id with several labels counts if they agree. The chosen ids are at most ``limit``
    rows, so they are broadcast to the documents; repeated documents count once.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id")
             .agg(F.min(label).alias("_label"), F.max(label).alias("_most")).filter("_label = _most").drop("_most")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label"))
