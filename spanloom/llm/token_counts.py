"""Exact histogram of encoded lengths, and what it answers for every context limit.

``histogram`` counts documents by their number of ids, added up before the shuffle.
``suffix_sums`` gives each length the number of documents and ids at and above it, by
blocked sums so that no task holds all lengths. From these follow, exactly, for any
limit: ids kept when documents are cut there, documents that fit, totals and quantiles.

Null texts count as empty (length 0, or 1 with a closing id). Repeated rows count each.
An empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import scan as sc

from .chars import map_texts
from .tokens import encoder

BLOCK_LENGTHS = 256


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, length)``: number of ids of each whole text."""
    def run(columns, texts):
        return columns["doc_id"], pa.array([len(x) // 4 for x in encoder(tokenizer).encode(texts)], pa.int64())

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, length long")


def histogram(rows: DataFrame) -> DataFrame:
    """``(length, n_docs)`` of a table with a ``length`` column."""
    return rows.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Totals at and above each length, and the answers for that length as context limit.

    ``docs_from`` and ``ids_from`` count documents of this length or more; ``ids_cut`` is
    the number of ids kept if every document is cut at this length; ``rank`` is the
    share of documents of this length or less, so the p-quantile is the first length
    whose rank reaches p.
    """
    below = sc.scan(hist.withColumn("n_ids", F.col("length") * F.col("n_docs")), [], ["length"], F.floor(F.col("length") / BLOCK_LENGTHS),
                    docs_below=sc.running_sum(F.col("n_docs"), inclusive=False), ids_below=sc.running_sum(F.col("n_ids"), inclusive=False))
    total = hist.agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("_ids"))
    docs_from, ids_from = F.col("_docs") - F.col("docs_below"), F.col("_ids") - F.col("ids_below")
    return below.join(F.broadcast(total)).select(
        "length", "n_docs", docs_from.alias("docs_from"), ids_from.alias("ids_from"),
        F.col("_docs").alias("total_docs"), F.col("_ids").alias("total_ids"),
        (F.col("ids_below") + docs_from * F.col("length")).alias("ids_cut"),
        ((F.col("docs_below") + F.col("n_docs")) / F.col("_docs")).alias("rank"))


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Documents that fit and ids kept for any limits, also such as no document has.

    The limits are a stated list; each is met with all lengths of the histogram.
    """
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    return hist.withColumn("context", F.explode(F.array(*[F.lit(int(x)) for x in limits]).cast("array<bigint>"))).groupBy("context").agg(
        F.sum(F.when(F.col("length") <= F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_fit"),
        F.sum(F.least("length", "context") * F.col("n_docs")).alias("ids_cut")).join(wanted, "context", "right")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Smallest length whose rank reaches each share."""
    return sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares]))).filter(
        F.col("rank") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
