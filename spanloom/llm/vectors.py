"""Vectors in tables: which rows take part, and matrices of Arrow batches.

A row takes part if its id and vector are not null and all components are finite numbers. Vectors of one table may
differ in length; only vectors of one length are ever compared. Query rows reach the tasks in blocks whose bytes are
bounded, one broadcast at a time, so neither the driver nor a task holds more than a block; the rows they meet are
never shuffled and never leave their partition as vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32_000_000


def usable(vector: str) -> Column:
    """True where ``vector`` is not null and holds finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the matrix of each vector length of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    lengths = np.diff(ends, prepend=0)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, flat[(ends[rows] - size)[:, None] + np.arange(size)].reshape(len(rows), size)


def block_column(rows: DataFrame, vector: str, key: list[str], block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``rows`` with a column ``block`` that deals them to blocks of about ``block_bytes``, and the number of blocks."""
    size = rows.agg(F.sum(F.size(vector).cast("long") * 8 + 64)).first()[0] or 0
    blocks = math.ceil(size / block_bytes)
    return rows.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(max(blocks, 1))).cast("int")), blocks
