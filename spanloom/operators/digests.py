"""Digests of ordered tables that no single task has to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 256


def tree_digest(rows: DataFrame, key: Sequence[str], order: Sequence[Column], content: Column, levels: Sequence[Column]) -> DataFrame:
    """One ``digest`` per key: hashes of rows, hashed over ranges of the order, then over ranges of ranges.

    ``levels`` name the range of a row from the finest to the coarsest; they must not decrease along ``order`` and
    depend on the row alone, so the digest does not depend on partitions. A task reads one range at a time.
    """
    key, names = list(key), [f"_l{i}" for i in range(len(levels))]
    now = rows.select(*key, *[c.alias(n) for c, n in zip(levels, names)], F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), F.sha2(content, 256).alias("_h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"]), "\n"), 256).alias("_h")
    for i, name in enumerate(names):
        now = now.groupBy(*key, *names[i:]).agg(joined).select(*key, *names[i + 1:], F.struct(F.col(name).alias("o0")).alias("_o"), "_h")
    return now.groupBy(*key).agg(joined).withColumnRenamed("_h", "digest")


def by_position(position: str, share: int = SHARE) -> list[Column]:
    """Ranges of a position that counts from 1 or 0: shares of rows, of shares, of shares of shares."""
    return [F.floor(F.col(position) / F.lit(share ** i)) for i in (1, 2, 3)]


def by_prefix(ident: str, start: int = 1) -> list[Column]:
    """Ranges of hexadecimal ids, by their first four and two digits from ``start`` on."""
    return [F.substring(ident, start, n) for n in (4, 2)]
