"""Interval joins as equi-joins on time bins.

Both sides are cut into fixed bins, joined on ``(key, bin)`` and filtered by the
exact predicate; a pair found in several shared bins is kept in its first one.
The bin spreads one long source over the cluster, and the plan stays a hash or
sort-merge join, which the adaptive skew join can split further.
Column names of both sides must differ except for ``on``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_MS = 30_000


def _bin(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width))


def _spread(df: DataFrame, start: str, end: str, width: int, first: str) -> DataFrame:
    low, high = _bin(F.col(start), width), _bin(F.col(end), width)
    return (df.where(F.col(start) <= F.col(end))
            .withColumn(first, low)
            .withColumn("_bin", F.explode(F.sequence(low, high))))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                 left_range: tuple[str, str], right_range: tuple[str, str], *,
                 bin_ms: int = BIN_MS, closed: bool = False, bounded: bool = False) -> DataFrame:
    """Pairs with ``l.start < r.end and l.end > r.start`` (``<=`` when closed).

    With ``bounded`` keys (one input row each) both sides already lie together by key: the rows of a bin are
    gathered where they are, while a join on ``(key, bin)`` would deal both sides anew.
    """
    ls, le = left_range
    rs, re = right_range
    a = _spread(left, ls, le, bin_ms, "_bin_l")
    b = _spread(right, rs, re, bin_ms, "_bin_r")
    exact = ((F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs)) if closed
             else (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)))
    if bounded:
        own = [[c for c in df.columns if c not in (*on, "_bin")] for df in (a, b)]
        tagged = a.select(*on, "_bin", F.struct(*own[0]).alias("_l")).unionByName(
            b.select(*on, "_bin", F.struct(*own[1]).alias("_r")), allowMissingColumns=True)
        held = tagged.groupBy(*on, "_bin").agg(F.collect_list("_l").alias("_ls"), F.collect_list("_r").alias("_rs"))
        each = held.select(*on, "_bin", F.explode("_ls").alias("_l"), "_rs")
        meets = (lambda r: (F.col(f"_l.{ls}") <= r[re]) & (F.col(f"_l.{le}") >= r[rs])) if closed else (
            lambda r: (F.col(f"_l.{ls}") < r[re]) & (F.col(f"_l.{le}") > r[rs]))
        once = lambda r: F.col("_bin") == F.greatest(F.col("_l._bin_l"), r["_bin_r"])
        pairs = each.select(*on, "_l", F.explode(F.filter("_rs", lambda r: meets(r) & once(r))).alias("_r"))
        return pairs.select(*on, *[F.col(f"_l.{c}") for c in own[0] if c != "_bin_l"], *[F.col(f"_r.{c}") for c in own[1] if c != "_bin_r"])
    return (a.join(b, [*on, "_bin"])
            .where(exact & (F.col("_bin") == F.greatest("_bin_l", "_bin_r")))
            .drop("_bin", "_bin_l", "_bin_r"))


def point_join(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str,
               span: tuple[str, str], *, bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs with ``start <= at < end``; a point lies in one bin, so no pair repeats."""
    start, end = span
    a = points.withColumn("_bin", _bin(F.col(at), bin_ms))
    b = _spread(ranges, start, end, bin_ms, "_bin_r")
    return (a.join(b, [*on, "_bin"])
            .where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
            .drop("_bin", "_bin_r"))


def containment_join(inner: DataFrame, outer: DataFrame, on: Sequence[str],
                     inner_range: tuple[str, str], outer_range: tuple[str, str], *,
                     bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs with ``outer.start <= inner.start and inner.end <= outer.end``."""
    s, e = inner_range
    os_, oe = outer_range
    a = inner.withColumn("_bin", _bin(F.col(s), bin_ms))
    b = _spread(outer, os_, oe, bin_ms, "_bin_r")
    return (a.join(b, [*on, "_bin"])
            .where((F.col(os_) <= F.col(s)) & (F.col(e) <= F.col(oe)))
            .drop("_bin", "_bin_r"))
