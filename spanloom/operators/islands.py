"""Gaps and islands over interval, label and integer sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan as sc

KEY = ("source_id",)


def mark_islands(df: DataFrame, key: Sequence[str], order: Sequence[str], block: Column | None,
                 end: str, starts: Column, first: str) -> DataFrame:
    """Append ``first``: the order value at which each row's island starts.

    ``starts`` decides from ``_reach``, the largest earlier ``end`` (null at the
    head of a key), whether a row opens an island.
    """
    reach = sc.scan(df, key, order, block, _reach=sc.max_before(F.col(end)))
    opened = reach.withColumn("_open", F.when(F.col("_reach").isNull() | starts, F.col(order[0])))
    marked = sc.scan(opened, key, order, block, **{first: sc.latest(F.col("_open"))})
    return marked.drop("_reach", "_open")


def interval_union(df: DataFrame, key: Sequence[str] = KEY, *, start: str = "start_ms",
                   end: str = "end_ms", touching: bool = True, block_ms: int | None = sc.BLOCK_MS) -> DataFrame:
    """Union of intervals; touching ones merge, empty ones are dropped."""
    solid = df.where(F.col(start) < F.col(end))
    apart = F.col(start) > F.col("_reach") if touching else F.col(start) >= F.col("_reach")
    pieces = solid.groupBy(*key, start, end).agg(F.count(F.lit(1)).alias("_n"))
    marked = mark_islands(pieces, key, [start, end], sc.by_time(start, block_ms), end, apart, "_first")
    return marked.groupBy(*key, "_first").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("_first")


def overlap_units(sentences: DataFrame, key: Sequence[str] = KEY, *,
                  block_ms: int | None = sc.BLOCK_MS) -> DataFrame:
    """Maximal runs of strictly overlapping sentences; a touching pair stays apart."""
    marked = mark_islands(sentences, key, ["start_ms", "pos"], sc.by_time("start_ms", block_ms),
                          "end_ms", F.col("start_ms") >= F.col("_reach"), "_first")
    member = F.struct("pos", "text")
    return marked.groupBy(*key, F.col("_first").alias("_u")).agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["text"]), "\n").alias("text"),
    ).drop("_u")


def label_runs(df: DataFrame, key: Sequence[str], order: Sequence[str], label: str, at: str,
               block: Column | None) -> DataFrame:
    """Runs of equal consecutive labels, each ending where the next one starts; null equals null."""
    near = sc.scan(df, key, order, block, _last=sc.previous(F.col(label)), _seen=sc.previous(F.lit(True)), _next=sc.following(F.col(at)))
    place = F.struct(*order)
    opened = near.withColumn("_open", F.when(~F.col(label).eqNullSafe(F.col("_last")) | F.col("_seen").isNull(), place))
    marked = sc.scan(opened, key, order, block, _run=sc.latest(F.col("_open")))
    return marked.groupBy(*key, "_run", label).agg(
        F.min(at).alias("start_ms"), F.max(F.coalesce("_next", at)).alias("end_ms"),
        F.count(F.lit(1)).alias("n")).drop("_run")


def inclusive_union(df: DataFrame, key: Sequence[str], first: str, last: str, block_size: int | None = 4096) -> DataFrame:
    """Union of inclusive integer ranges that share at least one value, with member counts."""
    ranges = df.groupBy(*key, first, last).agg(F.count(F.lit(1)).alias("_n"))
    marked = mark_islands(ranges, key, [first, last], sc.by_rows(first, block_size), last,
                          F.col(first) > F.col("_reach"), "_first")
    return marked.groupBy(*key, "_first").agg(
        F.min(first).alias(first), F.max(last).alias(last), F.sum("_n").alias("members")).drop("_first")


def active_counts(boundaries: DataFrame, ranges: DataFrame, key: Sequence[str], at: str,
                  first: str, last: str, block_size: int | None = 4096) -> DataFrame:
    """Number of ranges with ``first <= at < last`` at every boundary, by a sweep of +1 and -1."""
    up = ranges.groupBy(*key, F.col(first).alias("_at")).agg(F.count(F.lit(1)).alias("_d"))
    down = ranges.groupBy(*key, F.col(last).alias("_at")).agg((-F.count(F.lit(1))).alias("_d"))
    delta = up.unionByName(down).groupBy(*key, "_at").agg(F.sum("_d").alias("_d"))
    marks = boundaries.select(*key, F.col(at).alias("_at")).distinct().withColumn("_b", F.lit(1))
    line = marks.join(delta, [*key, "_at"], "full_outer")
    swept = sc.scan(line, key, ["_at"], sc.by_rows("_at", block_size), active=sc.running_sum(F.col("_d")))
    counts = swept.where("_b = 1").select(*key, F.col("_at").alias(at), "active")
    return boundaries.join(counts, [*key, at])


def integer_runs(df: DataFrame, key: Sequence[str], group: str, value: str, *, block: Column | str | None = sc.AUTO) -> DataFrame:
    """Consecutive values of ``value`` in a ``(key, group)`` as ``first..last`` runs."""
    # A value opens a run when its predecessor is absent; the run closes at the next gap.
    values = df.select(*key, group, value).distinct()
    full = [*key, group]
    marked = sc.scan(values, full, [value], block, _prev=sc.previous(F.col(value)))
    opened = marked.withColumn("_open", F.when(F.col("_prev").isNull() | (F.col(value) - F.col("_prev") > 1), F.col(value)))
    runs = sc.scan(opened, full, [value], block, _first=sc.latest(F.col("_open")))
    return runs.groupBy(*full, F.col("_first").alias("first")).agg(F.max(value).alias("last"))


def fixed_chunks(media: DataFrame, total: str, size: int) -> DataFrame:
    """Chunks of ``size``, the last one shorter."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col(total) - 1, F.lit(size).cast("bigint"))
    return (media.where(F.col(total) > 0).select("*", F.posexplode(starts).alias("chunk", "first"))
            .withColumn("chunk", F.col("chunk").cast("bigint"))
            .withColumn("stop", F.least(F.col("first") + size, F.col(total))))
