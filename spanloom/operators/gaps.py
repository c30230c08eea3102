"""Word gaps, coverage audits and repairs of word tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import islands, scan as sc
from .range_join import containment_join, overlap_join

KEY = ["source_id"]


def word_gaps(words: DataFrame, media: DataFrame, *, min_gap_ms: int = 3_000,
              block: Column | str | None = sc.AUTO) -> DataFrame:
    """Uncovered spans strictly longer than ``min_gap_ms``.

    ``words`` has ``pos, start_ms, end_ms``; ``media`` has ``duration_ms``. The
    position is prefix, internal, suffix or whole_media; ``left_pos`` is the word
    that reaches furthest before the gap.
    """
    solid = words.where(F.col("start_ms") < F.col("end_ms"))
    reach = F.struct(F.col("end_ms").alias("e"), (-F.col("pos")).alias("p"))
    seen = sc.scan(solid, KEY, ["start_ms", "end_ms", "pos"], block, _reach=sc.max_before(reach))
    start = F.coalesce(F.col("_reach")["e"], F.lit(0))
    inner = seen.where(F.col("start_ms") - start > min_gap_ms).select(
        "source_id", start.cast("bigint").alias("gap_start"), F.col("start_ms").alias("gap_end"),
        (-F.col("_reach")["p"]).alias("left_pos"), F.col("pos").alias("right_pos"),
        F.when(F.col("_reach").isNull(), "prefix").otherwise("internal").alias("position"))
    ends = solid.groupBy("source_id").agg(F.max(reach).alias("_reach"))
    stop = F.coalesce(F.col("_reach")["e"], F.lit(0))
    tail = (media.join(ends, "source_id", "left").where(F.col("duration_ms") - stop > min_gap_ms).select(
        "source_id", stop.cast("bigint").alias("gap_start"), F.col("duration_ms").alias("gap_end"),
        (-F.col("_reach")["p"]).alias("left_pos"), F.lit(None).cast("bigint").alias("right_pos"),
        F.when(F.col("_reach").isNull(), "whole_media").otherwise("suffix").alias("position")))
    return inner.unionByName(tail)


def coverage_audit(gaps: DataFrame, detectors: DataFrame, names: tuple[str, ...], *,
                   min_speech_ms: int = 3_000, block_ms: int | None = sc.BLOCK_MS) -> DataFrame:
    """Detected speech inside each gap, per detector; suspect from ``min_speech_ms`` on.

    ``detectors`` has ``source_id, detector, start_ms, end_ms``; overlapping rows of
    one detector count once. One ``<detector>_ms`` column per name.
    """
    union = islands.interval_union(detectors, ["source_id", "detector"], block_ms=block_ms)
    spans = union.select("source_id", "detector", F.col("start_ms").alias("d_start"), F.col("end_ms").alias("d_end"))
    ident = ["source_id", "gap_start", "gap_end"]
    pairs = overlap_join(gaps.select(*ident), spans, KEY, ("gap_start", "gap_end"), ("d_start", "d_end"))
    common = F.least("gap_end", "d_end") - F.greatest("gap_start", "d_start")
    sums = pairs.groupBy(*ident).agg(*[
        F.sum(F.when(F.col("detector") == n, common)).alias(f"{n}_ms") for n in names])
    found = gaps.join(sums, ident, "left")
    zeroed = found.select(*gaps.columns, *[F.coalesce(f"{n}_ms", F.lit(0)).alias(f"{n}_ms") for n in names])
    most = F.greatest(*[F.col(f"{n}_ms") for n in names]) if len(names) > 1 else F.col(f"{names[0]}_ms")
    return zeroed.withColumn("speech_ms", most).withColumn("suspect", F.col("speech_ms") >= min_speech_ms)


def coverage_status(media: DataFrame, audit: DataFrame, detectors: DataFrame) -> DataFrame:
    """``suspect_coverage``, ``clear`` or ``unobserved`` per source."""
    per = audit.groupBy("source_id").agg(F.count(F.lit(1)).alias("gaps"), F.count_if("suspect").alias("suspects"))
    seen = detectors.select("source_id").distinct().withColumn("_seen", F.lit(True))
    return (media.select("source_id").join(per, "source_id", "left").join(seen, "source_id", "left").select(
        "source_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("suspects", F.lit(0)).alias("suspects"),
        F.when(F.col("suspects") > 0, "suspect_coverage").when(F.col("_seen"), "clear")
        .otherwise("unobserved").alias("status")))


def blocking_gaps(audit: DataFrame, detectors: DataFrame, primary: str, fallback: str, *,
                  min_speech_ms: int = 3_000) -> DataFrame:
    """Suspect gaps by the primary detector, the fallback only for sources without it."""
    has = detectors.where(F.col("detector") == primary).select("source_id").distinct().withColumn("_has", F.lit(True))
    speech = F.when(F.col("_has"), F.col(f"{primary}_ms")).otherwise(F.col(f"{fallback}_ms"))
    return (audit.where("suspect").join(has, "source_id", "left").where(speech >= min_speech_ms)
            .select("source_id", "gap_start", "gap_end"))


def touched_by(segments: DataFrame, gaps: DataFrame, ident: list[str], *, bounded: bool = False) -> DataFrame:
    """Segments that a gap intersects or touches at an endpoint.

    The few gaps of ``bounded`` sources (one input row each) are gathered and brought to the segments, which are read once.
    """
    if bounded:
        held = gaps.where("gap_start <= gap_end").groupBy("source_id").agg(F.collect_list(F.struct("gap_start", "gap_end")).alias("_gaps"))
        meets = F.exists("_gaps", lambda g: (F.col("start_ms") <= g["gap_end"]) & (F.col("end_ms") >= g["gap_start"]))
        touched = F.coalesce(meets & (F.col("start_ms") <= F.col("end_ms")), F.lit(False))
        return segments.join(held, "source_id", "left").withColumn("touched", touched).drop("_gaps")
    hits = overlap_join(segments.select("source_id", *ident, "start_ms", "end_ms"), gaps, KEY,
                        ("start_ms", "end_ms"), ("gap_start", "gap_end"), closed=True)
    marked = hits.select("source_id", *ident).distinct().withColumn("touched", F.lit(True))
    return segments.join(marked, ["source_id", *ident], "left").withColumn(
        "touched", F.coalesce("touched", F.lit(False)))


def gap_backfill(base: DataFrame, late: DataFrame, gaps: DataFrame, *, bounded: bool = False) -> DataFrame:
    """Late words with the reason they stay out, null for accepted ones.

    A late word must lie wholly inside one original gap and overlap no base word.
    ``late`` has ``late_id, start_ms, end_ms``. With ``bounded`` sources (one input row each) all is found where the
    words of a source lie.
    """
    rows = late.select("source_id", "late_id", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    spans = gaps.select("source_id", "gap_start", "gap_end")
    if bounded:
        # The few gaps are dealt to the words, which stay where their text was dealt to.
        spans = spans.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id")
        wide = rows.withColumn("_low", F.least("l_start", "l_end")).withColumn("_high", F.greatest("l_start", "l_end"))
        inside = overlap_join(wide, spans, KEY, ("_low", "_high"), ("gap_start", "gap_end"), closed=True, bounded=True).where(
            "gap_start <= l_start AND l_end <= gap_end")
    else:
        inside = containment_join(rows, spans, KEY, ("l_start", "l_end"), ("gap_start", "gap_end"))
    clash = overlap_join(rows, base.select("source_id", F.col("start_ms").alias("b_start"),
                                           F.col("end_ms").alias("b_end")), KEY,
                         ("l_start", "l_end"), ("b_start", "b_end"), bounded=bounded)
    ident = ["source_id", "late_id"]
    if bounded:
        own = [c for c in late.columns if c not in ident]
        tagged = late.select(*ident, F.struct(*own).alias("_l")).unionByName(
            inside.select(*ident, F.lit(True).alias("_in")), allowMissingColumns=True).unionByName(
            clash.select(*ident, F.lit(True).alias("_hit")), allowMissingColumns=True)
        held = tagged.groupBy(*ident).agg(F.collect_list("_l").alias("_ls"), F.max("_in").alias("_in"), F.max("_hit").alias("_hit"))
        late = held.select(*ident, "_in", "_hit", F.explode("_ls").alias("_l")).select(*ident, *[F.col(f"_l.{c}").alias(c) for c in own], "_in", "_hit")
        return late.select(*[c for c in late.columns if c not in ("_in", "_hit")], _backfill_reason().alias("reason"))
    inside = inside.select(*ident).distinct().withColumn("_in", F.lit(True))
    clash = clash.select(*ident).distinct().withColumn("_hit", F.lit(True))
    return late.join(inside, ident, "left").join(clash, ident, "left").select(*late.columns, _backfill_reason().alias("reason"))


def _backfill_reason() -> Column:
    return (F.when(F.col("_in").isNull(), "not_wholly_inside_original_gap")
            .when(F.col("_hit"), "overlaps_original_word"))


def coalesce_zero_length(words: DataFrame, *, reach_ms: int = 50, block: Column | str | None = sc.AUTO) -> DataFrame:
    """Merge zero-length words into the word before (within ``reach_ms``) or after.

    Rows with ``pos`` null collect zero-length words without any word to join.
    """
    solid = F.col("end_ms") > F.col("start_ms")
    here = F.when(solid, F.struct("end_ms", "pos"))
    seen = sc.scan(words, KEY, ["pos"], block, _last=sc.latest(here, inclusive=False),
                   _next=sc.upcoming(F.when(solid, F.col("pos")), inclusive=False))
    target = (F.when(solid, F.col("pos"))
              .when(F.col("start_ms") <= F.col("_last")["end_ms"] + reach_ms, F.col("_last")["pos"])
              .otherwise(F.col("_next")))
    parts = seen.withColumn("_target", target)
    own = F.col("pos") == F.col("_target")
    return parts.groupBy("source_id", F.col("_target").alias("pos")).agg(
        F.min(F.when(own, F.col("start_ms"))).alias("start_ms"), F.max(F.when(own, F.col("end_ms"))).alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "").alias("text"),
        (F.count(F.lit(1)) > 1).alias("merged"))


def tail_overhang(words: DataFrame, detector: DataFrame, media: DataFrame, *, pad_ms: int = 200) -> DataFrame:
    """Sources whose last word ends inside a detector interval that runs on past the padding."""
    last = words.groupBy("source_id").agg(F.max_by(F.struct("end_ms", "start_ms"), F.struct("end_ms", -F.col("pos"))).alias("w"))
    last = last.select("source_id", F.col("w.end_ms").alias("word_end"), F.col("w.start_ms").alias("word_start"))
    found = (detector.select("source_id", F.col("start_ms").alias("d_start"), F.col("end_ms").alias("d_end"))
             .join(last, "source_id")
             .where((F.col("d_start") < F.col("word_end")) & (F.col("word_end") < F.col("d_end"))
                    & (F.col("word_end") > F.col("word_start")) & (F.col("d_end") - F.col("word_end") > pad_ms)))
    first = found.groupBy("source_id", "word_end").agg(F.min(F.struct("d_start", "d_end")).alias("d"))
    return first.join(media, "source_id").select(
        "source_id", F.col("word_end").alias("gap_start"), F.col("duration_ms").alias("gap_end"),
        (F.col("d.d_end") - F.col("word_end")).alias("uncovered_ms"))
