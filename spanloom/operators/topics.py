"""Term weights, topic valleys, repeated texts and lexical topic groups."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from . import islands, scan as sc
from .greedy import greedy_line
from .grouped import Rows, map_groups
from .text_groups import complete_link

KEY = ["source_id"]
# Products are summed as integers of 1e-10, so a sum does not depend on its order.
SCALE = 1e10


@dataclass(frozen=True)
class TopicOptions:
    """Fixed values of the valley rule."""

    min_ms: int = 15_000
    max_ms: int = 90_000
    max_gap_ms: int = 3_000
    window_units: int = 3
    min_segment_units: int = 2
    min_depth: float = 0.15
    pause_ms: int = 400


def term_counts(items: DataFrame, ident: list[str], lexicon: tx.Lexicon) -> DataFrame:
    """``(ident, term, n)`` of every item's text."""
    return (items.select(*ident, F.explode(tx.terms(F.col("text"), lexicon)).alias("term"))
            .groupBy(*ident, "term").agg(F.count(F.lit(1)).alias("n")))


def with_idf(counts: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """Append ``idf = 1 + ln((1 + N) / (1 + df))`` per key; ``sizes`` has the item count ``n_items``."""
    df = counts.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(sizes, key).select(*key, "term", "df", (
        1 + F.log((1 + F.col("n_items")) / (1 + F.col("df")).cast("double"))).alias("idf"))
    return counts.join(idf, [*key, "term"])


def fixed(value: Column) -> Column:
    return F.rint(value * SCALE).cast("bigint")


def boundary_similarity(units: DataFrame, lexicon: tx.Lexicon, options: TopicOptions = TopicOptions(), *,
                        block: Column | str | None = sc.AUTO) -> DataFrame:
    """Cosine of the term weights left and right of every unit boundary inside a hard block.

    Every unit sends its terms to the at most six boundaries whose windows hold
    it; no pair of units is formed. A null similarity means a window without terms.
    """
    near = sc.scan(units, KEY, ["pos"], block, _prev=sc.previous(F.col("end_ms")), _next=sc.following(F.col("start_ms")))
    opens = F.col("_prev").isNull() | (F.col("start_ms") - F.col("_prev") > options.max_gap_ms)
    closes = F.col("_next").isNull() | (F.col("_next") - F.col("end_ms") > options.max_gap_ms)
    placed = sc.scan(near.withColumn("_o", F.when(opens, F.col("pos"))).withColumn("_c", F.when(closes, F.col("pos"))),
                     KEY, ["pos"], block, block_first=sc.latest(F.col("_o")), block_last=sc.upcoming(F.col("_c")))
    placed = placed.select("source_id", "pos", "text", "block_first", "block_last", (F.col("_next") - F.col("end_ms")).alias("gap_ms"))
    if block is None:
        return _bounded_similarity(placed, lexicon, options.window_units)
    placed = cut(placed)
    sizes = placed.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"))
    weighted = with_idf(term_counts(placed, ["source_id", "pos", "block_first", "block_last"], lexicon), sizes, KEY)
    w = options.window_units
    low = F.greatest(F.col("pos") - w, F.col("block_first"))
    high = F.least(F.col("pos") + w - 1, F.col("block_last") - 1)
    sent = weighted.where(low <= high).select(
        "source_id", "term", "idf", "n", "pos", F.explode(F.sequence(low, high)).alias("after_unit"))
    is_left = F.col("pos") <= F.col("after_unit")
    sides = sent.groupBy("source_id", "after_unit", "term").agg(
        F.max("idf").alias("idf"), F.sum(F.when(is_left, F.col("n"))).alias("l"), F.sum(F.when(~is_left, F.col("n"))).alias("r"))
    a, b = (1 + F.log("l")) * F.col("idf"), (1 + F.log("r")) * F.col("idf")
    sums = sides.groupBy("source_id", "after_unit").agg(
        F.sum(fixed(a * b)).alias("dot"), F.sum(fixed(a * a)).alias("na"), F.sum(fixed(b * b)).alias("nb"))
    found = sums.select("source_id", "after_unit", _cosine().alias("similarity"))
    edges = placed.where("pos < block_last OR gap_ms IS NOT NULL").select(
        "source_id", F.col("pos").alias("after_unit"), "block_first", "block_last", "gap_ms",
        tx.ends_terminal(F.col("text")).alias("terminal"), (F.col("pos") == F.col("block_last")).alias("hard"))
    return edges.join(found, ["source_id", "after_unit"], "left")


def _bounded_similarity(placed: DataFrame, lexicon: tx.Lexicon, w: int) -> DataFrame:
    """``boundary_similarity`` for sources of one input row each, without a shuffle behind the one that dealt them.

    The occurrences of a term in a hard block are one line, by unit. The first unit of a boundary's window that holds
    the term finds the term's counts on both sides in the ``2 w`` units from it on, so a boundary gets one row a term,
    and only sums are kept for it. A row without term carries the facts of a unit's own boundary.
    """
    items = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    edge = (F.col("pos") < F.col("block_last")) | F.col("gap_ms").isNotNull()
    # Folding leaves the JVM and the dealt order with it, so a text is dealt once more here, folded and without its words.
    named = placed.select("source_id", "pos", "block_first", "block_last", "gap_ms", edge.alias("edge"),
                          tx.ends_terminal(F.col("text")).alias("terminal"), tx.folded(F.col("text")).alias("_folded"))
    named = named.withColumn("n_items", items).select("*", F.explode(F.concat(
        tx.folded_terms(F.col("_folded"), lexicon), F.array(F.lit(None).cast("string")))).alias("term")).drop("_folded")
    line = Window.partitionBy("source_id", "term", "block_first").orderBy("pos")
    near = named.withColumn("_p", F.lag("pos").over(line)).withColumns(
        {f"_n{j}": F.count(F.lit(1)).over(line.rangeBetween(j, j)) for j in range(2 * w)})
    # One row a unit that holds the term; their number in the source is the term's document frequency.
    fresh = F.col("_p").isNull() | (F.col("_p") < F.col("pos"))
    counted = near.withColumn("_df", F.count_if(fresh).over(Window.partitionBy("source_id", "term"))).where(fresh)
    marker, p, n = F.col("term").isNull(), F.col("pos"), [F.col(f"_n{j}") for j in range(2 * w)]
    idf = 1 + F.log((1 + F.col("n_items")) / (1 + F.col("_df")).cast("double"))
    low = F.greatest(p - w, F.col("block_first"), F.coalesce(F.col("_p") + w, p - w))
    high = F.least(p + w - 1, F.col("block_last") - 1)

    def sent(d: int) -> Column:
        """Products of the term at boundary ``pos + d``; null where an earlier unit sends them or no boundary is."""
        total = lambda js: sum((n[j] for j in js), F.lit(0).cast("bigint"))
        left, right = total(range(0, d + 1)), total(range(max(d + 1, 0), d + w + 1))
        a, b = [F.when(m > 0, (1 + F.log(m)) * F.col("idf")) for m in (left, right)]
        zero = F.lit(0).cast("bigint")
        return F.when(~marker & (p + d).between(low, high), F.struct(
            (p + d).alias("after_unit"), F.coalesce(fixed(a * b), zero).alias("dot"),
            F.coalesce(fixed(a * a), zero).alias("na"), F.coalesce(fixed(b * b), zero).alias("nb"), F.lit(False).alias("own")))

    zero = F.lit(0).cast("bigint")
    own = F.when(marker & F.col("edge"), F.struct(p.alias("after_unit"), zero.alias("dot"), zero.alias("na"), zero.alias("nb"), F.lit(True).alias("own")))
    each = counted.withColumn("idf", idf).select(
        "source_id", "pos", "block_first", "block_last", "gap_ms", "terminal", F.explode(F.array(own, *[sent(d) for d in range(-w, w)])).alias("_s")
    ).where("_s IS NOT NULL").select("source_id", "block_first", "block_last", "gap_ms", "terminal", "_s.*")
    fact = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    sums = each.groupBy("source_id", "after_unit").agg(
        fact("block_first"), fact("block_last"), fact("gap_ms"), fact("terminal"),
        F.sum("dot").alias("dot"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return sums.select("source_id", "after_unit", "block_first", "block_last", "gap_ms", "terminal",
                       (F.col("after_unit") == F.col("block_last")).alias("hard"), _cosine().alias("similarity"))


def _cosine() -> Column:
    """Similarity of two sides by their sums ``dot``, ``na``, ``nb``; null where a side has no term."""
    cosine = F.least(F.lit(1.0), F.coalesce("dot", F.lit(0)) / (F.sqrt("na") * F.sqrt("nb")))
    return F.when((F.col("na") > 0) & (F.col("nb") > 0), F.rint(cosine * 1e9) / 1e9)


def valleys(boundaries: DataFrame, *, block: Column | str | None = sc.AUTO) -> DataFrame:
    """Local minima of each uninterrupted similarity curve with their relative depth.

    A plateau counts once, at its middle; the peaks are the first local maxima on
    each side. A missing similarity interrupts the curve.
    """
    curve = boundaries.where("similarity IS NOT NULL")
    near = sc.scan(curve, KEY, ["after_unit"], block,
                   _p=sc.previous(F.struct("after_unit", "similarity")), _n=sc.following(F.struct("after_unit", "similarity")))
    v = F.col("similarity")
    ps = F.when(F.col("_p.after_unit") == F.col("after_unit") - 1, F.col("_p.similarity"))
    ns = F.when(F.col("_n.after_unit") == F.col("after_unit") + 1, F.col("_n.similarity"))
    near = near.withColumn("ps", ps).withColumn("ns", ns).drop("_p", "_n")
    near = near.withColumn("_start", F.when(F.col("ps").isNull() | (F.col("ps") != v), F.col("after_unit"))) \
        .withColumn("_lp", F.when(F.col("ps").isNull() | (F.col("ps") < v), v)) \
        .withColumn("_rp", F.when(F.col("ns").isNull() | (F.col("ns") < v), v))
    seen = sc.scan(near, KEY, ["after_unit"], block, plateau=sc.latest(F.col("_start")),
                   lp=sc.latest(F.col("_lp"), inclusive=False), rp=sc.upcoming(F.col("_rp"), inclusive=False))
    at = F.col("after_unit")
    flat = seen.groupBy("source_id", "plateau", "block_first", "block_last").agg(
        F.max(at).alias("stop"), F.min("similarity").alias("similarity"), F.min_by("ps", at).alias("ps"),
        F.max_by("ns", at).alias("ns"), F.min_by("lp", at).alias("left_peak"), F.max_by("rp", at).alias("right_peak"))
    raw = (F.col("left_peak") - F.col("similarity")) + (F.col("right_peak") - F.col("similarity"))
    return flat.where("ps > similarity AND ns > similarity").select(
        "source_id", (F.col("plateau") + F.floor((F.col("stop") - F.col("plateau")) / 2)).alias("after_unit"),
        "block_first", "block_last", "similarity", "left_peak", "right_peak",
        (F.rint(raw / (F.col("left_peak") + F.col("right_peak")) * 1e9) / 1e9).alias("depth"))


def topic_cuts(boundaries: DataFrame, options: TopicOptions = TopicOptions(), *, guarded: bool = False,
               block: Column | str | None = sc.AUTO) -> DataFrame:
    """Decision per valley: accepted, or rejected with its reason."""
    found = valleys(boundaries, block=block)
    if guarded:
        proof = boundaries.select("source_id", "after_unit", (F.col("terminal") | (F.col("gap_ms") >= options.pause_ms)).alias("supported"))
        found = found.join(proof, ["source_id", "after_unit"])
    else:
        found = found.withColumn("supported", F.lit(True))
    m = options.min_segment_units
    # Between two valleys there is a higher boundary, so they never lie closer than two units.
    apart = m <= 2
    found = found if apart else cut(found)
    roomy = (F.col("after_unit") - F.col("block_first") + 1 >= m) & (F.col("block_last") - F.col("after_unit") >= m)
    eligible = F.col("supported") & (F.col("depth") >= options.min_depth)
    if apart:
        reason = (F.when(~F.col("supported"), "no_utterance_end_evidence").when(F.col("depth") < options.min_depth, "below_min_depth")
                  .when(~roomy, "min_segment_units_conflict"))
        return found.select("source_id", "after_unit", "similarity", "left_peak", "right_peak", "depth", reason.alias("reason"))
    pool = found.where(eligible & roomy)
    order = [-F.col("depth"), F.col("similarity"), F.col("after_unit")]
    fate = greedy_line(pool, KEY, order, "after_unit", start="after_unit", end="after_unit", spacing=m, stretch=4096)
    held = found.join(fate.select("source_id", "after_unit", "retained"), ["source_id", "after_unit"], "left")
    reason = (F.when(~F.col("supported"), "no_utterance_end_evidence").when(F.col("depth") < options.min_depth, "below_min_depth")
              .when(~F.coalesce("retained", F.lit(False)), "min_segment_units_conflict"))
    return held.select("source_id", "after_unit", "similarity", "left_peak", "right_peak", "depth", reason.alias("reason"))


def drop_crossed(cuts: DataFrame, links: DataFrame) -> DataFrame:
    """Accepted cuts, those inside a dependency link rejected; nothing is rescheduled."""
    counted = islands.active_counts(cuts, links, KEY, "after_unit", "first_unit", "last_unit")
    crossed = F.col("reason").isNull() & (F.col("active") > 0)
    return counted.withColumn("reason", F.when(crossed, "event_dependency_crosses_cut").otherwise(F.col("reason")))


def unresolved_spans(links: DataFrame, edges: DataFrame, boundaries: DataFrame, units: DataFrame, *, block: Column | str | None = sc.AUTO) -> DataFrame:
    """Stretches of units that cannot be a whole fragment: ``source_id, first_unit, last_unit``, disjoint.

    A link that a hard pause severs leaves all its units unresolved. An open edge does so for its unit, a quotation
    without opener for all units up to it, one without closer for all from it on; a bare demonstrative only warns.
    """
    hard = boundaries.where("hard AND gap_ms IS NOT NULL").select("source_id", F.col("after_unit").alias("pos"), F.col("after_unit").alias("_hard"))
    line = units.select("source_id", "pos").join(hard, ["source_id", "pos"], "left")
    ahead = sc.scan(line, KEY, ["pos"], block, _pause=sc.upcoming(F.col("_hard"))).select("source_id", F.col("pos").alias("first_unit"), "_pause")
    severed = links.join(ahead, ["source_id", "first_unit"]).where("_pause < last_unit").select("source_id", "first_unit", "last_unit")
    ends = units.groupBy("source_id").agg(F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    at = F.coalesce("first_unit", "last_unit")
    open_ = edges.where("kind <> 'unresolved_demonstrative'").join(ends, "source_id").select(
        "source_id", F.when(F.col("kind") == "quotation_missing_opener", F.col("_low")).otherwise(at).alias("first_unit"),
        F.when(F.col("kind") == "quotation_missing_closer", F.col("_high")).otherwise(at).alias("last_unit"))
    return islands.inclusive_union(severed.unionByName(open_), KEY, "first_unit", "last_unit").select("source_id", "first_unit", "last_unit")


def topic_segments(cuts: DataFrame, boundaries: DataFrame, units: DataFrame, options: TopicOptions = TopicOptions(), *,
                   blocking: DataFrame | None = None, unresolved: DataFrame | None = None, block: Column | str | None = sc.AUTO) -> DataFrame:
    """Segments between accepted cuts and hard pauses with the reasons that exclude them."""
    accepted = cuts.where("reason IS NULL").select("source_id", "after_unit")
    hard = boundaries.where("hard AND gap_ms IS NOT NULL").select("source_id", "after_unit")
    marks = accepted.unionByName(hard).distinct().withColumn("_cut", F.col("after_unit"))
    rows = units.select("source_id", "pos", "start_ms", "end_ms").join(
        marks.withColumnRenamed("after_unit", "pos"), ["source_id", "pos"], "left")
    placed = sc.scan(rows, KEY, ["pos"], block, _seg=sc.latest(F.col("_cut"), inclusive=False))
    segments = placed.groupBy("source_id", F.coalesce("_seg", F.lit(0)).alias("_s")).agg(
        F.min("pos").alias("first_unit"), F.max("pos").alias("last_unit"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_s")
    return judged_segments(segments, options, blocking=blocking, unresolved=unresolved)


def judged_segments(segments: DataFrame, options: TopicOptions = TopicOptions(), *, blocking: DataFrame | None = None,
                    unresolved: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """``segments`` with the reasons that exclude them; see ``gaps.touched_by`` for ``bounded`` sources."""
    if blocking is None:
        segments = segments.withColumn("touched", F.lit(False))
    else:
        from .gaps import touched_by
        segments = touched_by(segments, blocking, ["first_unit"], bounded=bounded)
    if unresolved is None:
        segments = segments.withColumn("_unresolved", F.lit(False))
    else:
        from .range_join import overlap_join
        a = segments.select("source_id", "first_unit", F.col("first_unit").alias("_s1"), (F.col("last_unit") + 1).alias("_e1"))
        b = unresolved.select("source_id", F.col("first_unit").alias("_s2"), (F.col("last_unit") + 1).alias("_e2"))
        met = overlap_join(a, b, KEY, ("_s1", "_e1"), ("_s2", "_e2"), bin_ms=64).select("source_id", "first_unit").distinct().withColumn("_met", F.lit(True))
        segments = segments.join(met, ["source_id", "first_unit"], "left").withColumn("_unresolved", F.col("_met").isNotNull()).drop("_met")
    duration = F.col("end_ms") - F.col("start_ms")
    reasons = F.filter(F.array(F.when(duration < options.min_ms, "below_min_seconds"),
                               F.when(duration > options.max_ms, "above_max_seconds"),
                               F.when(F.col("touched"), "suspect_asr_coverage"),
                               F.when(F.col("_unresolved"), "unresolved_event_dependency")), lambda r: r.isNotNull())
    return segments.select("source_id", "first_unit", "last_unit", "start_ms", "end_ms",
                           F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def copies(items: DataFrame, ident: str, order: Column, lexicon: tx.Lexicon, *, bounded: bool = False) -> DataFrame:
    """First item of each group of equal texts in a source: copies never form pairs.

    The items of ``bounded`` sources (one input row each) are compared in a window, so each is folded and hashed once.
    """
    same = [*KEY, "_hash"]
    hashed = items.withColumn("_hash", F.sha2(F.to_json(F.struct(
        tx.compact(F.col("text")).alias("c"), tx.safeguards(F.col("text"), lexicon).alias("s"))), 256))
    if bounded:
        group = Window.partitionBy(*same)
        return hashed.withColumn("copy_of", F.min_by(ident, order).over(group)).withColumn("copies", F.count(F.lit(1)).over(group)).drop("_hash")
    first = hashed.groupBy(*same).agg(F.min_by(ident, order).alias("copy_of"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(first, same).drop("_hash")


def similar_pairs(items: DataFrame, ident: str, lexicon: tx.Lexicon, threshold: float, *, prefix: bool = True) -> DataFrame:
    """Pairs of one source with TF-IDF cosine of at least ``threshold``, exactly.

    Terms are ordered from rare to frequent. Vectors are cut where the rest can no
    longer reach the threshold: two items can only be similar when they share a
    term of both heads, so the index holds rare terms only.
    """
    sizes = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"))
    counts = with_idf(term_counts(items, ["source_id", ident], lexicon), sizes, KEY)
    weight = (1 + F.log("n")) * F.col("idf")
    vectors = counts.withColumn("w", weight)
    norms = vectors.groupBy("source_id", ident).agg(F.sum(fixed(F.col("w") * F.col("w"))).alias("nn"))
    head = vectors
    if prefix:
        # One item's vector is bounded by its own text.
        rest = Window.partitionBy("source_id", ident).orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
        tail = F.sum(fixed(F.col("w") * F.col("w"))).over(rest)
        head = (vectors.withColumn("_tail", tail).join(norms, ["source_id", ident])
                .where(F.sqrt(F.col("_tail") / F.col("nn")) >= threshold - 1e-6).drop("_tail", "nn"))
    a = head.select("source_id", "term", F.col(ident).alias("a"))
    b = head.select("source_id", "term", F.col(ident).alias("b"))
    pairs = a.join(b, ["source_id", "term"]).where("a < b").select("source_id", "a", "b").distinct()
    va = vectors.select("source_id", F.col(ident).alias("a"), "term", F.col("w").alias("wa"))
    vb = vectors.select("source_id", F.col(ident).alias("b"), "term", F.col("w").alias("wb"))
    dots = (pairs.join(va, ["source_id", "a"]).join(vb, ["source_id", "b", "term"])
            .groupBy("source_id", "a", "b").agg(F.sum(fixed(F.col("wa") * F.col("wb"))).alias("dot")))
    na = norms.select("source_id", F.col(ident).alias("a"), F.col("nn").alias("na"))
    nb = norms.select("source_id", F.col(ident).alias("b"), F.col("nn").alias("nb"))
    cosine = F.least(F.lit(1.0), F.col("dot") / (F.sqrt("na") * F.sqrt("nb")))
    return (dots.join(na, ["source_id", "a"]).join(nb, ["source_id", "b"])
            .select("source_id", "a", "b", (F.rint(cosine * 1e9) / 1e9).alias("similarity"))
            .where(F.col("similarity") >= threshold))


def sequence_ratio(a: str, b: str) -> Column:
    """Matching-block ratio of few surviving text pairs."""
    return F.pandas_udf(_ratio, "double")(a, b)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def near_duplicates(items: DataFrame, ident: str, lexicon: tx.Lexicon, *, threshold: float = 0.92,
                    ratio: bool = True) -> DataFrame:
    """Pairs of nearly equal texts in a source, among the first items of equal texts.

    Length, numbers and negations are compared before the sequence ratio, which
    only sees what is left.
    """
    keyed = items.select("source_id", ident, "text")
    pairs = similar_pairs(keyed, ident, lexicon, threshold)
    form = keyed.select("source_id", F.col(ident).alias("a"), tx.compact(F.col("text")).alias("ca"),
                        tx.safeguards(F.col("text"), lexicon).alias("ga"))
    other = form.select("source_id", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("ga").alias("gb"))
    small, big = F.least(F.length("ca"), F.length("cb")), F.greatest(F.length("ca"), F.length("cb"))
    left = (pairs.join(form, ["source_id", "a"]).join(other, ["source_id", "b"])
            .where((small >= 20) & (small * 10 >= big * 9) & (F.col("ga") == F.col("gb"))))
    if ratio:
        left = left.where(sequence_ratio("ca", "cb") >= threshold)
    return left.select("source_id", "a", "b", "similarity")


def group_topics(items: DataFrame, lexicon: tx.Lexicon, *, threshold: float = 0.28) -> DataFrame:
    """Complete-link duplicate clusters and topic groups in rank order.

    ``items`` has ``source_id, rank, text``. Spark finds the similar pairs; the
    sequential part walks each connected component of them in rank order and keeps one
    number per item. A group accepts a cluster only if every pair between them reaches
    the threshold.
    """
    pairs = cut(similar_pairs(items, "rank", lexicon, threshold))
    twins = near_duplicates(items, "rank", lexicon).select("source_id", F.col("b").alias("item"), F.col("a").alias("other"),
                                                         F.lit(1.0).alias("similarity"))
    own = items.select("source_id", F.col("rank").alias("item"), F.lit(None).cast("bigint").alias("other"),
                       F.lit(None).cast("double").alias("similarity"))
    clusters = cut(_complete_link(twins.unionByName(own), first_fit=True))
    size = clusters.groupBy("source_id", "head").agg(F.count(F.lit(1)).alias("size"))
    ca = clusters.select("source_id", F.col("item").alias("a"), F.col("head").alias("ha"))
    cb = clusters.select("source_id", F.col("item").alias("b"), F.col("head").alias("hb"))
    between = (pairs.join(ca, ["source_id", "a"]).join(cb, ["source_id", "b"]).where("ha <> hb")
               .groupBy("source_id", F.greatest("ha", "hb").alias("item"), F.least("ha", "hb").alias("other"))
               .agg(F.min("similarity").alias("similarity"), F.count(F.lit(1)).alias("_n")))
    s1 = size.select("source_id", F.col("head").alias("item"), F.col("size").alias("_a"))
    s2 = size.select("source_id", F.col("head").alias("other"), F.col("size").alias("_b"))
    whole = (between.join(s1, ["source_id", "item"]).join(s2, ["source_id", "other"])
             .where("_n = _a * _b").select("source_id", "item", "other", "similarity"))
    heads = size.select("source_id", F.col("head").alias("item"), F.lit(None).cast("bigint").alias("other"),
                        F.lit(None).cast("double").alias("similarity"))
    groups = _complete_link(whole.unionByName(heads), first_fit=False).select(
        "source_id", F.col("item").alias("duplicate_of"), F.col("head").alias("topic"))
    return clusters.select("source_id", F.col("item").alias("rank"), F.col("head").alias("duplicate_of")).join(
        groups, ["source_id", "duplicate_of"])


def _components(links: DataFrame) -> DataFrame:
    """``(source_id, item, part)`` of linked items ``a, b``; ``part`` is the least item of the component.

    Alternating star contractions: the larger, then the smaller neighbours of an item are
    linked to the least item known there, until the links no longer change.
    """
    def pair(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))

    def pairs(df: DataFrame, *two: Column) -> DataFrame:
        return df.select("source_id", F.explode(F.array(*two)).alias("e")).select("source_id", "e.a", "e.b").where("a <> b")

    now, seen = cut(links.where("a <> b").select("source_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = pairs(now, pair("a", "b"), pair("b", "a"))
        low = both.groupBy("source_id", "a").agg(F.min("b").alias("m")).select("source_id", "a", F.least("a", "m").alias("m"))
        large = cut(both.where("b > a").join(low, ["source_id", "a"]).select("source_id", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("source_id", "a").agg(F.min("b").alias("m"))
        now = cut(pairs(large.join(least, ["source_id", "a"]), pair("a", "m"), pair("b", "m")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("source_id", "a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            roots = now.groupBy("source_id", F.col("a").alias("item")).agg(F.min("b").alias("part"))
            return roots.unionByName(roots.select("source_id", F.col("part").alias("item"), "part").distinct())
        seen = state


def _complete_link(edges: DataFrame, *, first_fit: bool) -> DataFrame:
    """Walk items in order; join the first (or most similar) group whose every member is linked.

    Members of a group are all linked, so each connected component is walked by itself.
    """
    edges = cut(edges)
    parts = _components(edges.where("other IS NOT NULL").select("source_id", F.col("item").alias("a"), F.col("other").alias("b")))
    placed = edges.join(parts, ["source_id", "item"], "left").withColumn("part", F.coalesce("part", "item"))

    def walk(rows: Rows) -> Rows:
        head = complete_link(rows["item"], rows["other"], rows["similarity"], first_fit=first_fit)
        ids = np.array(list(head), dtype=np.int64)
        return {"source_id": np.repeat(rows["source_id"][:1], len(ids)), "item": ids,
                "head": np.array(list(head.values()), dtype=np.int64)}

    return map_groups(placed, ["source_id", "part"], ["item", "other"], walk, "source_id bigint, item bigint, head bigint")


def topic_labels(groups: DataFrame, items: DataFrame, lexicon: tx.Lexicon, k: int = 3) -> DataFrame:
    """Up to ``k`` terms shared by all members, heaviest first, none inside another."""
    sizes = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"))
    counts = with_idf(term_counts(items, ["source_id", "rank"], lexicon), sizes, KEY).withColumn(
        "w", (1 + F.log("n")) * F.col("idf"))
    norms = counts.groupBy("source_id", "rank").agg(F.sum(fixed(F.col("w") * F.col("w"))).alias("nn"))
    unit = counts.join(norms, ["source_id", "rank"]).withColumn("u", F.col("w") / F.sqrt(F.col("nn") / SCALE))
    members = groups.groupBy("source_id", "topic").agg(F.count(F.lit(1)).alias("members"))
    shared = (unit.join(groups, ["source_id", "rank"]).groupBy("source_id", "topic", "term")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum(fixed(F.col("u"))).alias("weight"))
              .join(members, ["source_id", "topic"]).where("_n = members"))
    ranked = shared.groupBy("source_id", "topic").agg(F.array_sort(F.collect_list(
        F.struct(-F.col("weight"), -F.length("term"), "term"))).alias("_t"))
    picked = F.aggregate("_t", F.array().cast("array<string>"), lambda acc, t: F.when(
        (F.size(acc) < k) & ~F.exists(acc, lambda o: o.contains(t["term"]) | t["term"].contains(o)),
        F.concat(acc, F.array(t["term"]))).otherwise(acc))
    return members.join(ranked.select("source_id", "topic", F.array_join(picked, " · ").alias("label")),
                        ["source_id", "topic"], "left").select(
        "source_id", "topic", "members", F.coalesce("label", F.concat(F.lit("#"), F.col("topic").cast("string"))).alias("label"))
