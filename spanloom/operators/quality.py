"""Contract checks that return violation rows, and validation of outside answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan as sc
from .range_join import overlap_join

KEY = ["source_id"]


def present(*options: Column) -> Column:
    """The non-null members of ``options`` as an array."""
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def reasons(*options: Column) -> Column:
    return F.array_join(present(*options), ",")


def check_intervals(rows: DataFrame, media: DataFrame, ident: str, *, order: str, block: Column | None) -> DataFrame:
    """Rows outside ``0 <= start < end <= duration``, out of start order, or with a repeated id."""
    seen = sc.scan(rows, KEY, [order], block, _prev=sc.previous(F.col("start_ms")))
    twice = rows.groupBy("source_id", ident).agg(F.count(F.lit(1)).alias("_n"))
    full = seen.join(media, "source_id", "left").join(twice, ["source_id", ident])
    rules = present(
        F.when(~((F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("end_ms"))
                 & (F.col("end_ms") <= F.coalesce("duration_ms", F.col("end_ms")))), "range"),
        F.when(F.col("start_ms") < F.col("_prev"), "order"), F.when(F.col("_n") > 1, "duplicate_id"))
    return full.select("source_id", order, F.explode(rules).alias("rule"))


def check_tiling(rows: DataFrame, media: DataFrame, *, tolerance_ms: int = 0, block: Column | None) -> DataFrame:
    """Sources whose intervals leave a gap, overlap, or do not cover the whole duration."""
    seen = sc.scan(rows, KEY, ["start_ms", "end_ms"], block, _prev=sc.previous(F.col("end_ms")))
    off = F.abs(F.col("start_ms") - F.coalesce("_prev", F.lit(0))) > tolerance_ms
    per = seen.groupBy("source_id").agg(F.count_if(off).alias("breaks"), F.max("end_ms").alias("_end"))
    full = media.join(per, "source_id", "left")
    short = F.abs(F.coalesce("_end", F.lit(0)) - F.col("duration_ms")) > tolerance_ms
    return full.where((F.col("breaks") > 0) | short).select(
        "source_id", F.coalesce("breaks", F.lit(0)).alias("breaks"), short.alias("not_covered"))


def check_ownership(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Words that are not owned exactly once, and sentences whose bounds differ from their words.

    ``sentences`` has ``pos, start_ms, end_ms, word_ids`` (array of word positions).
    """
    owned = sentences.select("source_id", F.col("pos").alias("sentence"), F.col("start_ms").alias("s_start"),
                             F.col("end_ms").alias("s_end"), F.explode("word_ids").alias("pos"))
    uses = owned.groupBy("source_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    both = words.select("source_id", "pos", F.lit(True).alias("_w")).join(uses, ["source_id", "pos"], "full_outer")
    lone = both.select("source_id", "pos", F.when(F.col("_w").isNull(), "unknown_word").when(F.col("n").isNull(), "unowned_word")
                       .when(F.col("n") > 1, "word_owned_twice").alias("rule")).where("rule IS NOT NULL")
    bounds = (owned.join(words, ["source_id", "pos"]).groupBy("source_id", "sentence", "s_start", "s_end")
              .agg(F.min("start_ms").alias("_a"), F.max("end_ms").alias("_b")).where("_a <> s_start OR _b <> s_end"))
    return lone.unionByName(bounds.select("source_id", F.col("sentence").alias("pos"), F.lit("sentence_bounds").alias("rule")))


def check_bounded_ownership(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """``check_ownership`` for sources of one input row each: uses meet their word where the words of the source lie."""
    uses = sentences.select("source_id", F.struct(F.col("pos").alias("sentence"), F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end")).alias("_o"),
                            F.explode("word_ids").alias("pos"))
    tagged = words.select("source_id", "pos", F.struct("start_ms", "end_ms").alias("_w")).unionByName(uses, allowMissingColumns=True)
    met = tagged.groupBy("source_id", "pos").agg(F.collect_list("_w").alias("_ws"), F.collect_list("_o").alias("_os"))
    n = F.size("_os")
    rule = F.when(F.size("_ws") == 0, "unknown_word").when(n == 0, "unowned_word").when(n > 1, "word_owned_twice")
    row = lambda pos, rule, o, w: F.struct(pos.alias("pos"), rule.alias("rule"), o["s_start"].alias("s_start"), o["s_end"].alias("s_end"), w["start_ms"].alias("a"), w["end_ms"].alias("b"))
    none, w = F.get("_os", F.lit(-1)), F.get("_ws", F.lit(0))
    bounds = F.transform("_os", lambda o: row(o["sentence"], F.lit("sentence_bounds"), o, w))
    own = F.when(rule.isNotNull(), F.array(row(F.col("pos"), rule, none, F.get("_ws", F.lit(-1))))).otherwise(F.slice(bounds, 1, 0))
    each = met.select("source_id", F.explode(F.concat(own, bounds)).alias("_r")).select("source_id", "_r.*")
    found = each.groupBy("source_id", "pos", "rule", "s_start", "s_end").agg(F.min("a").alias("_a"), F.max("b").alias("_b"))
    return found.where("rule <> 'sentence_bounds' OR _a <> s_start OR _b <> s_end").select("source_id", "pos", "rule")


def check_candidates(candidates: DataFrame, sentences: DataFrame, *, min_ms: int = 15_000, max_ms: int = 90_000,
                     max_gap_ms: int = 3_000, block: Column | str | None = sc.AUTO) -> DataFrame:
    """Rules a candidate breaks: refs, bounds, duration, foreign sentences, pauses, repeated ranges.

    ``candidates`` has ``candidate, start_ms, end_ms, refs`` (array of sentence positions).
    """
    paced = sc.scan(sentences.select("source_id", "pos", "start_ms", "end_ms"), KEY, ["pos"], block, _prev=sc.max_before(F.col("end_ms")))
    refs = candidates.select("source_id", "candidate", F.posexplode("refs").alias("_i", "pos"))
    joined = refs.join(paced.select("source_id", "pos", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"),
                                    (F.col("start_ms") - F.col("_prev") > max_gap_ms).alias("_pause")), ["source_id", "pos"], "left")
    first = F.min("pos")
    per = joined.groupBy("source_id", "candidate").agg(
        F.count_if(F.col("r_start").isNull()).alias("unknown"), F.count(F.lit(1)).alias("_n"), first.alias("_f"), F.max("pos").alias("_l"),
        F.min("r_start").alias("_s"), F.max("r_end").alias("_e"), F.count_if(F.col("_pause") & (F.col("_i") > 0)).alias("pauses"))
    s = sentences.select("source_id", "pos", F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"))
    spans = candidates.select("source_id", "candidate", "start_ms", "end_ms", "refs")
    foreign = (overlap_join(spans, s, KEY, ("start_ms", "end_ms"), ("o_start", "o_end")).where(~F.array_contains("refs", F.col("pos")))
               .select("source_id", "candidate").distinct().withColumn("_foreign", F.lit(True)))
    same = candidates.groupBy("source_id", "start_ms", "end_ms").agg(F.count(F.lit(1)).alias("_same"))
    full = (candidates.join(per, ["source_id", "candidate"], "left").join(foreign, ["source_id", "candidate"], "left")
            .join(same, ["source_id", "start_ms", "end_ms"]))
    rules = reasons(
        F.when(F.col("unknown") > 0, "unknown_sentence"), F.when(F.col("_l") - F.col("_f") + 1 != F.col("_n"), "not_contiguous"),
        F.when((F.col("_s") != F.col("start_ms")) | (F.col("_e") != F.col("end_ms")), "bounds"),
        F.when(~(F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms), "duration"), F.when(F.col("_foreign"), "foreign_sentence"),
        F.when(F.col("pauses") > 0, "long_gap"), F.when(F.col("_same") > 1, "duplicate_range"))
    return full.select("source_id", "candidate", rules.alias("rules")).where("rules <> ''")


def check_bounded_candidates(candidates: DataFrame, sentences: DataFrame, *, min_ms: int = 15_000, max_ms: int = 90_000,
                             max_gap_ms: int = 3_000, bin_rows: int = 64, bin_ms: int = 120_000) -> DataFrame:
    """``check_candidates`` for sources that are one input row each: no row per reference, and nothing is dealt.

    Candidates meet the sentences of the bins of positions that they refer to, and those of the bins of time that they
    cover, in gathered arrays; each bin gives one row a candidate.
    """
    paced = sc.scan(sentences.select("source_id", "pos", "start_ms", "end_ms"), KEY, ["pos"], None, _prev=sc.max_before(F.col("end_ms")))
    unit = F.struct("pos", "start_ms", "end_ms", (F.col("start_ms") - F.col("_prev") > max_gap_ms).alias("pause"))
    rows, time = lambda at: F.floor(at / F.lit(bin_rows)), lambda at: F.floor(at / F.lit(bin_ms))
    low, high = F.array_min("refs"), F.array_max("refs")
    item = F.struct("candidate", "start_ms", "end_ms", "refs", low.alias("f"), high.alias("l"), (F.size(F.array_distinct("refs")) == high - low + 1).alias("whole"))
    spread = lambda bins: candidates.select("source_id", F.explode(bins).alias("_bin"), item.alias("_c"))
    gathered = lambda cs, us: cs.unionByName(us, allowMissingColumns=True).groupBy("source_id", "_bin").agg(
        F.collect_list("_c").alias("_cs"), F.collect_list("_u").alias("_us"))
    none = lambda kind: F.lit(None).cast(kind)
    # Sentences of a bin at the places of their positions.
    base = F.col("_bin") * bin_rows
    at = lambda p: F.get("_line", (p - base).cast("int"))
    here = lambda p: (p >= base) & (p < base + bin_rows)
    held = gathered(spread(F.sequence(rows(low), rows(high))), paced.select("source_id", rows(F.col("pos")).alias("_bin"), unit.alias("_u")))
    held = held.where(F.size("_cs") > 0).withColumn("_line", F.transform(F.sequence(base, base + bin_rows - 1), lambda p: F.get(F.filter("_us", lambda u: u["pos"] == p), F.lit(0))))

    def referred(c: Column) -> Column:
        own = F.filter(c["refs"], here)
        later = F.filter(c["refs"], lambda p, i: (i > 0) & here(p))
        return F.struct(c.alias("c"), F.size(F.filter(own, lambda p: at(p)["pos"].isNull())).alias("unknown"), F.array_min(F.transform(own, lambda p: at(p)["start_ms"])).alias("s"),
                        F.array_max(F.transform(own, lambda p: at(p)["end_ms"])).alias("e"), F.size(F.filter(later, lambda p: at(p)["pause"])).alias("pauses"), F.lit(False).alias("foreign"))

    known = held.select("source_id", F.explode(F.transform("_cs", referred)).alias("_r"))
    covered = F.sequence(time(F.col("start_ms")), F.greatest(time(F.col("start_ms")), time(F.col("end_ms"))))
    around = gathered(spread(covered), paced.where("start_ms <= end_ms").select(
        "source_id", F.explode(F.sequence(time(F.col("start_ms")), time(F.col("end_ms")))).alias("_bin"), unit.alias("_u")))

    def met(c: Column) -> Column:
        foreign = F.exists("_us", lambda u: (u["start_ms"] < c["end_ms"]) & (u["end_ms"] > c["start_ms"])
                           & ~F.coalesce(u["pos"].between(c["f"], c["l"]) & (c["whole"] | F.array_contains(c["refs"], u["pos"])), F.lit(False)))
        return F.struct(c.alias("c"), F.lit(0).alias("unknown"), none("bigint").alias("s"), none("bigint").alias("e"), F.lit(0).alias("pauses"),
                        (F.coalesce(foreign, F.lit(False)) & (c["start_ms"] <= c["end_ms"])).alias("foreign"))

    part = known.unionByName(around.select("source_id", F.explode(F.transform("_cs", met)).alias("_r"))).select("source_id", "_r.*")
    part = part.select("source_id", "c.candidate", "c.start_ms", "c.end_ms", F.size("c.refs").alias("_n"), F.col("c.f").alias("_f"),
                       F.col("c.l").alias("_l"), "unknown", "s", "e", "pauses", "foreign")
    full = part.groupBy("source_id", "candidate", "start_ms", "end_ms", "_n", "_f", "_l").agg(
        F.sum("unknown").alias("unknown"), F.min("s").alias("_s"), F.max("e").alias("_e"), F.sum("pauses").alias("pauses"), F.max("foreign").alias("foreign"))
    same = Window.partitionBy("source_id", "start_ms", "end_ms")
    full = full.withColumn("_same", F.count(F.lit(1)).over(same))
    rules = reasons(
        F.when(F.col("unknown") > 0, "unknown_sentence"), F.when(F.col("_l") - F.col("_f") + 1 != F.col("_n"), "not_contiguous"),
        F.when((F.col("_s") != F.col("start_ms")) | (F.col("_e") != F.col("end_ms")), "bounds"),
        F.when(~(F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms), "duration"), F.when(F.col("foreign"), "foreign_sentence"),
        F.when(F.col("pauses") > 0, "long_gap"), F.when(F.col("_same") > 1, "duplicate_range"))
    return full.select("source_id", "candidate", rules.alias("rules")).where("rules <> ''")


def check_scores(scored: DataFrame, base: float = 20.0) -> DataFrame:
    """Scores that differ from their parts, and ranks that differ from the order.

    ``scored`` carries the contributions of the rule score and ``rank``.
    """
    from ..functions.times import clamp, round6
    parts = F.lit(base) + F.col("keyword_score") + F.col("pace_score") + F.col("volume_score") + F.col("qa_score") + F.col("duration_score")
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "start_ms", "end_ms", "first_pos")
    near = scored.withColumn("_n", F.row_number().over(order))
    rules = reasons(F.when(F.abs(F.col("score") - round6(clamp(parts, 0.0, 100.0))) > 2e-6, "score_parts"),
                    F.when(F.col("rank") != F.col("_n"), "rank_order"))
    return near.select("source_id", "first_pos", "last_pos", rules.alias("rules")).where("rules <> ''")


# Dimensions with their maximum score and allowed findings.
DIMENSIONS = (
    ("completeness", 40, ("clear", "needs_context", "incomplete", "uncertain")),
    ("clarity", 30, ("clear", "unclear_reference", "transcription_uncertain", "uncertain")),
    ("engagement", 20, ("question", "concrete_detail", "limited", "uncertain")),
    ("conciseness", 10, ("concise", "repetition", "filler", "uncertain")),
)


def assess(rows: DataFrame, max_quote: int = 40) -> DataFrame:
    """Validity, total and reason text of outside assessments.

    Each dimension is a struct column ``score, finding, quote``; the quote must
    occur in ``text``.
    """
    faults, total, told = [], F.lit(0), []
    for name, most, findings in DIMENSIONS:
        d = F.col(name)
        quote = d["quote"]
        good = (d["score"].between(0, most) & d["finding"].isin(list(findings)) & (F.trim(quote) != "")
                & (F.length(quote) <= max_quote) & F.col("text").contains(quote))
        faults.append(F.when(~F.coalesce(good, F.lit(False)), name))
        total = total + d["score"]
        told.append(F.format_string(name + " %d/" + str(most) + ": %s", d["score"], d["finding"]))
    rows = rows.withColumn("faults", reasons(*faults))
    valid = F.col("faults") == ""
    return rows.withColumn("total", F.when(valid, total.cast("bigint"))).withColumn("reason", F.when(valid, F.array_join(F.array(*told), "; ")))


def check_citations(reviews: DataFrame, excerpts: DataFrame, options: DataFrame) -> DataFrame:
    """Citation faults of paired reviews: known, unique, one to four, at least one inside the option.

    ``reviews`` has ``option, refs``; ``excerpts`` has ``excerpt, at``; ``options``
    has ``option, first_at, last_at``.
    """
    used = reviews.select("source_id", "option", F.explode("refs").alias("excerpt")).join(
        excerpts, ["source_id", "excerpt"], "left").join(options, ["source_id", "option"])
    per = used.groupBy("source_id", "option").agg(
        F.count_if(F.col("at").isNull()).alias("_unknown"), F.count_if(F.col("at").between(F.col("first_at"), F.col("last_at"))).alias("_inside"))
    n = F.size("refs")
    return reviews.join(per, ["source_id", "option"], "left").select(
        "source_id", "option", reasons(F.when(~n.between(1, 4), "count"), F.when(n != F.size(F.array_distinct("refs")), "repeated"),
                                       F.when(F.col("_unknown") > 0, "unknown"), F.when(F.coalesce("_inside", F.lit(0)) == 0, "outside_option")).alias("faults"))


def resolve_quotes(reviews: DataFrame, options: DataFrame) -> DataFrame:
    """The one option that opens and ends with the quoted words, or why there is none.

    ``reviews`` has ``group, opening, ending``; ``options`` has ``group, option, text``.
    """
    hits = (reviews.join(options, ["source_id", "group"])
            .where(F.col("text").startswith(F.col("opening")) & F.col("text").endswith(F.col("ending")))
            .groupBy("source_id", "group").agg(F.count(F.lit(1)).alias("_n"), F.min("option").alias("option")))
    full = reviews.join(hits, ["source_id", "group"], "left")
    return full.select("source_id", "group", F.when(F.col("_n") == 1, F.col("option")).alias("option"),
                       F.when(F.col("_n").isNull(), "no_range").when(F.col("_n") > 1, "ambiguous_range").alias("fault"))


def check_import(offers: DataFrame, held: DataFrame) -> DataFrame:
    """Accept an offer only if its evidence hash is the held one and all answers are yes."""
    full = offers.join(held, "item", "left")
    reason = (F.when(F.col("held_hash").isNull(), "unknown_item").when(F.col("hash") != F.col("held_hash"), "evidence_changed")
              .when(~F.forall("answers", lambda a: a == "yes"), "not_all_yes"))
    return full.select("item", reason.alias("reason"), reason.isNull().alias("accepted"))


def check_cohort(original: DataFrame, adjusted: DataFrame, *, min_ms: int = 15_000, max_ms: int = 90_000) -> DataFrame:
    """Adjusted ranges must keep the exact cohort, within the limits and without an old score."""
    a = original.select("source_id", "candidate", F.lit(True).alias("_o"))
    full = a.join(adjusted.withColumn("_a", F.lit(True)), ["source_id", "candidate"], "full_outer")
    size = F.col("end_ms") - F.col("start_ms")
    rules = reasons(F.when(F.col("_a").isNull(), "missing"), F.when(F.col("_o").isNull(), "added"),
                    F.when(~size.between(min_ms, max_ms), "duration"), F.when(F.col("score").isNotNull(), "reused_score"))
    return full.select("source_id", "candidate", rules.alias("rules")).where("rules <> ''")


def duration_policy(sources: DataFrame, limit_ms: int) -> DataFrame:
    """Sources with the code that rejects them; null for accepted ones."""
    d = F.col("duration_ms")
    return sources.withColumn("code", F.when(d.isNull() | F.isnan(d.cast("double")) | (d <= 0), "SOURCE_DURATION_UNKNOWN")
                              .when(d > limit_ms, "SOURCE_DURATION_LIMIT"))


def over_limit(rows: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Groups above a fixed ceiling, as rejects: a ceiling never truncates."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
