"""Rows made of one input row stay where its text was dealt to."""

import re

import pytest

import __spark_entry__ as entry
from spanloom.functions import text as tx
from spanloom.operators import range_join, topics as tp
from spanloom.plans import tables as tb
from test_kernel import rows

SF = entry.SMOKE_DIR


def exchanges(df) -> list[str]:
    """Exchanges of the plan that move rows, without those that are read again."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if re.search(r"(?<!Reused)Exchange ", line)]


@pytest.mark.parametrize("closed", [False, True])
def test_bounded_overlap_join_equals_the_dealt_one(spark, closed):
    a = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d, _ in rows(2)], "source_id long, a long, s1 long, e1 long")
    b = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d, _ in rows(3)], "source_id long, b long, s2 long, e2 long")
    pairs = lambda bounded: sorted(map(tuple, range_join.overlap_join(
        a, b, ["source_id"], ("s1", "e1"), ("s2", "e2"), bin_ms=16, closed=closed, bounded=bounded).select("source_id", "a", "b", "s1", "e2").collect()))
    assert pairs(True) == pairs(False) != []


@pytest.mark.parametrize("name", ["cue_words", "subtitle_cues", "ass_lines"])
def test_words_of_cues_are_not_dealt_again(spark, name):
    found = exchanges(entry.queries()[name](spark, SF))
    assert found and all(re.search(r"hashpartitioning\(source_id#\d+L?, \d+\)", line) for line in found), found


def test_terms_of_bounded_units_are_not_dealt_and_give_the_same_sums(spark):
    units = tb.sentences(spark, SF)
    near, dealt = tp.boundary_similarity(units, tx.LATIN, block=None), tp.boundary_similarity(units, tx.LATIN)
    assert len(exchanges(near)) == 2
    columns = sorted(dealt.columns)
    rows_of = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows_of(near) == rows_of(dealt) != []


def test_words_are_not_dealt_to_the_starts_of_rule_sentences(spark):
    found = exchanges(entry.queries()["rule_sentences"](spark, SF))
    assert found and not any("pos#" in line for line in found), found


def only_by_source(found: list[str]) -> bool:
    return bool(found) and all(re.search(r"hashpartitioning\(source_id#\d+L?, \d+\)", line) for line in found)


def test_levels_of_bounded_sentences_are_not_dealt_and_give_the_same_scores(spark):
    from spanloom.operators import evaluation as ev, windows as wn
    plain, frames = tb.plain_features(spark, SF), tb.level_frames(tb.words(spark, SF))
    near = wn.score_rule(tb.features(spark, SF), bounded=True)
    far = wn.score_rule(wn.loudness(plain, frames, ev.baseline_level(frames), frame_ms=tb.FRAME_MS), bounded=True)
    assert only_by_source(exchanges(near)), exchanges(near)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.select(near.columns).collect())) != []


def test_bounded_suppression_equals_the_dealt_one_and_deals_nothing(spark):
    from pyspark.sql import functions as F
    from spanloom.operators import selection as sl
    window_nms = entry.queries()["window_nms"]
    from spanloom.plans import quality_queries as qq
    items = spark.createDataFrame([(k, i, s, s + d % 40, int(v * 7)) for k, i, s, d, v in rows(5)], "source_id long, item long, start_ms long, end_ms long, value long").repartition(4, "source_id")
    order = [-F.col("value"), F.col("item")]
    fate = lambda bounded: sorted(map(str, sl.temporal_nms(items, order, "item", bounded=bounded).collect()))
    assert fate(True) == fate(False) != []
    for df in (window_nms(spark, SF), qq.kept_windows(qq.every(spark, SF))):
        assert only_by_source(exchanges(df)), exchanges(df)


def test_texts_of_bounded_windows_are_joined_in_place(spark):
    from spanloom.operators import windows as wn
    found = entry.queries()["candidate_texts"](spark, SF)
    assert only_by_source(exchanges(found)), exchanges(found)
    sentences = tb.sentences(spark, SF)
    w = wn.sentence_windows(tb.plain_features(spark, SF), bounded=True).where("source_id % 7 = 0")
    dealt = wn.window_text(w, sentences).selectExpr("source_id", "first_pos * 4294967296 + last_pos AS candidate", "text")
    assert sorted(found.where("source_id % 7 = 0").collect()) == sorted(dealt.collect()) != []


def test_bounded_candidate_checks_equal_the_dealt_ones(spark):
    import random
    from spanloom.operators import quality as ql
    r = random.Random(4)
    units, at = [], {}
    for k in range(2):
        t = 0
        for p in range(1, 150):
            at[k, p] = t
            units.append((k, p, t, t + 900 + r.randrange(900)))
            t += 1_000 + r.choice([0, 500, 7_000])
    units = spark.createDataFrame(units, "source_id long, pos long, start_ms long, end_ms long").repartition(4, "source_id")
    found = []
    for i in range(200):
        k, f = r.randrange(2), r.randrange(1, 140)
        l = min(f + r.randrange(80), 149)
        refs = [p for p in range(f, l + 1) if r.random() < 0.99] + r.choice([[], [], [400], [f]])
        start, end = at[k, f] + r.choice([0, 0, 5]), at[k, l] + 900 - r.choice([0, 0, 200_000])
        found.append((k, i, start, end, r.choice([refs, refs, refs, [p for p in range(f, l + 1)], []])))
    c = spark.createDataFrame(found, "source_id long, candidate long, start_ms long, end_ms long, refs array<long>").repartition(4, "source_id")
    near, far = ql.check_bounded_candidates(c, units), ql.check_candidates(c, units)
    assert only_by_source(exchanges(near)), exchanges(near)
    assert sorted(near.collect()) == sorted(far.collect()) != []


def test_bounded_outside_scores_equal_the_joined_ones(spark):
    from spanloom.operators import choices as ch
    a = spark.createDataFrame([(i % 5, i, i * 10, i * 10 + 5, float(i % 3), i) for i in range(60)],
                              "source_id long, candidate long, start_ms long, end_ms long, score double, rank long").repartition(4, "source_id")
    b = spark.createDataFrame([(i % 5, i, None if i == 11 else i % 7) for i in range(65) if i != 7], "source_id long, candidate long, total long").repartition(4, "source_id")
    near, far = ch.apply_external(a, b, bounded=True), ch.apply_external(a, b)
    assert only_by_source(exchanges(near)), exchanges(near)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect())) != []


def test_signals_of_bounded_windows_are_read_in_place(spark):
    from spanloom.operators import selection as sl, windows as wn
    found = entry.queries()["tail_review"](spark, SF)
    assert only_by_source(exchanges(found)), exchanges(found)
    far = sl.tail_review(wn.sentence_windows(tb.plain_features(spark, SF), bounded=True), tb.sentences(spark, SF), tx.LATIN)
    assert sorted(map(str, found.collect())) == sorted(map(str, far.select(found.columns).collect())) != []
