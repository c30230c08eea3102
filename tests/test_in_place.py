"""Words of a document are read where they lie, in passes whose cost grows with the words."""

import re

import pytest

import __spark_entry__ as entry
from spanloom.operators import scan as sc
from test_placement import exchanges, only_by_source

SF = entry.SMOKE_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["zero_length_words", "safe_frames", "reviewed_extension", "guarded_topic_segments", "top_windows"])
def test_no_frame_is_built_anew_for_every_row(spark, name):
    assert not re.search(r"rowframe, (?!unboundedpreceding)[^,]*, unboundedfollowing", plan(entry.queries()[name](spark, SF)).lower())


@pytest.mark.parametrize("block", [None, 4])
def test_backward_values_equal_a_look_at_every_later_row(spark, block):
    from pyspark.sql import functions as F
    line = [(k, p, (p * 7 + k) % 11 if (p + k) % 3 else None) for k in range(3) for p in range(20)]
    df = spark.createDataFrame(line, "k long, p long, v long")
    found = sc.scan(df, ["k"], ["p"], sc.by_rows("p", block), least=sc.min_after(F.col("v")), here=sc.min_after(F.col("v"), inclusive=True),
                    nxt=sc.upcoming(F.col("v"), inclusive=False), own=sc.upcoming(F.col("v"))).collect()
    assert len(found) == len(line)
    for r in found:
        later = [v for k, p, v in line if k == r.k and p > r.p and v is not None]
        whole = [v for k, p, v in line if k == r.k and p >= r.p and v is not None]
        assert (r.least, r.nxt) == (min(later, default=None), later[0] if later else None)
        assert (r.here, r.own) == (min(whole, default=None), whole[0] if whole else None)


@pytest.mark.parametrize("name", ["safe_frames", "reviewed_extension", "integer_runs", "elementary_blocks", "compiled_spans", "excerpts"])
def test_words_are_dealt_by_source_only(spark, name):
    found = [line for line in exchanges(entry.queries()[name](spark, SF)) if "BroadcastExchange" not in line]
    assert only_by_source(found) or name == "reviewed_extension" and not any("pos#" in line or "first_word#" in line for line in found), found


def test_bounded_excerpts_and_spans_equal_the_dealt_ones(spark):
    from pyspark.sql import functions as F
    from spanloom.operators import spans as sp
    sizes = {1: 60, 2: 7, 3: 1}
    words = spark.createDataFrame([(k, p, "x" * (1 + (p * 37 + k) % 50 if p % 9 else 90), p * 10, p * 10 + 7) for k, n in sizes.items() for p in range(1, n + 1)],
                                  "source_id long, pos long, text string, start_ms long, end_ms long").repartition(4, "source_id")
    blocks = spark.createDataFrame([(1, 1, 1, 20), (1, 2, 21, 21), (1, 3, 22, 60), (2, 1, 1, 7), (3, 1, 1, 1)], "source_id long, block long, first_word long, last_word long")
    spread = blocks.select("source_id", "block", F.explode(F.sequence("first_word", "last_word")).alias("pos")).join(words, ["source_id", "pos"])
    far, near = sp.excerpts(spread), sp.bounded_excerpts(blocks, words)
    assert sorted(near.collect()) == sorted(far.select(near.columns).collect()) != []
    spans = blocks.withColumnRenamed("block", "span").unionByName(spark.createDataFrame([(1, 9, 5, 40), (2, 9, 8, 9)], "source_id long, span long, first_word long, last_word long"))
    far, near = sp.compile_spans(spans, words, words.groupBy("source_id").agg(F.max("pos").alias("n_words")))[0], sp.compile_bounded_spans(spans, words)
    assert sorted(near.collect()) == sorted(far.select(near.columns).collect()) != []


@pytest.mark.parametrize("ms", [0, 9, 3_599_999, 3_600_000, 35_999_990, 36_000_000, 359_999_999, 360_000_000, 400_000_001])
def test_clocks_and_codes(spark, ms):
    from pyspark.sql import functions as F
    from spanloom.functions import times as tm
    t = F.lit(ms).cast("bigint")
    found = spark.range(1).select(tm.clock(t, 1000), tm.clock(tm.div(t, 10), 100), tm.timecode(tm.frame_floor(t))).first()
    s, f = ms // 1000, ms * 30 // 1000
    assert found[0] == "%02d:%02d:%02d,%03d" % (s // 3600, s // 60 % 60, s % 60, ms % 1000)
    assert found[1] == "%d:%02d:%02d.%02d" % (s // 3600, s // 60 % 60, s % 60, ms // 10 % 100)
    assert found[2] == "%02d:%02d:%02d:%02d" % (f // 108000, f // 1800 % 60, f // 30 % 60, f % 30)
    assert [r[0] for r in spark.createDataFrame([(found[2],), ("01:00:60:00",), ("1:00:00:00",), ("01:00:00:30",)], "c string").select(tm.timecode_frame(F.col("c"))).collect()] == [f, None, None, None]


def test_a_frame_code_is_not_formatted_by_a_format_string(spark):
    assert "format_string" not in plan(entry.queries()["frame_times"](spark, SF))


def test_bounded_ownership_equals_the_dealt_one(spark):
    from spanloom.operators import quality as ql
    found = [line for line in exchanges(entry.queries()["ownership_violations"](spark, SF)) if "BroadcastExchange" not in line]
    assert only_by_source(found), found
    words = spark.createDataFrame([(k, p, p * 10, p * 10 + 7) for k in (1, 2) for p in range(1, 21)], "source_id long, pos long, start_ms long, end_ms long").repartition(4, "source_id")
    s = spark.createDataFrame([(1, 1, 10, 57, [1, 2, 3, 4, 5]), (1, 2, 60, 107, [5, 6, 7, 8, 9, 10]), (1, 3, 110, 208, list(range(11, 21))), (2, 1, 10, 27, [0, 1, 2, 30]), (2, 2, 1, 2, [40]), (2, 3, 0, 9, [])],
                              "source_id long, pos long, start_ms long, end_ms long, word_ids array<long>").repartition(4, "source_id")
    assert sorted(ql.check_bounded_ownership(s, words).collect()) == sorted(ql.check_ownership(s, words).collect()) != []


def test_bounded_copies_equal_the_joined_ones_and_fold_once(spark):
    from pyspark.sql import functions as F
    from spanloom.functions import text as tx
    from spanloom.operators import topics as tp
    from spanloom.plans import tables as tb
    s = tb.sentences(spark, SF)
    near, far = (tp.copies(s, "pos", F.col("pos"), tx.LATIN, bounded=b).select("source_id", "pos", "text", "copy_of", "copies") for b in (True, False))
    assert sorted(near.collect()) == sorted(far.collect()) != []
    assert plan(near).lower().count("sortmergejoin") == plan(near).lower().count("hashjoin") == 0


def test_bounded_backfill_equals_the_dealt_one_and_deals_no_word(spark):
    from spanloom.operators import gaps as gp
    base = spark.createDataFrame([(k, p, p * 5_000 + k, p * 5_000 + 900) for k in (1, 2) for p in range(1, 30)], "source_id long, pos long, start_ms long, end_ms long").repartition(4, "source_id")
    late = spark.createDataFrame([(k, i, i * 1_300, i * 1_300 + d) for k in (1, 2, 3) for i, d in enumerate([700, 1_500, 90, 6_000, 0, -50] * 15)], "source_id long, late_id long, start_ms long, end_ms long").repartition(4, "source_id")
    gaps = gp.word_gaps(base, spark.createDataFrame([(1, 160_000), (2, 160_000), (3, 20_000)], "source_id long, duration_ms long"), block=None)
    near, far = gp.gap_backfill(base, late, gaps, bounded=True), gp.gap_backfill(base, late, gaps)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.select(near.columns).collect())) != []
    found = exchanges(entry.queries()["backfilled_words"](spark, SF))
    assert only_by_source([line for line in found if "BroadcastExchange" not in line]), found
