"""What lies around a sentence is read where its document lies, as the forms for long sources find it."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.operators import selection as sl
from spanloom.plans import selection_queries as sq, tables as tb
from test_placement import exchanges, only_by_source

SF = entry.SMOKE_DIR


@pytest.mark.parametrize("name", ["end_context", "anchor_segments"])
def test_documents_are_dealt_once_and_by_source_only(spark, name):
    found = [line for line in exchanges(entry.queries()[name](spark, SF)) if "BroadcastExchange" not in line]
    assert len(found) == 1 and only_by_source(found), found


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def test_end_context_equals_the_form_for_long_sources(spark):
    speech = tb.words(spark, SF).select("source_id", (F.col("start_ms") - 100).alias("start_ms"), (F.col("end_ms") + (F.col("pos") % 3) * 50).alias("end_ms"))
    got = rows(entry.queries()["end_context"](spark, SF))
    assert got and got == rows(sl.end_context(sq.windows(spark, SF), tb.sentences(spark, SF), speech, "candidate"))


def test_anchor_segments_equal_the_form_for_long_sources(spark):
    words = tb.words(spark, SF)
    anchors = words.where((F.col("pos") * 7 + F.col("source_id")) % 41 == 0).select("source_id", "pos")
    near = sl.anchor_spans(words, (F.col("pos") * 7 + F.col("source_id")) % 41 == 0)
    units = sq.wn.sentence_features(sq.marked_sentences(near, spans=F.collect_list("span")), sq.tx.LATIN, block_rows=None, keep=("spans",))
    limits = {"min_frames": 400, "max_frames": 2_000}
    got = rows(sl.bounded_anchor_segments(units, **limits))
    assert any("None" in r and "'reason': None" in r for r in got) and any("no_covering" in r for r in got)
    assert got == rows(sl.anchor_segments(anchors, words, sq.windows(spark, SF), block=None, **limits))


def test_a_word_is_voiced_by_ranges_that_hold_its_end(spark):
    line = [(1, 1, 0, 100), (1, 2, 150, 300), (1, 3, 300, 400), (2, 1, 0, 50)]
    w = spark.createDataFrame(line, "source_id long, pos long, start_ms long, end_ms long")
    at = lambda a, b: {(r.source_id, r.pos): r.voiced for r in sl.voiced(w, a, b).collect()}
    assert at(F.col("start_ms"), F.col("end_ms")) == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 1): False}
    assert at(F.col("start_ms") - 50, F.col("end_ms")) == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False}
    assert all(at(F.col("start_ms"), F.col("end_ms") + 1).values())
