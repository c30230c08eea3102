"""Topics of documents are cut in one walk over a document's units."""

import random

import pytest

import __spark_entry__ as entry
from spanloom.functions import text as tx
from spanloom.operators import discourse as dc, topic_walk as tw, topics as tp
from test_placement import exchanges, only_by_source


def units(spark):
    r, rows = random.Random(11), []
    vocabulary = ["alpha", "beta", "gamma", "delta", "我们目前", "7", "eta"]
    for source in range(1, 13):
        at = 0
        for pos in range(1, r.choice([2, 4, 60])):
            text = " ".join(r.choices(vocabulary, k=r.randint(0, 4))) + r.choice([".", "", "?", ":", ", the"])
            rows.append((source, pos, text, at, at + 900))
            at += 900 + r.choice([0, 100, 450, 450, 3600 if r.random() < 0.4 else 20])
    return spark.createDataFrame(rows, "source_id bigint, pos bigint, text string, start_ms bigint, end_ms bigint")


def found(df, *names):
    return sorted(map(str, df.select(*names).collect()))


@pytest.mark.parametrize("guarded", [False, True])
def test_walked_topics_equal_those_of_dealt_terms(spark, guarded):
    u = units(spark).localCheckpoint()
    b = tp.boundary_similarity(u, tx.LATIN)
    names = ("source_id", "after_unit", "gap_ms", "hard", "similarity")
    assert found(tw.boundary_similarity(u, tx.LATIN), *names) == found(b, *names) != []
    cuts, linked = tp.topic_cuts(b, guarded=guarded), None
    if guarded:
        cuts, linked = tp.drop_crossed(cuts, dc.dependencies(u).where("last_unit IS NOT NULL")), "linked"
    named = dc.linked_units(u)
    names = ("source_id", "after_unit", "similarity", "left_peak", "right_peak", "depth", "reason")
    walked = found(tw.topic_cuts(named, tx.LATIN, guarded=guarded, linked=linked), *names)
    assert walked == found(cuts, *names) != []
    assert not guarded or "event_dependency_crosses_cut" in str(walked)
    spans = tp.judged_segments(tw.topic_spans(named, tx.LATIN, guarded=guarded, linked=linked))
    assert found(spans, *spans.columns) == found(tp.topic_segments(cuts, b, u), *spans.columns) != []


@pytest.mark.parametrize("name", ["topic_similarity", "topic_cuts", "topic_segments"])
def test_topics_deal_the_texts_once(spark, name):
    plan = exchanges(entry.queries()[name](spark, entry.SMOKE_DIR))
    assert len(plan) == 1 and only_by_source(plan), plan


def test_guarded_topics_read_the_sentences_once(spark):
    plan = entry.queries()["guarded_topic_segments"](spark, entry.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 2, plan


def test_sentences_are_read_once_for_the_gaps_that_touch_them(spark):
    from spanloom.operators import gaps as gp
    s = spark.createDataFrame([(k, i, 100 * i, 100 * i + 60) for k in (1, 2, 3) for i in range(9)], "source_id long, pos long, start_ms long, end_ms long")
    g = spark.createDataFrame([(1, 60, 100), (1, 161, 199), (2, 361, 1000), (2, 900, 50)], "source_id long, gap_start long, gap_end long")
    names = ("source_id", "pos", "start_ms", "end_ms", "touched")
    assert found(gp.touched_by(s, g, ["pos"], bounded=True), *names) == found(gp.touched_by(s, g, ["pos"]), *names)
    plan = exchanges(entry.queries()["blocking_gaps"](spark, entry.SMOKE_DIR))
    assert not any("pos#" in line for line in plan), plan
