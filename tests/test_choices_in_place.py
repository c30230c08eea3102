"""Edges near a candidate are met where the units of its document lie."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.operators import choices as ch
from test_placement import exchanges, only_by_source


def tables(spark):
    r, units, candidates = random.Random(3), [], []
    for source in range(1, 6):
        at, pauses = 0, 0
        for pos in range(1, 120):
            size = r.choice([900, 1500, 2500, 2533])
            units.append((source, pos, at, at + size, pauses, r.randint(0, 3), r.randint(0, 3)))
            gap = r.choice([0, 0, 20, 200, 3500 if r.random() < 0.1 else 0])
            at, pauses = at + size + gap, pauses + (gap > 3000)
        mine = [u for u in units if u[0] == source]
        for n in range(40):
            a = r.randrange(0, 90)
            candidates.append((source, 100 * n + a, mine[a][2] + r.choice([0, 7]), mine[a + r.randint(5, 25)][3]))
    candidates.append((9, 1, 0, 20_000))
    return (spark.createDataFrame(candidates, "source_id long, candidate long, start_ms long, end_ms long"),
            spark.createDataFrame(units, "source_id long, pos long, start_ms long, end_ms long, pauses long, start_hint int, end_hint int"))


def found(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_choices_in_place_equal_the_dealt_ones(spark):
    c, u = tables(spark)
    assert found(ch.bounded_choice_list(c, u)) == found(ch.choice_list(c, u)) != []
    options = ch.repair_options(c, u).groupBy("source_id", "candidate").agg(
        F.count("*").alias("options"), F.min("start_frame").alias("first_frame"), F.max("end_frame").alias("last_frame"))
    assert found(ch.bounded_repair_counts(c, u)) == found(options) != []


@pytest.mark.parametrize("name", ["choice_list", "repair_options"])
def test_edges_are_not_dealt_by_time_or_candidate(spark, name):
    plan = exchanges(entry.queries()[name](spark, entry.SMOKE_DIR))
    assert only_by_source(plan), plan
