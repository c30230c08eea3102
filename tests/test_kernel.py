import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import greedy, islands, range_join, scan as sc


def rows(seed, n=300, keys=3, span=2000):
    r = random.Random(seed)
    return [(r.randrange(keys), i, r.randrange(span), r.randrange(1, 90), r.random()) for i in range(n)]


def test_scan_equals_plain_windows(spark):
    df = spark.createDataFrame([(k, i, s, d if d % 3 else None) for k, i, s, d, _ in rows(1)], "k long, i long, s long, v long")
    ops = dict(total=sc.running_sum(F.col("v")), top=sc.max_before(F.col("v")), low=sc.min_after(F.col("v")), prev=sc.previous(F.col("v")),
               nxt=sc.following(F.col("v")), last=sc.latest(F.col("v")), first=sc.upcoming(F.col("v"), inclusive=False))
    blocked = sc.scan(df, ["k"], ["i"], sc.by_rows("i", 7), **ops)
    plain = sc.scan(df, ["k"], ["i"], None, **ops)
    assert sorted(blocked.collect(), key=str) == sorted(plain.collect(), key=str)


def test_scan_windows_are_spread_over_blocks(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    plan = sc.scan(df, ["k"], ["id"], sc.by_rows("id", 10), n=sc.running_sum(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan


def sequential(items, conflict):
    kept, out = [], {}
    for it in sorted(items, key=lambda x: (-x[4], x[1])):
        hit = next((k for k in kept if conflict(it, k)), None)
        if hit is None:
            kept.append(it)
        out[it[1]] = (hit is None, hit and hit[1])
    return out


def share(a, b):
    common = max(0, min(a[2] + a[3], b[2] + b[3]) - max(a[2], b[2]))
    return common / (max(a[2] + a[3], b[2] + b[3]) - min(a[2], b[2]))


@pytest.mark.parametrize("mode,conflict", [
    ({"iou_limit": 0.5}, lambda a, b: share(a, b) >= 0.5),
    ({"spacing": 25}, lambda a, b: abs(a[2] - b[2]) < 25),
    ({"overlap": True}, lambda a, b: a[2] <= b[2] + b[3] and b[2] <= a[2] + a[3]),
])
def test_greedy_line_is_the_sequential_rule(spark, mode, conflict):
    data = rows(5, 400, 2, 3000) + [(0, 1000 + i, 77, 50, 0.5) for i in range(20)]
    df = spark.createDataFrame(data, "source_id long, id long, start_ms long, d long, score double").withColumn("end_ms", F.col("start_ms") + F.col("d"))
    # Short stretches force several rounds.
    got = greedy.greedy_line(df, ["source_id"], [-F.col("score"), F.col("id")], "id", stretch=200, **mode).collect()
    want = {}
    for k in (0, 1):
        want |= sequential([x for x in data if x[0] == k], conflict)
    assert {g["id"]: (g["retained"], g["suppressed_by"]) for g in got} == want


def test_greedy_line_with_lengths_from_one_to_ten_days(spark):
    r = random.Random(7)
    data = [(0, i, r.randrange(100_000), 2 ** r.randrange(0, 17) + r.randrange(3), r.random()) for i in range(500)]
    data += [(0, 900 + i, r.randrange(50_000), 864_000_000 + r.randrange(9), r.random()) for i in range(6)] + [(0, 950, 100, 0, 0.5), (0, 951, 100, 0, 0.4)]
    df = spark.createDataFrame(data, "source_id long, id long, start_ms long, d long, score double").withColumn("end_ms", F.col("start_ms") + F.col("d"))
    for limit in (0.5, 0.3):
        got = greedy.greedy_line(df, ["source_id"], [-F.col("score"), F.col("id")], "id", iou_limit=limit).collect()
        want = sequential(data, lambda a, b: max(a[3], b[3]) > 0 and share(a, b) >= limit)
        assert {g["id"]: (g["retained"], g["suppressed_by"]) for g in got} == want


def test_greedy_edges_is_the_sequential_rule(spark):
    data = rows(9, 120, 2, 800)
    df = spark.createDataFrame(data, "source_id long, id long, start_ms long, d long, score double")
    touch = lambda a, b: a[2] < b[2] + b[3] and b[2] < a[2] + a[3]
    pairs = [(a[0], a[1], b[1]) for a in data for b in data if a[1] < b[1] and a[0] == b[0] and touch(a, b)]
    edges = spark.createDataFrame(pairs, "source_id long, left long, right long")
    got = greedy.greedy_edges(df, edges, ["source_id"], "id", [-F.col("score"), F.col("id")]).collect()
    want = {}
    for k in (0, 1):
        want |= sequential([x for x in data if x[0] == k], touch)
    assert {g["id"]: (g["retained"], g["suppressed_by"]) for g in got} == want


def test_overlap_join_pairs_once_without_nested_loop(spark):
    a = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d, _ in rows(2)], "source_id long, a long, s1 long, e1 long")
    b = spark.createDataFrame([(k, i, s, s + d) for k, i, s, d, _ in rows(3)], "source_id long, b long, s2 long, e2 long")
    j = range_join.overlap_join(a, b, ["source_id"], ("s1", "e1"), ("s2", "e2"), bin_ms=16)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r["a"], r["b"]) for r in j.collect())
    want = sorted((x["a"], y["b"]) for x in a.collect() for y in b.collect()
                  if x["source_id"] == y["source_id"] and x["s1"] < y["e2"] and x["e1"] > y["s2"])
    assert got == want


def test_union_touching_and_strict(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 25, 30), (1, 40, 40)], "source_id long, start_ms long, end_ms long")
    got = islands.interval_union(df).orderBy("start_ms").collect()
    assert [(r["start_ms"], r["end_ms"], r["n"]) for r in got] == [(0, 20, 2), (25, 30, 1)]
    units = islands.overlap_units(df.where("start_ms < end_ms").withColumn("pos", F.col("start_ms")).withColumn("text", F.lit("x")))
    assert units.count() == 3
