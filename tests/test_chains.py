"""Chains of jumps, excerpts, digests and strategies against plain walks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import chains, digests, spans as sp, strategies as st, topics as tp, windows as wn


@pytest.mark.parametrize("block", [7, 4096])
def test_chains_equal_a_walk(spark, block):
    rng = random.Random(block)
    rows, want = [], set()
    for key in range(4):
        places = sorted(rng.sample(range(10 ** 6), 150 if key else 1))
        goes = {p: rng.choice([*places[i + 1:i + 9], None]) if rng.random() < 0.1 else (places + [None])[min(i + rng.randrange(1, 6), len(places))] for i, p in enumerate(places)}
        rows += [(key, p, g) for p, g in goes.items()]
        at = places[0]
        while at is not None:
            want.add((key, at))
            at = goes[at]
    rng.shuffle(rows)
    got = chains.on_chain(spark.createDataFrame(rows, "k long, p long, g long"), ["k"], "p", "g", block=block)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("block", [4096])
def test_excerpts_equal_the_sequential_rule(spark, block):
    rng = random.Random(block)
    rows, want, pos = [], [], 0
    for part in range(6):
        number, used, held = 0, 0, []
        for _ in range(rng.choice([1, 3, 60])):
            pos += 1
            text = "x" * rng.choice([1, 2, 5, 9, 12, 39, 40, 41, 90])
            rows.append((1, part, pos, pos * 10, pos * 10 + 7, text))
            if used and used + len(text) > 40:
                number, used = number + 1, 0
            used += len(text)
            held.append((number, pos, text))
        for n in range(number + 1):
            mine = [h for h in held if h[0] == n]
            want.append((1, part, n, mine[0][1], mine[-1][1], mine[0][1] * 10, mine[-1][1] * 10 + 7, "".join(h[2] for h in mine)))
    df = spark.createDataFrame(rows, "source_id long, block long, pos long, start_ms long, end_ms long, text string").repartition(3)
    assert sorted(map(tuple, sp.excerpts(df, block=block).collect())) == want
    assert sp.excerpts(df.where("pos < 0")).count() == 0


def test_digest_trees_do_not_depend_on_partitions_and_see_every_row(spark):
    rows = [(k, i, f"t{i}") for k in (1, 2) for i in range(1, 700)]
    make = lambda r, n: {x["k"]: x["digest"] for x in digests.tree_digest(spark.createDataFrame(r, "k long, p long, t string").repartition(n), ["k"], [F.col("p")], F.col("t"), digests.by_position("p")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = [sha("\n".join(sha(f"t{i}") for i in range(1, 700) if i // 256 == b)) for b in range(3)]
    assert make(rows, 1) == make(rows, 7) == {k: sha(sha(sha("\n".join(leaf)))) for k in (1, 2)}
    assert make(rows[:5] + [(1, 6, "other")] + rows[6:], 3)[1] != make(rows, 2)[1]


def test_strategies_are_closed_and_their_options_enter_all_ids(spark):
    for bad in ({}, {"version": "none", "options": {}}, {"version": st.WINDOWS, "options": {}}, {"version": st.WINDOWS, "options": {"min_ms": 1, "max_ms": 2, "max_gap_ms": 3}}, {"version": 3, "options": {}}):
        with pytest.raises(ValueError):
            st.strategy(bad)
    units = spark.createDataFrame([(1, i, i * 9000, i * 9000 + 8900, f"alpha{chr(97 + i % 5)} beta{chr(97 + i // 3)} gamma.") for i in range(1, 25)], "source_id long, pos long, start_ms long, end_ms long, text string")
    plain = st.default()
    other = st.strategy({"version": st.WINDOWS, "options": {"min_ms": 15_000, "max_ms": 90_000, "max_gap_ms": 3_001}})
    ids = lambda chosen, u=units: {(r["first_pos"], r["last_pos"]): r["candidate_id"] for r in st.generate(chosen, u, tx.LATIN).collect()}
    a, b, c = ids(plain), ids(other), ids(plain, units.withColumn("text", F.concat("text", F.when(F.col("pos") == 20, " x").otherwise(""))))
    assert a.keys() == b.keys() == c.keys() and not set(a.values()) & (set(b.values()) | set(c.values()))
    assert len(set(a.values())) == len(a) and all(v.startswith("c_") for v in a.values())
    for version in ("topic-valley-v1", "topic-valley-v4"):
        made = ids(st.default(version))
        assert all(v.startswith("t_") for v in made.values())


def test_severed_links_and_open_quotations_leave_their_units_unresolved(spark):
    units = spark.createDataFrame([(1, i) for i in range(10)], "source_id long, pos long")
    edges = spark.createDataFrame([(1, i, i == 4, 5000) for i in range(9)], "source_id long, after_unit long, hard boolean, gap_ms long")
    links = spark.createDataFrame([(1, 1, 2), (1, 3, 5), (1, 5, 7)], "source_id long, first_unit long, last_unit long")
    loose = spark.createDataFrame([(1, None, 0, "quotation_missing_opener"), (1, 8, None, "quotation_missing_closer"), (1, 6, None, "unresolved_demonstrative")], "source_id long, first_unit long, last_unit long, kind string")
    got = tp.unresolved_spans(links, loose, edges, units)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0), (1, 3, 5), (1, 8, 9)]


def test_loudest_frames_equal_a_scan_of_all_frames(spark):
    rng = random.Random(4)
    data, t = [], 0
    for i in range(1, 90):
        d = rng.randrange(1500, 9000)
        data.append((1, i, t, t + d, "plain words"))
        t += d + rng.choice([20, 450])
    frames = [(1, f, rng.choice([-80.0, -40.0, -30.5, -12.0])) for f in range(t // 1000 + 2) if rng.random() < 0.8]
    units = spark.createDataFrame(data, "source_id long, pos long, start_ms long, end_ms long, text string")
    levels, base = spark.createDataFrame(frames, "source_id long, frame long, rms_db double"), spark.createDataFrame([(1, -33.0)], "source_id long, baseline_db double")
    for block in (None, 16):
        f = wn.loudness(wn.sentence_features(units, tx.LATIN), levels, base, frame_ms=1000, block_frames=block)
        got = {(r["start_ms"], r["end_ms"]): r["volume_score"] for r in wn.score_rule(f).collect()}
        assert len(got) > 100
        for (a, b), score in got.items():
            peak = max((x for _, n, x in frames if a <= n * 1000 + 500 < b), default=-120.0)
            assert score == round(min(1, max(0, peak + 33.0) / 12 if peak > -60 else 0) * 15, 6)
