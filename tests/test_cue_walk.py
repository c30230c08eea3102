"""Cues are found on plain lists, word by word, as the rule over whole ranges says."""

import random

import numpy as np

import __spark_entry__ as entry
from spanloom.functions import times as tm
from spanloom.operators import editing as ed
from pyspark.sql import functions as F


def starts_by_ranges(r, policy, fps):
    """From each start, the first word past a limit, then the first free word from there on."""
    width, n = np.concatenate([[0], np.cumsum(r["columns"])]), len(r["tl_in"])
    free = [i for i in range(n) if i == 0 or r["tl_in"][i] >= r["tl_out"][:i].max()]
    starts = [0]
    while True:
        a = starts[-1]
        over = [i for i in range(a, n) if r["tl_out"][a:i + 1].max() - r["tl_in"][a] > policy.max_cue_ms * fps / 1000
                or width[i + 1] - width[a] > 2 * policy.line_chars * policy.lines]
        later = [i for i in free if over and i >= max(over[0], a + 1)]
        if not later:
            return starts
        starts.append(later[0])


def test_fullest_cues_equal_the_rule_over_ranges():
    rng = random.Random(8)
    policy, many = ed.CuePolicy(), 0
    for _ in range(300):
        n, at, rows = rng.randint(1, 40), 0, []
        for i in range(n):
            long = rng.choice([5, 20, 60, 200])
            rows.append((at, at + long, rng.choice([0, 3, 9, 40, 90])))
            at += rng.choice([0, long, long, long + 3, long // 2])
        first, last, columns = (np.array(x) for x in zip(*rows))
        zero = np.zeros(n, np.int64)
        r = {"text": np.array(["x"] * n, dtype=object), "sentence": zero, "s_ticks": zero, "e_ticks": zero, "tl_in": first, "tl_out": last,
             "columns": columns, "overlaps": zero.astype(bool), "piece": zero}
        got = ed._Clip(r, policy, 30).fill(0, n)
        assert got == starts_by_ranges(r, policy, 30)
        many += len(got) > 3
    assert many > 30


def test_a_piece_inside_a_clip_is_cut_like_the_piece_alone():
    r = {"text": np.array(list("abcdef"), dtype=object), "sentence": np.array([1, 1, 1, 2, 2, 2]), "piece": np.array([1, 1, 1, 4, 4, 4]),
         **{n: np.arange(6) * 90 + d for n, d in (("tl_in", 0), ("s_ticks", 0), ("tl_out", 80), ("e_ticks", 80))},
         "columns": np.ones(6, np.int64), "overlaps": np.zeros(6, bool)}
    whole, alone = ed._Clip(r, ed.CuePolicy(), 30), ed._Clip({n: v[3:] for n, v in r.items()}, ed.CuePolicy(), 30)
    assert whole.pieces() == [(0, 3), (3, 6)]
    assert [(a - 3, b - 3, f) for a, b, f in whole.cues(3, 6)] == alone.cues(0, 3)


def test_names_of_lines_need_no_format_string(spark):
    plan = entry.queries()["ass_lines"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan
    got = spark.createDataFrame([(v,) for v in (0, 7, 999, 1000, 12345)], "v long").select(
        tm.digits(F.col("v"), 4).alias("a"), F.format_string("%04d", "v").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
