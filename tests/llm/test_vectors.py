"""Hard negatives and nearest neighbours against plain loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import hard_negatives, nearest

SCHEMA = "vec_id long, label int, embedding array<float>, id string, vector string, shard string, block string, key string, score string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA.replace("<float>", f"<{kind}>")).repartition(5)


def single(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def good(rows, label):
    return [r for r in rows if r[0] is not None and (r[1] is not None or not label) and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]


def mined(rows, step, positives=5, negatives=10):
    rows = [(i, l, tuple(math.floor(single(x) * 256) for x in v)) for i, l, v in good(rows, True)]
    out = []
    for a, label, v in sorted({r for r in rows if r[0] % step == 0}):
        pairs = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in pairs if x[2] == label][:positives]:
            fit = [x for x in pairs if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def rows_of(rng, n, size=6, kinds=40):
    vectors = [[single(rng.gauss(0, 0.4)) for _ in range(size)] for _ in range(kinds)]
    return [(i, rng.randrange(4), rng.choice(vectors) if rng.random() < 0.5 else [single(rng.gauss(0, 0.4)) for _ in range(size)]) for i in range(n)]


ODD = [(None, 1, [0.5] * 6), (5000, None, [0.5] * 6), (5010, 1, None), (5020, 1, [0.5, None, 0.5, 0.5, 0.5, 0.5]), (5030, 1, [math.nan] * 6),
       (5040, 2, [math.inf] * 6), (5050, 2, [0.0] * 6), (5060, 1, []), (5070, 1, [0.5, 0.5]), (5080, 1, [0.25, 0.5]), (5090, 2, [0.5, 0.25]), (0, 1, [0.375] * 6), (0, 1, [0.375] * 6), (-70, 1, [0.375] * 6)]


@pytest.mark.parametrize("block_bytes", [1500, 32_000_000])
def test_hard_negatives_equal_all_pairs(spark, block_bytes):
    rng = random.Random(3)
    rows = rows_of(rng, 400) + ODD
    rows += [(7000 + i, i % 4, rows[4][2]) for i in range(60)] + rows[20:30]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 10)


def test_hard_negatives_of_large_numbers_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [single(rng.uniform(-1, 1) * 2 ** (20 if i % 3 else 40)) for _ in range(3)]) for i in range(60)]
    rows = [(i, l, v) for i, l, v in rows if max(map(abs, v)) < 2 ** 21] + [(100 + i, i % 2, [2.0 ** 25, single(1 / 3), 1.0]) for i in range(6)]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 5)


def test_empty_tables(spark):
    empty = table(spark, [(1, 1, [0.5])]).where("vec_id > 1")
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert nearest.search(nearest.index(empty), empty, F.col("vec_id") % 10 == 0).count() == 0
    one = table(spark, [(20, 1, [0.5])])
    assert hard_negatives.mine(one, F.col("vec_id") % 10 == 0).count() == 0
    assert nearest.search(nearest.index(one), one, F.col("vec_id") % 10 == 0).count() == 0


def neighbours(rows, step, k):
    rows = list({(i, tuple(v)) for i, _, v in good(rows, False) if any(v)})
    out = {}
    for q, v in rows:
        if q % step:
            continue
        for i, w in rows:
            if i != q and len(w) == len(v):
                s = 0.0
                for x, y in zip(v, w):
                    s += x * y
                best = out.setdefault(q, {})
                best[i] = max(best.get(i, -math.inf), s)
    return {q: [(n + 1, i, s) for n, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k])] for q, best in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], -r["score"]))
    return out


def test_few_rows_give_all_candidates_exactly(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 50) + ODD + [(9000 + i, 0, [single(0.4)] * 6) for i in range(300)]
    got = nearest.search(nearest.index(table(spark, rows)), table(spark, rows), F.col("vec_id") % 10 == 0)
    assert found(got) == neighbours(rows, 10, 20)
    some = rows[:12] + ODD
    assert found(nearest.search(nearest.index(table(spark, some)), table(spark, some), F.col("vec_id") % 5 == 0, block_bytes=200)) == neighbours(some, 5, 20)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_over_shards_with_groups_of_near_copies(spark, kind):
    rng = random.Random(6)
    middle = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(30)]
    vector = lambda c, spread: [single(x + rng.gauss(0, spread)) for x in middle[c]]
    rows = [(i, 0, vector(rng.randrange(30), 0.8)) for i in range(2500)] + [(3000 + i, 0, vector(3, 0.001)) for i in range(700)] + [(4000 + i, 0, [single(x) for x in middle[4]]) for i in range(300)]
    df = table(spark, rows, kind)
    got, want = found(nearest.search(nearest.index(df, least=500, shards=4), df, F.col("vec_id") % 20 == 0)), neighbours(rows, 20, 20)
    assert set(got) == set(want) and all([r for r, *_ in g] == list(range(1, 21)) for g in got.values())
    scores = {q: {i: s for _, i, s in neighbours_of} for q, neighbours_of in want.items()}
    assert all(scores[q].get(i, s) == s for q, g in got.items() for _, i, s in g)
    hit = [len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 20 for q in want]
    assert sum(hit) / len(hit) >= 0.95
