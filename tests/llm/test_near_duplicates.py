import random

import numpy as np
import pytest

from spanloom.llm import near_duplicates as nd
from spanloom.llm.components import components

from .conftest import ODD_TEXTS


@pytest.mark.parametrize("scale", [1.0, 40.0, 3000.0])
def test_agreement_estimates_weighted_jaccard(scale):
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    a, b = rng.gamma(1.0, scale / 60, 60), rng.gamma(1.0, scale / 60, 60)
    a[:20] = b[:20]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    size = 4000
    got = nd.signatures(np.concatenate([elements, elements]), np.concatenate([a, b]), np.array([0, 60, 120]), size)
    assert abs((got[0] == got[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / size)


def test_signatures_do_not_depend_on_the_other_sets():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (1, 7, 300, 20_000)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat = np.concatenate(sets)
    together = nd.signatures(flat, np.ones(len(flat)), at)
    for i, s in enumerate(sets):
        alone = nd.signatures(s, np.ones(len(s)), np.array([0, len(s)]))
        assert (alone[0] == together[i]).all() and (alone != 0).all()
    assert (nd.signatures(flat[:0], np.ones(0), np.array([0, 0])) == 0).all()


def test_weights_count_repeats():
    value, weight, at = nd.shingles(["a b c d e f", "x", "", "z z z z z z z"], weighted=True)
    assert at.tolist() == [0, 2, 3, 3, 4] and weight.tolist() == [1, 1, 1, 3]
    assert nd.shingles(["z z z z z z z"])[1].tolist() == [1]


def jaccard(x, y):
    def s(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    a, b = s(x), s(y)
    return (len(a & b) / len(a | b)) if a | b else float((x or "") == (y or "") and (x is None) == (y is None))


def expected(rows):
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            same = (rows[i][1] == rows[j][1]) or (rows[i][1] and rows[j][1] and jaccard(rows[i][1], rows[j][1]) >= 0.8 - 1e-9)
            if same:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(rows[i][0]), str(min(ids) if ids else None)))
    return sorted(out)


@pytest.mark.parametrize("family", [nd.FAMILY, 8])
def test_classes_equal_brute_force(docs, monkeypatch, family):
    monkeypatch.setattr(nd, "FAMILY", family)
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 4 if family == 8 else nd.BLOCK_TEXTS)
    rng = random.Random(5)
    rows, key = [], 0
    for n in (60, 150, 12):
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 12):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(n)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((key, " ".join(words)))
            key += 1
    rows += [(900, rows[0][1]), (900, rows[12][1]), (None, rows[3][1]), (None, "only null"), (901, None), (902, None), (903, ""), (904, "a b"), (905, "a  b"), (906, "b a")]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS) if t]
    got = nd.classes(docs(rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == expected(rows)


def test_empty_table(docs):
    assert nd.classes(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    rng.shuffle(edges)
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(root) and {r["node"]: r["root"] for r in got} == root


def test_one_row_stays_with_columns_of_any_name(spark):
    names = ["_id", "_want", "_hash", "_row", "_for", "root", "node", "text_hash", "class_key", "r", "a.b"]
    table = spark.createDataFrame([(i, "a b c d e f" if i < 3 else None, *names) for i in range(5)], ["doc_id", "text", *names])
    got = nd.keep_one(table)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect())) == [(0, "a b c d e f", *names), (3, None, *names)]
