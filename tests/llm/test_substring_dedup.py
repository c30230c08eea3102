import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from spanloom.llm import substring_dedup as sd
from spanloom.llm.suffix_automaton import SuffixAutomaton

from .conftest import ODD_TEXTS


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=5), st.text("abc", max_size=15), st.integers(1, 6))
def test_statistics_equal_brute_force(texts, query, most):
    automaton = SuffixAutomaton()
    for owner, text in enumerate(texts):
        automaton.add(text, 10 - owner)
    got = list(automaton.close().statistics(query, most))
    for end in range(len(query)):
        n = max(k for k in range(min(most, end + 1) + 1) if any(query[end + 1 - k:end + 1] in t for t in texts))
        assert got[end][0] == n
        if n:
            assert got[end][1] == min(10 - o for o, t in enumerate(texts) if query[end + 1 - n:end + 1] in t)


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for a in range(len(w) - window + 1):
            k = tuple(w[a:a + window])
            first[k] = min(first.get(k, sd.NO_ID), sd.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < (sd.NO_ID if i is None else i):
                gone.update(range(a, a + window))
        out.append((str(i), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed,busy", [(1, sd.SHARD_WORDS), (2, 1), (3, 100)])
def test_removal_equals_brute_force(docs, seed, busy):
    rng, window = random.Random(seed), 12
    passages = [[f"p{rng.randrange(40)}" for _ in range(n)] for n in (12, 20, 45)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 5)
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[a:] if rng.random() < 0.5 else p
        rows.append((i, " ".join(words)))
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(200, rows[5][1]), (200, rows[5][1]), (200, rows[9][1] + " tail"), (None, rows[7][1]), (None, "z " * 40), (None, "z " * 30)]
    rng.shuffle(rows)
    got = sd.remove_repeats(docs(rows), window, gram=4, shard_words=busy).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute(rows, window)


def test_removal_of_a_bounded_reference(docs, monkeypatch):
    ref = " ".join(f"r{i}" for i in range(30))
    table = docs([(1, f"a b {ref} c"), (2, "r1 r2 r3"), (None, None), (3, " ".join(f"r{i}" for i in range(5, 17))), (3, "own")])
    reference = docs([(1, ref), (2, None), (3, ref.replace("r1 ", "q ")), (4, "short")])
    got = sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in sd.remove_reference(table, reference, 10, shard_words=25).collect())
    assert got == [("1", 30, "a b c"), ("2", 0, "r1 r2 r3"), ("3", 0, "own"), ("3", 12, ""), ("None", 0, "")]
    monkeypatch.setattr(sd, "REFERENCE_WORDS", 20)
    with pytest.raises(ValueError):
        sd.remove_reference(table, reference, 10)


def test_short_reference_texts_with_outer_space_take_no_place(docs, monkeypatch):
    monkeypatch.setattr(sd, "REFERENCE_WORDS", 40)
    ref = " ".join(f"r{i}" for i in range(30))
    rows = [(i, f"  {' '.join(f'x{i}y{j}' for j in range(8))}  ") for i in range(40)] + [(99, ref)]
    got = sd.remove_reference(docs([(1, f"a {ref} b")]), docs(rows).coalesce(1), 10).collect()
    assert [(r["n_removed"], r["kept"]) for r in got] == [(30, "a b")]


def test_empty_table(docs):
    assert sd.remove_repeats(docs([])).count() == 0
