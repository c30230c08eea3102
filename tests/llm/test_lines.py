import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from spanloom.llm import crf, labelled, quality_classifier, quality_rules
from spanloom.llm.chars import Block
from spanloom.llm.lines import Lines

from .conftest import ODD_TEXTS


def brute(s, moves):
    """Marginals and best score of one chain by trying all label sequences."""
    top, total, ones = -np.inf, 0.0, np.zeros(len(s))
    for y in itertools.product((0, 1), repeat=len(s)):
        score = sum(s[t] for t in range(len(s)) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:]))
        top, total, ones = max(top, score), total + np.exp(score), ones + np.exp(score) * np.array(y)
    return ones / total, top


def test_forward_backward_and_viterbi_equal_brute_force():
    rng = np.random.default_rng(3)
    count = np.array([3, 0, 1, 6, 2])
    x, model = rng.normal(size=(12, 2)), crf.Crf(rng.normal(size=2), 0.3, rng.normal(size=(2, 2)))
    p, y, at = model.marginals(x, count), model.decode(x, count), 0
    for n in count:
        s = model.scores(x[at:at + n])
        want, top = brute(s, model.moves)
        np.testing.assert_allclose(p[at:at + n], want, atol=1e-9)
        own = y[at:at + n]
        assert np.isclose(sum(s[own == 1]) + sum(model.moves[a, b] for a, b in zip(own, own[1:])), top)
        at += n


def test_fit_learns_that_labels_persist():
    rng = np.random.default_rng(5)
    count = np.full(60, 12)
    labels = np.concatenate([np.repeat(rng.integers(0, 2, 3), 4) for _ in count])
    x = (labels + rng.normal(scale=0.8, size=len(labels)))[:, None]
    model = crf.fit(x, count, labels)
    assert model.moves[0, 0] + model.moves[1, 1] > model.moves[0, 1] + model.moves[1, 0] + 1
    assert (model.decode(x, count) == labels).mean() > ((x[:, 0] > 0.5) == labels).mean() + 0.05


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab #|\n\n \t\xa0é"), max_size=60), max_size=5))
def test_counts_equal_brute_force(texts):
    block = Block(texts)
    got = np.array(quality_rules.counts(block, Lines(block))).T.tolist()
    for text, row in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


CLEAN = "The river ran slowly past the old mill.\nNobody had walked there for years, and the path was lost.\nBirds sang."
JUNK = "BUY!!! ### NOW!!! ***\n$$$ %%% WIN!!! | | |\n### CLICK!!! $$$ &&& HERE!!!"


def corpus(spark, docs):
    rows = [(i, f"{CLEAN} {i}." if i % 3 else f"{JUNK} {i}") for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, CLEAN), (7, CLEAN)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs(rows), labels, rows


def test_rules_keep_clean_documents_and_drop_junk(spark, docs):
    table, labels, rows = corpus(spark, docs)
    got = quality_rules.judge(table, quality_rules.line_model(table, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None or r["doc_id"] < 60:
            assert r["kept"] == (r["doc_id"] is None or r["doc_id"] % 3 > 0)
        assert not (r["base_failed"] and r["kept"])
    none = quality_rules.judge(table, quality_rules.line_model(table, labels.limit(0)))
    assert all(r["kept"] != r["base_failed"] for r in none.collect())
    assert quality_rules.judge(docs([]), None).count() == 0


def test_scores_rank_held_out_documents(spark, docs):
    table, labels, rows = corpus(spark, docs)
    model = quality_classifier.fit(table, labels)
    got = quality_classifier.score(table, model).withColumn("held_out", labelled.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 60]
    assert min(r["score"] for r in out if r["doc_id"] % 3) > max(r["score"] for r in out if r["doc_id"] % 3 == 0)
    assert quality_classifier.score(docs([]), quality_classifier.fit(docs([]), labels)).count() == 0
    marks = quality_classifier.line_marginals(docs([(1, "a\nb\n"), (2, None)]), model).collect()
    assert [(r["doc_id"], r["line"]) for r in marks] == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_sample_never_holds_held_out_rows_and_is_bounded(spark, docs):
    table, labels, _ = corpus(spark, docs)
    got = labelled.sample(table, labels, "quality", 20).withColumn("held_out", labelled.held_out()).collect()
    assert len(got) == 20 and not any(r["held_out"] for r in got)
