import re

import numpy as np

from spanloom.llm import toxicity

from .conftest import ODD_TEXTS


def corpus(n):
    rng = np.random.default_rng(7)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(plain, 30))
        if toxic:
            words[3:3] = rng.choice(["Vilest", "GRUBBIER", "grubby"], 3)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_features_equal_brute_force():
    text = "The Émile's idiotic, 12 über—x\nabcdef"
    doc, bucket = toxicity.features([text, "", "the"])
    words = re.findall(r"[^\W\d_]+", text.lower())
    assert (doc == 0).sum() == len(words) + sum(len(w) > k for w in words for k in toxicity.PREFIXES)
    assert (doc == 2).sum() == 1 and bucket[doc == 2][0] in bucket[doc == 0]


def test_chain_catches_toxic_texts_and_leaves_clean_ones(spark, docs):
    rows, labels = corpus(400)
    table = docs(rows + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, None), (3, rows[3][1])])
    chain = toxicity.fit(table, spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int"))
    assert chain.names == ("explicit", "dense", "toxic") and [len(w) - len(chain.columns) for w in chain.weights] == [1, 2, 3]
    got = toxicity.score(table, chain).collect()
    assert len(got) == len(rows) + len(ODD_TEXTS) + 2
    for r in got:
        assert all(0 <= r[f"p_{n}"] <= 1 for n in chain.names)
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["predicted"] == (r["doc_id"] % 4 == 0)
        else:
            assert r["predicted"] == 0


def test_out_of_fold_scores_are_not_those_of_the_final_model():
    rng = np.random.default_rng(1)
    rows = toxicity.Rows(np.repeat(np.arange(40), 5), rng.integers(0, 100, 200), 40)
    y, extra = rng.integers(0, 2, 40).astype(float), np.zeros((40, 0))
    w = toxicity.fit_linear(rows, extra, y, 100, l2=1e-4)
    seen = toxicity.predict(w, rows, extra, 100)
    out = np.zeros(40)
    for k in range(5):
        inside, outside = np.flatnonzero(np.arange(40) % 5 != k), np.flatnonzero(np.arange(40) % 5 == k)
        out[outside] = toxicity.predict(toxicity.fit_linear(rows.take(inside), extra[inside], y[inside], 100, l2=1e-4), rows.take(outside), extra[outside], 100)
    assert np.abs(seen - y).mean() < np.abs(out - y).mean() - 0.2


def test_labels_of_one_kind_and_empty_tables(spark, docs):
    rows, labels = corpus(40)
    one = toxicity.fit(docs(rows), spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], "doc_id long, quality int, toxic int"))
    assert all(r["predicted"] == 0 for r in toxicity.score(docs(rows), one).collect())
    none = toxicity.fit(docs([]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r["predicted"] == 0 for r in toxicity.score(docs(rows), none).collect())
    assert toxicity.score(docs([]), none).count() == 0
