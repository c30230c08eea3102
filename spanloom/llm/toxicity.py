"""Toxicity by a classifier chain of linear models over hashed words.

Categories are predicted in a fixed order. Each later model also gets the earlier
categories' probabilities; while fitting, these are out-of-fold predictions, so a later
model does not learn to trust scores that an earlier one gave its own training texts.

Features are the presence of lower-cased letter runs and of their first four to six letters
(so inflected forms share features), hashed to ``BUCKETS``; those with too few labelled
texts or no lean to either side are left out. Where the labels name one category only,
``derived_categories`` adds finer ones from the labelled texts.

Null texts count as empty. Repeated rows are scored each. Where a category has labels of
one kind only, its probability is that share everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .chars import Block, map_texts

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
MIN_TEXTS = 3
MAX_FEATURES = 4000
FOLDS = 5
SAMPLE_TEXTS = 6000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, bucket)`` pairs of the words and word beginnings, with repeats."""
    block = Block(texts, lower=True)
    letter = _is_letter()[block.cp]
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = block.chars
    doc = np.searchsorted(block.doc_at, start, side="right") - 1
    docs, buckets = [doc], [sums.hash(start, end)]
    for n in PREFIXES:
        long = end - start > n
        docs.append(doc[long])
        buckets.append(sums.hash(start[long], start[long] + n) + np.uint64(n))
    return np.concatenate(docs), (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64)


_tables: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "letter" not in _tables:
        table = np.zeros(0x110000, bool)
        for c in range(0x20000):
            table[c] = chr(c).isalpha()
        _tables["letter"] = table
    return _tables["letter"]


@dataclass
class Rows:
    """Sparse 0/1 rows: feature columns of each text, laid end to end."""

    row: np.ndarray
    column: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, r[self.row], width)

    def take(self, chosen: np.ndarray) -> "Rows":
        at = np.full(self.n, -1)
        at[chosen] = np.arange(len(chosen))
        keep = at[self.row] >= 0
        return Rows(at[self.row[keep]], self.column[keep], len(chosen))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(rows: Rows, extra: np.ndarray, y: np.ndarray, width: int, rounds: int = 150, l2: float = 2e-3, rate: float = 0.1) -> np.ndarray:
    """Logistic regression (Adam): weights of the sparse columns, of ``extra``, and the offset."""
    k = extra.shape[1]
    w, m, v = np.zeros(width + k + 1), np.zeros(width + k + 1), np.zeros(width + k + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for t in range(1, rounds + 1):
        rest = y - sigmoid(rows.dot(w[:width]) + extra @ w[width:width + k] + w[-1])
        grad = np.concatenate([rows.back(rest, width), extra.T @ rest, [rest.sum()]]) / max(rows.n, 1)
        grad[:-1] -= l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def predict(w: np.ndarray, rows: Rows, extra: np.ndarray, width: int) -> np.ndarray:
    return sigmoid(rows.dot(w[:width]) + extra @ w[width:-1] + w[-1])


@dataclass
class Chain:
    """Models in order; ``columns`` are the chosen buckets, sorted."""

    names: tuple[str, ...]
    columns: np.ndarray
    weights: list[np.ndarray]
    thresholds: list[float]

    def rows(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> Rows:
        """Rows of chosen features, each present once."""
        at = np.searchsorted(self.columns, bucket)
        at[at == len(self.columns)] = 0
        hit = self.columns[at] == bucket if len(self.columns) else np.zeros(len(bucket), bool)
        pairs = np.unique(doc[hit] * max(len(self.columns), 1) + at[hit])
        return Rows(pairs // max(len(self.columns), 1), pairs % max(len(self.columns), 1), n)

    def predict(self, rows: Rows) -> np.ndarray:
        """Probability of each category, one column each."""
        out = np.zeros((rows.n, 0))
        for w in self.weights:
            out = np.column_stack([out, predict(w, rows, out, len(self.columns))])
        return out


def choose(rows: Rows, buckets: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions in ``buckets`` whose texts lean most to one side (weighted log-odds)."""
    pos = np.bincount(rows.column, y[rows.row], len(buckets))
    both = np.bincount(rows.column, minlength=len(buckets))
    neg, n1, n0 = both - pos, y.sum(), len(y) - y.sum()
    lean = np.log((pos + 0.5) / (n1 - pos + 0.5)) - np.log((neg + 0.5) / (n0 - neg + 0.5))
    z = np.abs(lean) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    z[both < MIN_TEXTS] = 0
    top = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return np.sort(top[z[top] > 1.5])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the best F1 on out-of-fold predictions."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(y.sum(), 1))
    k = int(np.argmax(f1)) if len(p) else 0
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0)) / 2) if len(p) else 0.5


def derived_categories(rows: Rows, y: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Finer categories of toxic texts by the lean of their words.

    ``explicit``: toxic texts with at least one feature that hardly any other text has;
    ``dense``: those with more of them than the median explicit text.
    """
    pos = np.bincount(rows.column, y[rows.row], width)
    telling = (pos >= MIN_TEXTS) & (pos >= 0.95 * np.bincount(rows.column, minlength=width))
    n = rows.dot(telling.astype(float)) * y
    explicit = (n > 0).astype(float)
    dense = (n > np.median(n[n > 0])).astype(float) if explicit.any() else explicit
    return {"explicit": explicit, "dense": dense}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE_TEXTS) -> Chain:
    """Chain ``explicit -> dense -> label`` from at most ``limit`` labelled texts."""
    def run(columns, texts):
        doc, bucket = features(texts)
        pairs = np.unique(doc * BUCKETS + bucket)
        cut = np.searchsorted(pairs, np.arange(len(texts) + 1) * BUCKETS)
        return columns["doc_id"], columns["_label"], [(pairs[a:b] % BUCKETS).astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]

    sample = labelled.sample(docs, labels, label, limit).select("text", "doc_id", F.col("_label").cast("long").alias("_label"))
    got = sorted(map_texts(sample, run, "doc_id long, _label long, buckets binary").collect(), key=lambda r: r["doc_id"])
    each = [np.frombuffer(r["buckets"], np.int32) for r in got]
    y = np.array([r["_label"] for r in got], float)
    flat = np.concatenate(each) if each else np.zeros(0, np.int32)
    buckets, column = np.unique(flat, return_inverse=True)
    every = Rows(np.repeat(np.arange(len(each)), [len(e) for e in each]).astype(np.int64), column.astype(np.int64), len(each))
    chosen = choose(every, buckets, y) if len(y) else np.zeros(0, np.int64)
    at = np.full(len(buckets), -1)
    at[chosen] = np.arange(len(chosen))
    keep = at[every.column] >= 0
    rows, width = Rows(every.row[keep], at[every.column[keep]], every.n), len(chosen)
    targets = {**derived_categories(rows, y, width), label: y}
    fold = np.arange(len(y)) % FOLDS
    extra, weights, thresholds = np.zeros((len(y), 0)), [], []
    for target in targets.values():
        out = np.full(len(y), target.mean() if len(y) else 0.0)
        for k in range(FOLDS):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(inside) and len(outside) and 0 < target[inside].sum() < len(inside):
                w = fit_linear(rows.take(inside), extra[inside], target[inside], width)
                out[outside] = predict(w, rows.take(outside), extra[outside], width)
        weights.append(fit_linear(rows, extra, target, width) if len(y) else np.concatenate([np.zeros(width + extra.shape[1]), [-30.0]]))
        thresholds.append(best_threshold(out, target) if 0 < target.sum() < len(target) else 0.5)
        extra = np.column_stack([extra, out])
    return Chain(tuple(targets), buckets[chosen].astype(np.int64), weights, thresholds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``(doc_id, p_<category>..., predicted)``: probabilities in chain order and the verdict of the last one."""
    def run(columns, texts):
        p = chain.predict(chain.rows(*features(texts), len(texts)))
        return [columns["doc_id"], *p.T, (p[:, -1] >= chain.thresholds[-1]).astype(np.int32)]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(texts, run, "doc_id long, " + "".join(f"p_{n} double, " for n in chain.names) + "predicted int")
