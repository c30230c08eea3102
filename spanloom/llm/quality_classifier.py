"""Document quality from line marginals of a linear-chain CRF.

Every line is labelled good or bad from its own and its neighbours' features. Forward-backward
gives each line's probability of being good; their mean, weighted by line length, is put on
the scale of a probability by a logistic fit. Only texts outside the held-out fifth are learnt
from, and only the text itself is an input of the score.

Null texts count as empty; an empty text is scored by its one blank line. Repeated rows are
scored each. If the labels are all of one kind the score is that label's share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, labelled
from .chars import Block, map_texts
from .lines import Lines
from .quality_rules import line_samples

THRESHOLD = 0.3


def weighted_mean(p: np.ndarray, chars: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean of ``p`` over each text's lines, a line weighing its length plus one."""
    doc, weight = np.repeat(np.arange(len(count)), count), chars + 1.0
    top, bottom = np.zeros(len(count)), np.zeros(len(count))
    np.add.at(top, doc, p * weight)
    np.add.at(bottom, doc, weight)
    return top / np.maximum(bottom, 1)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic_scale(z: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of a logistic fit (Newton steps with a small ridge)."""
    x, w = np.column_stack([z, np.ones(len(z))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


@dataclass
class Model:
    lines: crf.Crf | None
    slope: float
    offset: float

    def score(self, lines: Lines) -> np.ndarray:
        mean = weighted_mean(self.lines.marginals(lines.with_neighbours(), lines.count), lines.chars, lines.count) if self.lines else np.full(len(lines.count), 0.5)
        return 1 / (1 + np.exp(-(self.slope * logit(mean) + self.offset)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = labelled.SAMPLE_TEXTS) -> Model:
    """Line model and scale from at most ``limit`` labelled texts."""
    x, count, good, chars = line_samples(labelled.sample(docs, labels, "quality", limit), neighbours=True)
    if len(set(good.tolist())) < 2:
        share = np.clip(good.mean() if len(good) else 0.5, 0.01, 0.99)
        return Model(None, 0.0, float(logit(np.array(share))))
    model = crf.fit_from_texts(x, count, good)
    return Model(model, *logistic_scale(logit(weighted_mean(model.marginals(x, count), chars, count)), good))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every document."""
    def run(columns, texts):
        return columns["doc_id"], np.clip(model.score(Lines(Block(texts))), 0, 1)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def line_marginals(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, line, chars, good)``: each line's probability of being good."""
    import pyarrow as pa

    def run(columns, texts):
        lines = Lines(Block(texts))
        good = model.lines.marginals(lines.with_neighbours(), lines.count) if model.lines else np.full(len(lines.doc), 0.5)
        return columns["doc_id"].take(pa.array(lines.doc)), np.arange(len(lines.doc)) - lines.first[lines.doc], lines.chars, good

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, line long, chars long, good double")
