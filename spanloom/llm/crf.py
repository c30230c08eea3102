"""A linear-chain conditional random field with two labels, over many chains at once.

Step ``t`` of all chains that are long enough is one array operation, so the Python
loop runs over positions, not over chains. Label 1 scores ``x . weights + bias`` at a
position and label 0 scores zero; ``moves[a, b]`` scores label ``b`` after ``a``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Chains:
    """Positions of ragged chains laid end to end: ``count[i]`` rows each."""

    def __init__(self, count: np.ndarray):
        self.rows = int(count.sum())
        first = np.cumsum(count) - count
        self.order = np.argsort(-count, kind="stable")
        self.first, self.count = first[self.order], count[self.order]
        self.active = np.searchsorted(-self.count, -np.arange(1, int(count.max(initial=0)) + 1), side="right")

    def step(self, t: int) -> np.ndarray:
        return self.first[:self.active[t]] + t

    def __len__(self) -> int:
        return len(self.active)


@dataclass
class Crf:
    weights: np.ndarray
    bias: float
    moves: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features.astype(np.float64) @ self.weights + self.bias

    def marginals(self, features: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of label 1 at each position (forward-backward)."""
        return _pass(self.scores(features), self.moves, Chains(count))[0]

    def decode(self, features: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Best label sequence of each chain (Viterbi); ties go to label 1."""
        s, chains = self.scores(features), Chains(count)
        back = np.zeros((chains.rows, 2), np.int8)
        last = np.zeros((len(chains.count), 2))
        for t in range(len(chains)):
            at = chains.step(t)
            if t:
                came = last[:len(at), :, None] + self.moves
                back[at] = (came[:, 1] >= came[:, 0]).astype(np.int8)
                last[:len(at)] = came.max(1)
            last[:len(at), 1] += s[at]
        out = np.zeros(chains.rows, np.int8)
        label = (last[:, 1] >= last[:, 0]).astype(np.int8)
        for t in range(len(chains) - 1, -1, -1):
            at = chains.step(t)
            out[at] = label[:len(at)]
            label[:len(at)] = back[at, label[:len(at)]]
        return out


def _pass(s: np.ndarray, moves: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of label 1, expected moves, and the log partition summed over the chains."""
    ahead, behind = np.zeros((chains.rows, 2)), np.zeros((chains.rows, 2))
    ahead[:, 1] = s
    for t in range(1, len(chains)):
        at = chains.step(t)
        came = ahead[at - 1][:, :, None] + moves
        ahead[at] += np.logaddexp(came[:, 0], came[:, 1])
    expected = np.zeros((2, 2))
    full = chains.count > 0
    ends = (chains.first + chains.count - 1)[full]
    total = np.zeros(chains.rows)
    logz = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    total[chains.first[full]] = logz
    for t in range(len(chains) - 2, -1, -1):
        at = chains.step(t + 1)
        right = behind[at]
        right[:, 1] += s[at]
        both = moves + right[:, None, :]
        behind[at - 1] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        z = np.logaddexp((ahead[at - 1] + behind[at - 1])[:, 0], (ahead[at - 1] + behind[at - 1])[:, 1])
        expected += np.exp(ahead[at - 1][:, :, None] + both - z[:, None, None]).sum(0)
    return 1 / (1 + np.exp(np.clip(ahead[:, 0] + behind[:, 0] - ahead[:, 1] - behind[:, 1], -500, 500))), expected, float(logz.sum())


def fit(features: np.ndarray, count: np.ndarray, labels: np.ndarray, *, l2: float = 1e-3, rounds: int = 120, rate: float = 0.1) -> Crf:
    """Weights by gradient ascent (Adam) on the mean conditional log-likelihood of a position.

    Features are fitted at unit variance, so that rare marks weigh as much as lengths.
    """
    scale = features.astype(np.float64).std(0) + 1e-3
    x, y, chains = features.astype(np.float64) / scale, labels.astype(np.float64), Chains(count)
    n, width = max(len(x), 1), x.shape[1]
    starts = np.zeros(len(x), bool)
    starts[chains.first[chains.count > 0]] = True
    seen = np.zeros((2, 2))
    follow = np.flatnonzero(~starts)
    np.add.at(seen, (labels[follow - 1].astype(int), labels[follow].astype(int)), 1)
    theta, m, v = np.zeros(width + 5), np.zeros(width + 5), np.zeros(width + 5)
    for k in range(1, rounds + 1):
        p, expected, _ = _pass(x @ theta[:width] + theta[width], theta[width + 1:].reshape(2, 2), chains)
        rest = y - p
        grad = np.concatenate([x.T @ rest, [rest.sum()], (seen - expected).ravel()]) / n - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Crf(theta[:width] / scale, float(theta[width]), theta[width + 1:].reshape(2, 2))


def fit_from_texts(features: np.ndarray, count: np.ndarray, good: np.ndarray, *, refits: int = 1, **options) -> Crf:
    """A line model from text labels: lines take their text's label, then good-looking lines of bad texts are freed.

    After each refit, lines of a bad text that the model finds good lose the bad label,
    except the least good line of that text.
    """
    text = np.repeat(np.arange(len(count)), count)
    labels = good[text].astype(np.int8)
    model = fit(features, count, labels, **options)
    for _ in range(refits):
        p = model.marginals(features, count)
        lowest = np.full(len(count), np.inf)
        np.minimum.at(lowest, text, p)
        labels = np.where(good[text].astype(bool), 1, (p > 0.5) & (p > lowest[text])).astype(np.int8)
        model = fit(features, count, labels, **options)
    return model
