"""Topic boundaries, cuts and segments of bounded sources, found in one walk over the units of a source.

The operators in ``topics`` spread terms and boundaries over the cluster and join them again. A source that is one input
row is held by one task anyway: it counts the terms beside each boundary, finds the valleys and cuts the units there.
Units are numbered without gaps. Results equal those of ``topics``.
"""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .grouped import Rows, map_groups
from .sentences import _TERMINAL, _marked
from .text_groups import KEY, SCALE, _folded, _terms
from .topics import TopicOptions


def _logs(counts: np.ndarray) -> np.ndarray:
    """``1 + ln`` of small whole numbers, from a table of those that occur."""
    values, at = np.unique(counts, return_inverse=True)
    return np.array([1 + log(v) if v else 0.0 for v in values.tolist()])[at]


class _Walk:
    """Hard blocks and boundary similarities of the units of one source; a boundary is named by the row before it."""

    def __init__(self, r: Rows, lexicon: tx.Lexicon, o: TopicOptions):
        start, end = r["start_ms"], r["end_ms"]
        self.pos, self.n = r["pos"], len(start)
        self.gap = np.ma.array(np.append(start[1:] - end[:-1], 0), mask=np.arange(self.n) == self.n - 1)
        opens = np.append(True, start[1:] - end[:-1] > o.max_gap_ms)
        first = np.flatnonzero(opens)
        block = np.cumsum(opens) - 1
        self.low, self.high = first[block], (np.append(first[1:], self.n) - 1)[block]
        self.hard = np.arange(self.n) == self.high
        self.similarity = self._similarity(r["text"].tolist(), lexicon, o.window_units)

    def _similarity(self, texts: list[str | None], lexicon: tx.Lexicon, w: int) -> np.ndarray:
        """Cosine of the term weights of the ``w`` units before and behind each boundary; NaN where a side has no term."""
        stop, codes, unit, term, count = frozenset(lexicon.stop), {}, [], [], []
        for i, text in enumerate(texts):
            held = Counter(_terms(_folded(text), stop))
            unit += [i] * len(held)
            term += [codes.setdefault(t, len(codes)) for t in held]
            count += held.values()
        out = np.full(self.n, np.nan)
        if not term:
            return out
        unit, term, count = (np.array(x, np.int64) for x in (unit, term, count))
        df = np.bincount(term)
        idf = np.array([1 + log((1 + self.n) / (1 + d)) for d in df.tolist()])
        at = (unit[None, :] + np.arange(-w, w)[:, None]).ravel()
        unit, term, count = np.tile(unit, 2 * w), np.tile(term, 2 * w), np.tile(count, 2 * w)
        near = (at >= self.low[unit]) & (at < self.high[unit])
        at, unit, term, count = at[near], unit[near], term[near], count[near]
        if not len(at):
            return out
        size = len(codes)
        ident, row = np.unique(at * size + term, return_inverse=True)
        sides = np.zeros((2, len(ident)), np.int64)
        np.add.at(sides, ((unit > at).astype(np.int64), row), count)
        weight = idf[ident % size]
        a, b = _logs(sides[0]) * weight, _logs(sides[1]) * weight
        sums = np.zeros((3, self.n), np.int64)
        for k, product in enumerate((a * b, a * a, b * b)):
            np.add.at(sums[k], ident // size, np.rint(product * SCALE).astype(np.int64))
        both = np.flatnonzero((sums[1] > 0) & (sums[2] > 0))
        dot, na, nb = sums[:, both].astype(float)
        out[both] = np.rint(np.minimum(1.0, dot / (np.sqrt(na) * np.sqrt(nb))) * 1e9) / 1e9
        return out

    def valleys(self) -> tuple[np.ndarray, ...]:
        """Rows of the local minima, with similarity, left and right peak and depth; see ``topics.valleys``."""
        at = np.flatnonzero(~np.isnan(self.similarity))
        v = self.similarity[at]
        none = tuple(np.zeros(0, t) for t in (np.int64, float, float, float, float))
        if len(at) < 3:
            return none
        beside = np.diff(at) == 1
        before = np.append(np.nan, np.where(beside, v[:-1], np.nan))
        behind = np.append(np.where(beside, v[1:], np.nan), np.nan)
        begins, ends = np.flatnonzero(~(before == v)), np.flatnonzero(~(behind == v))
        # Comparisons with a missing neighbour are false, so a row without one counts as a peak.
        left, right = np.flatnonzero(~(before >= v)), np.flatnonzero(~(behind >= v))
        low = (before[begins] > v[begins]) & (behind[ends] > v[begins])
        begins, ends = begins[low], ends[low]
        if not len(begins):
            return none
        lp, rp = v[left[np.searchsorted(left, begins) - 1]], v[right[np.searchsorted(right, ends, side="right")]]
        s = v[begins]
        depth = np.rint(((lp - s) + (rp - s)) / (lp + rp) * 1e9) / 1e9
        return at[begins] + (at[ends] - at[begins]) // 2, s, lp, rp, depth

    def cuts(self, r: Rows, o: TopicOptions, guarded: bool) -> tuple[np.ndarray, ...]:
        """The valleys and a reason each that rejects it, or None; see ``topics.topic_cuts`` and ``topics.drop_crossed``."""
        at, s, lp, rp, depth = self.valleys()
        reason = np.full(len(at), None, dtype=object)
        if "_linked" in r:
            reason[r["_linked"][at].astype(bool)] = "event_dependency_crosses_cut"
        m = o.min_segment_units
        reason[(at - self.low[at] + 1 < m) | (self.high[at] - at < m)] = "min_segment_units_conflict"
        reason[depth < o.min_depth] = "below_min_depth"
        if guarded:
            ends = _marked(_TERMINAL, [(r["text"][i] or "").rstrip(" ") for i in at.tolist()])
            reason[~(ends | (self.gap.data[at] >= o.pause_ms))] = "no_utterance_end_evidence"
        return at, s, lp, rp, depth, reason


def _walked(units: DataFrame, lexicon: tx.Lexicon, o: TopicOptions, emit, schema: str, placed: bool, linked: str | None = None) -> DataFrame:
    if o.min_segment_units > 2:
        raise ValueError("cuts closer than the shortest segment need topics.topic_cuts")
    extra = [] if linked is None else [F.col(linked).alias("_linked")]
    rows = units.select("source_id", "pos", "start_ms", "end_ms", "text", *extra)

    def rule(r: Rows) -> Rows:
        out = emit(_Walk(r, lexicon, o), r)
        return {"source_id": np.repeat(r["source_id"][:1], len(next(iter(out.values())))), **out}

    return map_groups(rows, KEY, ["pos"], rule, "source_id bigint, " + schema, placed=placed)


def boundary_similarity(units: DataFrame, lexicon: tx.Lexicon, options: TopicOptions = TopicOptions(), *, placed: bool = False) -> DataFrame:
    """``topics.boundary_similarity`` of bounded sources, without what only later steps need."""
    def emit(w: _Walk, r: Rows) -> Rows:
        # The last unit of a source has nothing behind it.
        return {"after_unit": w.pos[:-1], "gap_ms": w.gap.data[:-1], "hard": w.hard[:-1],
                "similarity": np.ma.masked_invalid(w.similarity[:-1])}

    return _walked(units, lexicon, options, emit, "after_unit bigint, gap_ms bigint, hard boolean, similarity double", placed)


def topic_cuts(units: DataFrame, lexicon: tx.Lexicon, options: TopicOptions = TopicOptions(), *, guarded: bool = False, linked: str | None = None,
               placed: bool = False) -> DataFrame:
    """``topics.topic_cuts`` of bounded sources; a unit that ``linked`` ties to the next one keeps the cut between them away."""
    def emit(w: _Walk, r: Rows) -> Rows:
        at, s, lp, rp, depth, reason = w.cuts(r, options, guarded)
        return {"after_unit": w.pos[at], "similarity": s, "left_peak": lp, "right_peak": rp, "depth": depth, "reason": reason}

    return _walked(units, lexicon, options, emit, "after_unit bigint, similarity double, left_peak double, right_peak double, depth double, reason string", placed, linked)


def topic_spans(units: DataFrame, lexicon: tx.Lexicon, options: TopicOptions = TopicOptions(), *, guarded: bool = False, linked: str | None = None,
                placed: bool = False) -> DataFrame:
    """Stretches of units between accepted cuts and hard pauses of bounded sources; see ``topics.judged_segments``."""
    def emit(w: _Walk, r: Rows) -> Rows:
        at, *_, reason = w.cuts(r, options, guarded)
        stop = w.hard.copy()
        stop[at[np.equal(reason, None)]] = True
        last = np.flatnonzero(stop)
        first = np.append(0, last[:-1] + 1)
        return {"first_unit": w.pos[first], "last_unit": w.pos[last], "start_ms": np.minimum.reduceat(r["start_ms"], first),
                "end_ms": np.maximum.reduceat(r["end_ms"], first)}

    return _walked(units, lexicon, options, emit, "first_unit bigint, last_unit bigint, start_ms bigint, end_ms bigint", placed, linked)
