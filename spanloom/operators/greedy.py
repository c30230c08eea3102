"""Greedy selection in priority order: keep an item unless it conflicts with a kept one.

``greedy_line`` serves items on a time line whose conflicts reach a bounded
distance (overlap suppression, minimum spacing). It never forms the pairs of
conflicting items: every task takes one stretch of one source and one band of
lengths, with a margin of the conflict reach, and decides whatever the margin
cannot change. Stretches and bands move by half their width and the few undecided items go round again, until none
is left; the best undecided item is always decidable, so the loop ends. Results
equal the sequential rule exactly.

``greedy_edges`` takes an explicit conflict table instead and runs rounds of
joins: keep every item without an undecided better neighbour, drop its
neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .grouped import Rows, map_groups

OPEN, KEPT, DROPPED = 0, 1, 2


def iou(a_start, a_end, b_start, b_end):
    """Overlap over hull, for columns or arrays."""
    return (np.minimum(a_end, b_end) - np.maximum(a_start, b_start)).clip(0) / (
        np.maximum(a_end, b_end) - np.minimum(a_start, b_start))


def iou_column(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    common = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, common / hull).otherwise(F.lit(0.0))


def _decide(start: np.ndarray, end: np.ndarray, state: np.ndarray, home: np.ndarray, reach: int,
            iou_limit: float | None, spacing: int | None) -> tuple[np.ndarray, np.ndarray]:
    """States and suppressors after one pass in priority order over a stretch with its margins.

    An open item in the margin stays unknown and taints whatever it conflicts
    with; a tainted item is left open unless a kept one already drops it. The
    suppressor (a row number, -1 for none) is certain only for untainted items.
    Conflicts are looked up among the items that start within ``reach``.
    """
    out, by = state.copy(), np.full(len(start), -1)
    tainted = np.zeros(len(start), bool)
    along = np.argsort(start, kind="stable")
    line = start[along]
    low = np.searchsorted(line, start - reach, "left")
    high = np.searchsorted(line, start + reach, "right")
    for i in range(len(start)):
        if out[i] == DROPPED:
            continue
        others = along[low[i]:high[i]]
        others = others[(others > i) & (out[others] == OPEN)]
        if iou_limit is not None:
            near = iou(start[i], end[i], start[others], end[others]) >= iou_limit
        elif spacing is None:
            near = (start[others] <= end[i]) & (end[others] >= start[i])
        else:
            near = np.abs(start[others] - start[i]) < spacing
        hit = others[near]
        if out[i] == KEPT or (home[i] and not tainted[i]):
            out[i] = KEPT
            out[hit] = DROPPED
            by[hit[~tainted[hit]]] = i
        else:
            tainted[hit] = True
    return out, by


# Classes of length in a band, and the classes beside it that its items may be in conflict with.
BAND, BESIDE = 8, 2


class _Grid:
    """Cells of a time line in which all conflicts of the items at home can be seen.

    Ranges whose overlap over hull reaches ``limit`` differ in length by at most the factor ``1 / limit``. Their lengths
    fall into classes of that ratio, ``BAND`` neighbouring classes form a band, and a band has stretches as wide as its
    own lengths ask for: an item meets items like it, whatever else the source holds. Other conflicts have one reach.
    """

    def __init__(self, rows: DataFrame, iou_limit: float | None, spacing: int | None, stretch: int | None):
        self.stretch, self.fixed, self.middle = stretch, None, 0
        if iou_limit is None:
            # Items that share a point start closer together than the longer one is long.
            longest = spacing if spacing is not None else rows.agg(F.max(F.col("_e") - F.col("_s"))).first()[0]
            self.fixed = (longest or 0) + (spacing is None)
        else:
            self.ratio = 1 / iou_limit if iou_limit < 1 else 2.0
            self.middle = rows.agg(F.percentile_approx(self.length_class(), 0.5)).first()[0] or 0

    def length_class(self) -> Column:
        if self.fixed is not None:
            return F.lit(0)
        return F.floor(F.log(F.greatest(F.col("_e") - F.col("_s"), F.lit(1))) / F.log(F.lit(self.ratio))).cast("int")

    def reach(self, top: Column) -> Column:
        """Start distance within which items of classes up to ``top`` are in conflict."""
        if self.fixed is not None:
            return F.lit(self.fixed).cast("bigint")
        return F.ceil(F.pow(F.lit(self.ratio), F.greatest(top, F.lit(0)) + 1)).cast("bigint") + 1

    def cells(self, rows: DataFrame, odd: bool) -> DataFrame:
        """Every item at its home, ``_home``, and in the cells that have to see it; other rounds have other edges."""
        offset = BAND // 2 - self.middle + (BAND // 2 if odd else 0)
        band = lambda c: F.floor((c + offset) / F.lit(BAND)).cast("int")
        seen = rows.withColumn("_c", self.length_class())
        bands = F.array(band(F.col("_c"))) if self.fixed is not None else F.sequence(band(F.col("_c") - BESIDE), band(F.col("_c") + BESIDE))
        seen = seen.withColumn("_band", F.explode(bands)).withColumn("_reach", self.reach((F.col("_band") + 1) * BAND - offset - 1 + BESIDE))
        width = F.lit(self.stretch).cast("bigint") if self.stretch else 64 * F.col("_reach")
        seen = seen.withColumn("_width", width).withColumn("_at", F.col("_s") + (F.floor(F.col("_width") / 2) if odd else F.lit(0)))
        cell = lambda t: F.floor(t / F.col("_width"))
        spread = seen.withColumn("_cell", F.explode(F.sequence(cell(F.col("_at") - F.col("_reach")), cell(F.col("_at") + F.col("_reach")))))
        home = (F.col("_band") == band(F.col("_c"))) & (F.col("_cell") == cell(F.col("_at")))
        return spread.withColumn("_home", home).drop("_c", "_reach", "_width", "_at")


def greedy_line(items: DataFrame, key: Sequence[str], order: Sequence[Column], ident: str, *,
                start: str = "start_ms", end: str = "end_ms", iou_limit: float | None = None,
                spacing: int | None = None, overlap: bool = False, stretch: int | None = None) -> DataFrame:
    """``(key, ident, start, end, retained, suppressed_by, by_start, by_end)`` of every item.

    ``order`` ranks the items of a key (total), ``ident`` is a number. Conflict:
    overlap over hull at least ``iou_limit``, starts closer than ``spacing``, or
    (``overlap``) ranges that share a point. ``suppressed_by`` is the best kept
    item in conflict, ``by_start`` and ``by_end`` its range.
    """
    if (iou_limit is not None) + (spacing is not None) + overlap != 1:
        raise ValueError("name exactly one kind of conflict")
    key = list(key)
    ranks = [f"_o{i}" for i in range(len(order))]
    rows = cut(items.select(*key, F.col(ident).cast("bigint").alias("_id"), F.col(start).cast("bigint").alias("_s"),
                            F.col(end).cast("bigint").alias("_e"), *[c.alias(n) for c, n in zip(order, ranks)]))
    # An empty range overlaps nothing.
    empty = rows.where("_e <= _s") if iou_limit is not None else None
    rows = rows.where("_e > _s") if iou_limit is not None else rows
    grid = _Grid(rows, iou_limit, spacing, stretch)
    # Items of one range share their fate: only the best of them takes part.
    span = [*key, "_s", "_e"]
    folded = not rows.groupBy(*span).count().where("count > 1").isEmpty()
    pool = rows
    if folded:
        best = rows.groupBy(*span).agg(F.min_by(F.struct("_id", *ranks), F.struct(*ranks)).alias("_b"))
        pool = best.select(*span, "_b.*")
    pool = pool.select(*span, "_id", *ranks, F.lit(OPEN).alias("_state"))
    lost, odd = [], False
    while True:
        marked = _round(pool, key, ranks, grid, odd, iou_limit, spacing)
        lost.append(marked.where(F.col("_state") == DROPPED))
        pool = marked.where(F.col("_state") != DROPPED).drop("_by", "_ks", "_ke")
        if marked.where(F.col("_state") == OPEN).isEmpty():
            kept = pool
            break
        odd = not odd
    dropped = lost[0]
    for part in lost[1:]:
        dropped = dropped.unionByName(part)
    winner = [F.col(c) for c in ("_by", "_ks", "_ke")]
    sure = dropped.where("_by IS NOT NULL").select(*span, "_id", *winner)
    unsure = _suppressors(dropped.where("_by IS NULL"), kept, key, ranks, grid, iou_limit, spacing)
    fate = (kept.select(*span, "_id", F.col("_id").alias("_by"), F.col("_s").alias("_ks"), F.col("_e").alias("_ke"))
            .unionByName(sure).unionByName(unsure))
    if folded:
        fate = rows.select(*span, "_id").join(fate.drop("_id"), span)
    if empty is not None:
        fate = fate.unionByName(empty.select(*span, "_id", F.col("_id").alias("_by"), F.col("_s").alias("_ks"), F.col("_e").alias("_ke")))
    mine = F.col("_by") == F.col("_id")
    return fate.select(*key, F.col("_id").alias(ident), F.col("_s").alias("range_start"), F.col("_e").alias("range_end"),
                       mine.alias("retained"), *[F.when(~mine, F.col(c)).alias(n) for c, n in (
                           ("_by", "suppressed_by"), ("_ks", "by_start"), ("_ke", "by_end"))])


def greedy_bounded(items: DataFrame, key: Sequence[str], order: Sequence[Column], ident: str, *,
                   start: str = "start_ms", end: str = "end_ms", iou_limit: float, carry: Sequence[str] = (), retained_only: bool = False) -> DataFrame:
    """The suppression of ``greedy_line`` for keys that are one input row each: every key is walked where it lies.

    A walk sees all items of its key, so nothing is undecided, stored or dealt. ``carry`` columns come along;
    with ``retained_only`` only the kept items leave the walk.
    """
    key, carry = list(key), list(carry)
    ranks = [f"_o{i}" for i in range(len(order))]
    rows = items.select(*key, F.col(ident).cast("bigint").alias("_id"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"),
                        *[c.alias(n) for c, n in zip(order, ranks)], *[F.col(c).alias(f"_c_{c}") for c in carry])
    given = [*key, "_id", "_s", "_e", *[f"_c_{c}" for c in carry]]

    def work(rows: Rows) -> Rows | None:
        n = len(rows["_s"])
        real = np.flatnonzero(rows["_e"] > rows["_s"])
        # An empty range overlaps nothing.
        state, by = np.full(n, KEPT), np.full(n, -1)
        if len(real):
            s, e = rows["_s"][real], rows["_e"][real]
            state[real], found = _decide(s, e, np.full(len(real), OPEN), np.ones(len(real), bool), int((e - s).max()) + 1, iou_limit, None)
            by[real] = np.where(found < 0, -1, real[found])
        pick = np.flatnonzero(state == KEPT) if retained_only else np.arange(n)
        out = {name: rows[name][pick] for name in given}
        out["_kept"], who = state[pick] == KEPT, by[pick]
        for name, column in (("_by", "_id"), ("_ks", "_s"), ("_ke", "_e")):
            out[name] = np.ma.array(rows[column][who], mask=who < 0)
        return out

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = ", ".join(f"{n} {types[n]}" for n in given)
    fate = map_groups(rows.select(*given, *ranks), key, ranks, work, f"{fields}, _kept boolean, _by bigint, _ks bigint, _ke bigint", placed=True)
    return fate.select(*key, F.col("_id").alias(ident), F.col("_s").alias("range_start"), F.col("_e").alias("range_end"), F.col("_kept").alias("retained"),
                       F.col("_by").alias("suppressed_by"), F.col("_ks").alias("by_start"), F.col("_ke").alias("by_end"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def _round(pool: DataFrame, key: list[str], ranks: list[str], grid: _Grid, odd: bool,
           iou_limit: float | None, spacing: int | None) -> DataFrame:
    """One pass over all cells; only the items at home in a cell come back from it."""
    carried = [*key, "_s", "_e", "_id", *ranks]

    def work(rows: Rows) -> Rows:
        home = rows["_home"].astype(bool)
        reach = spacing if spacing is not None else int((rows["_e"] - rows["_s"]).max()) + 1
        state, by = _decide(rows["_s"], rows["_e"], rows["_state"], home, reach, iou_limit, spacing)
        out = {n: rows[n][home] for n in carried}
        out["_state"] = state[home]
        pick = by[home]
        for name, column in (("_by", "_id"), ("_ks", "_s"), ("_ke", "_e")):
            out[name] = np.ma.array(rows[column][pick], mask=pick < 0)
        return out

    types = {f.name: f.dataType.simpleString() for f in pool.schema}
    fields = ", ".join(f"{n} {types[n]}" for n in carried)
    spread = grid.cells(pool, odd)
    return cut(map_groups(spread.select(*carried, "_state", "_home", "_band", "_cell"), [*key, "_band", "_cell"], ranks, work,
                          f"{fields}, _state int, _by bigint, _ks bigint, _ke bigint"))


def _suppressors(lost: DataFrame, kept: DataFrame, key: list[str], ranks: list[str], grid: _Grid,
                 iou_limit: float | None, spacing: int | None) -> DataFrame:
    """Best kept item in conflict with the dropped ones that lay beside an undecided one."""
    place = F.struct(*ranks)
    reach = grid.reach(F.col("_c") + BESIDE)
    a = lost.withColumn("_c", grid.length_class()).select(*key, "_s", "_e", "_id", place.alias("_o"), "_c", F.floor(F.col("_s") / reach).alias("_cell"))
    near = F.array(F.lit(0)) if grid.fixed is not None else F.sequence(F.col("_own") - BESIDE, F.col("_own") + BESIDE)
    b = kept.withColumn("_own", grid.length_class()).withColumn("_c", F.explode(near)).select(
        *key, F.col("_s").alias("_ks"), F.col("_e").alias("_ke"), place.alias("_ko"), F.col("_id").alias("_by"), "_c",
        F.explode(F.sequence(F.floor((F.col("_s") - reach) / reach), F.floor((F.col("_s") + reach) / reach))).alias("_cell"))
    if iou_limit is not None:
        clash = iou_column(F.col("_s"), F.col("_e"), F.col("_ks"), F.col("_ke")) >= iou_limit
    elif spacing is None:
        clash = (F.col("_s") <= F.col("_ke")) & (F.col("_e") >= F.col("_ks"))
    else:
        clash = F.abs(F.col("_s") - F.col("_ks")) < spacing
    pairs = a.join(b, [*key, "_c", "_cell"]).where(clash & (F.col("_ko") < F.col("_o")))
    best = pairs.groupBy(*key, "_s", "_e", "_id").agg(F.min_by(F.struct("_by", "_ks", "_ke"), "_ko").alias("_w"))
    return best.select(*key, "_s", "_e", "_id", "_w._by", "_w._ks", "_w._ke")


def greedy_edges(items: DataFrame, edges: DataFrame, key: Sequence[str], ident: str,
                 order: Sequence[Column]) -> DataFrame:
    """``(key, ident, retained, suppressed_by)`` for conflicts given as ``(key, left, right)`` pairs."""
    key = list(key)
    nodes = items.select(*key, F.col(ident).alias("_id"),
                         F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"))
    both = edges.select(*key, F.col("left").alias("_a"), F.col("right").alias("_b"))
    both = both.unionByName(both.select(*key, F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    a = nodes.select(*key, F.col("_id").alias("_a"), F.col("_o").alias("_ao"))
    b = nodes.select(*key, F.col("_id").alias("_b"), F.col("_o").alias("_bo"))
    # Directed: _b is the worse item of the pair.
    worse = cut(both.join(a, [*key, "_a"]).join(b, [*key, "_b"]).where("_ao < _bo").distinct())
    live, left = worse, cut(nodes)
    kept: list[DataFrame] = []
    while True:
        blocked = live.select(*key, F.col("_b").alias("_id")).distinct()
        winners = cut(left.join(blocked, [*key, "_id"], "left_anti"))
        kept.append(winners)
        beaten = live.join(winners.select(*key, F.col("_id").alias("_a")), [*key, "_a"], "left_semi").select(
            *key, F.col("_b").alias("_id")).distinct()
        gone = winners.select(*key, "_id").unionByName(beaten)
        left = cut(left.join(gone, [*key, "_id"], "left_anti"))
        if left.isEmpty():
            break
        rest = left.select(*key, "_id")
        live = cut(live.join(rest.withColumnRenamed("_id", "_a"), [*key, "_a"], "left_semi")
                   .join(rest.withColumnRenamed("_id", "_b"), [*key, "_b"], "left_semi"))
    chosen = kept[0]
    for part in kept[1:]:
        chosen = chosen.unionByName(part)
    chosen = chosen.select(*key, "_id").withColumn("_kept", F.lit(True))
    by = (worse.join(chosen.withColumnRenamed("_id", "_a"), [*key, "_a"])
          .groupBy(*key, F.col("_b").alias("_id")).agg(F.min_by("_a", "_ao").alias("_by")))
    held = nodes.join(chosen, [*key, "_id"], "left").join(by, [*key, "_id"], "left")
    return held.select(*key, F.col("_id").alias(ident), F.coalesce("_kept", F.lit(False)).alias("retained"),
                       F.when(F.col("_kept").isNull(), F.col("_by")).alias("suppressed_by"))
