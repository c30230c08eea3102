"""Bracket matching over blocks of an ordered table.

The rule: a mark closes the bracket on top of the stack if that is its mate; a mark that cannot do so opens a bracket,
or, if it only ever closes, has no partner; an optional mark that closes nothing is no bracket. Marks that open and
close alike make the rule depend on what a block is entered with, so a block is reduced, not cut down: for a bracket
of each kind on top of the entered stack, where is it closed, and which brackets stay open if it is not? Both follow
for all kinds in one pass from the last mark to the first. What can be entered from the start of the block is kept;
a stack carried over the reductions of a source settles the pairs between blocks and tells each block which kinds it
is entered with, and the blocks then match their own marks independently.

The carried stack has two numbers for each bracket that is open across blocks; marks closed inside a block never
leave it. There is no limit of depth.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan as sc
from .grouped import Rows, map_groups

BLOCK = 4096
FOUND = "source_id bigint, first_unit bigint, last_unit bigint, kind string"
REDUCED = ("source_id bigint, _block bigint, goes array<int>, closing array<bigint>, stays array<int>, "
           "symbols array<int>, units array<bigint>, below array<int>")
CARRIED = "source_id bigint, _block bigint, entered array<int>, depth bigint, first_unit bigint, last_unit bigint, kind string"
PAIRED, NO_OPENER, NO_CLOSER = "paired_quotation", "quotation_missing_opener", "quotation_missing_closer"


def _reduction(kinds: int, twins: set[int]):
    """Rule for one block; ``kinds`` bracket kinds, ``twins`` of which open and close with the same mark."""
    def rule(r: Rows) -> Rows:
        n, opens, mate = len(r["unit"]), r["opens"].tolist(), r["mate"].tolist()
        empty = kinds
        out, kept = [[-1] * (kinds + 1) for _ in range(n + 1)], [[-1] * (kinds + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            s = opens[i]
            if s < 0:
                out[i], kept[i] = out[i + 1][:], kept[i + 1][:]
            else:
                after = out[i + 1][s]
                if after < 0:
                    kept[i] = [i] * (kinds + 1)
                else:
                    out[i], kept[i] = out[after][:], kept[after][:]
            if mate[i] >= 0:
                out[i][mate[i]], kept[i][mate[i]] = i + 1, -1
        places, todo, seen = {0: 0}, [(0, -1)], {(0, -1)}
        while todo:
            at, popped = todo.pop()
            for t in range(kinds):
                # A mark that opens and closes never lies on its like.
                if out[at][t] >= 0 and not (t == popped and t in twins):
                    new = (out[at][t], t if t in twins else -1)
                    places.setdefault(new[0], len(places))
                    if new not in seen:
                        seen.add(new)
                        todo.append(new)
        goes, closing, stays, frames = [], [], [], {}
        for at in places:
            closing.append(int(r["unit"][at - 1]) if at else -1)
            for t in range(empty + 1):
                goes.append(places.get(out[at][t], -1))
                f = kept[at][t] if out[at][t] < 0 else -1
                stays.append(f)
                while f >= 0 and f not in frames:
                    frames[f] = kept[f + 1][opens[f]]
                    f = frames[f]
        number = {f: i for i, f in enumerate(frames)}
        box = lambda v: _boxed([v])
        return {"source_id": r["source_id"][:1], "_block": r["_block"][:1], "goes": box(goes), "closing": box(closing),
                "stays": box([number.get(f, -1) for f in stays]), "symbols": box([opens[f] for f in frames]),
                "units": box([int(r["unit"][f]) for f in frames]), "below": box([number.get(f, -1) for f in frames.values()])}

    return rule


def _boxed(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _carry(kinds: int):
    """Stream over the reductions of sorted sources: pairs between blocks, open ends, and what each block is entered with."""
    names = [f.split()[0] for f in CARRIED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, some, symbols, units, out = None, False, array("b"), array("q"), []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                if some and row["source_id"] != now:
                    out += [(now, None, None, None, u, None, NO_CLOSER) for u in units]
                    del symbols[:], units[:]
                now, some, at, entered, depth = row["source_id"], True, 0, [], len(units)
                while True:
                    top = symbols[-1] if symbols else kinds
                    entered.append(top)
                    to = row["goes"][at * (kinds + 1) + top]
                    if to < 0:
                        break
                    symbols.pop()
                    opened = units.pop()
                    if opened != row["closing"][to]:
                        out.append((now, None, None, None, opened, row["closing"][to], PAIRED))
                    at = to
                frame = row["stays"][at * (kinds + 1) + top]
                while frame >= 0:
                    symbols.append(row["symbols"][frame])
                    units.append(row["units"][frame])
                    frame = row["below"][frame]
                out.append((now, row["_block"], entered, depth, None, None, None))
                if len(out) >= BLOCK:
                    yield flush()
        out += [(now, None, None, None, u, None, NO_CLOSER) for u in units]
        if out:
            yield flush()

    return run


def _inside(kinds: int):
    """Pairs of a block, entered with the given kinds."""
    def rule(r: Rows) -> Rows | None:
        waiting = [(int(t), None) for t in r["entered"][0][::-1] if t < kinds]
        found: list[tuple[int | None, int | None, str]] = []
        for unit, opens, mate, lone in zip(*(r[c].tolist() for c in ("unit", "opens", "mate", "lone"))):
            if mate >= 0 and waiting and waiting[-1][0] == mate:
                opened = waiting.pop()[1]
                if opened is not None and opened != unit:
                    found.append((opened, unit, PAIRED))
            elif opens >= 0:
                waiting.append((opens, unit))
            elif lone:
                found.append((None, unit, NO_OPENER))
        if not found:
            return None
        first, last, kind = zip(*found)
        return {"source_id": np.repeat(r["source_id"][:1], len(found)), "first_unit": _boxed(list(first)), "last_unit": _boxed(list(last)), "kind": _boxed(list(kind))}

    return rule


def _depths(kinds: int):
    """Open brackets behind each mark of a block, entered with the given kinds at the given depth."""
    def rule(r: Rows) -> Rows:
        waiting, depth, after = [int(t) for t in r["entered"][0][::-1] if t < kinds], int(r["depth"][0]), []
        for opens, mate in zip(r["opens"].tolist(), r["mate"].tolist()):
            if mate >= 0 and waiting and waiting[-1] == mate:
                waiting.pop()
                depth -= 1
            elif opens >= 0:
                waiting.append(opens)
                depth += 1
            after.append(depth)
        after = np.array(after, np.int64)
        return {"source_id": r["source_id"], "unit": r["unit"], "at": r["at"], "lone": r["lone"],
                "before": np.concatenate([r["depth"][:1].astype(np.int64), after[:-1]]), "after": after}

    return rule


def _settled(marks: DataFrame, order: Sequence[str], kinds: int, twins: set[int], block: int) -> tuple[DataFrame, DataFrame]:
    """The marks with what their block is entered with, and the rows of the carried stack."""
    rows = sc.ranked(marks, ["source_id"], order, block)
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reduced = map_groups(rows, ["source_id", "_block"], order, _reduction(kinds, twins), REDUCED)
    carried = sc.cut(reduced.repartition(parts, "source_id").sortWithinPartitions("source_id", "_block").mapInArrow(_carry(kinds), CARRIED))
    entered = carried.where("kind IS NULL").select("source_id", "_block", "entered", "depth")
    own = sc.join_same(rows, entered, ["source_id", "_block"]).select(*rows.columns, "entered", "depth")
    return own, carried


def match(marks: DataFrame, order: Sequence[str], kinds: int, twins: set[int], *, block: int = BLOCK) -> DataFrame:
    """Pairs between units and marks without a partner: ``source_id, first_unit, last_unit, kind``.

    ``marks`` has ``source_id``, the ``order`` columns, ``unit``, the kind a mark ``opens`` and the kind it closes
    (``mate``), -1 for none, and ``lone``: whether it is reported if it neither closes nor opens.
    """
    own, carried = _settled(marks, order, kinds, twins, block)
    inside = map_groups(own, ["source_id", "_block"], order, _inside(kinds), FOUND)
    return inside.unionByName(carried.where("kind IS NOT NULL").select("source_id", "first_unit", "last_unit", "kind"))


def depths(marks: DataFrame, kinds: int, twins: set[int], *, block: int = BLOCK) -> DataFrame:
    """Each mark, ordered by ``unit`` and ``at``, with the number of open brackets before and behind it."""
    own, _ = _settled(marks, ["unit", "at"], kinds, twins, block)
    return map_groups(own, ["source_id", "_block"], ["unit", "at"], _depths(kinds),
                      "source_id bigint, unit bigint, at bigint, lone boolean, before bigint, after bigint")
