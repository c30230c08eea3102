"""Chains of jumps along an order, without a walk over a whole key.

Every row names the place its chain goes on to, further along. Which rows lie on the chain from a key's first row? In a
block of rows, one pass from the last row to the first finds for each row where its chain leaves the block. Only the
places that a block is entered at matter beyond it; they form a table of the same kind, many times smaller, that the
same procedure solves. A chain enters a block at one place, from which the block then marks its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import scan as sc
from .grouped import Rows, map_groups

BLOCK = 4096


def _exits(place: np.ndarray, goes: list) -> list:
    """For each row the first place of its chain behind the rows, or none."""
    at, out, end = {p: i for i, p in enumerate(place.tolist())}, [None] * len(place), int(place[-1])
    for i in range(len(place) - 1, -1, -1):
        g = goes[i]
        out[i] = None if g is None else g if g > end else out[at[g]]
    return out


def _marked(place: np.ndarray, goes: list, start: int) -> np.ndarray:
    at, out, i = {p: n for n, p in enumerate(place.tolist())}, np.zeros(len(place), bool), start
    while i is not None and i in at:
        out[at[i]] = True
        i = goes[at[i]]
    return out


def _none(values: np.ndarray) -> list:
    return [None if v is None or v != v else int(v) for v in values.tolist()]


def on_chain(rows: DataFrame, key: Sequence[str], place: str, goes: str, *, block: int = BLOCK) -> DataFrame:
    """``key, place`` of the rows on the chain of each key's first row.

    ``goes`` names a later place of the same key that has a row, or is null. Keys and places are whole numbers.
    """
    key = list(key)
    slim = rows.select(*[F.col(k).cast("bigint").alias(k) for k in key], F.col(place).cast("bigint").alias("_p"), F.col(goes).cast("bigint").alias("_g"))
    fields = ", ".join(f"{k} bigint" for k in key)
    first = slim.groupBy(*key).agg(F.min("_p").alias("_in"), F.count(F.lit(1)).alias("_n"))
    longest = first.agg(F.max("_n")).first()[0] or 0

    def mark(r: Rows) -> Rows:
        keep = _marked(r["_p"], _none(r["_g"]), int(r["_in"][0]))
        return {c: r[c][keep] for c in (*key, "_p")}

    if longest <= block:
        held = slim.join(first.select(*key, "_in"), key)
        return map_groups(held, key, ["_p"], mark, f"{fields}, _p bigint").withColumnRenamed("_p", place)
    blocks = sc.ranked(slim, key, ["_p"], block)

    def leave(r: Rows) -> Rows:
        out = _exits(r["_p"], _none(r["_g"]))
        return {**{c: r[c] for c in (*key, "_p")}, "_g": np.array(out, dtype=object)}

    exits = cut(map_groups(blocks.select(*key, "_block", "_p", "_g"), [*key, "_block"], ["_p"], leave, f"{fields}, _p bigint, _g bigint"))
    # Places at which a block can be entered: the first of a key, and where a chain leaves another block to.
    doors = exits.where("_g IS NOT NULL").select(*key, F.col("_g").alias("_p")).unionByName(first.select(*key, F.col("_in").alias("_p"))).distinct()
    doors = cut(doors.join(exits, [*key, "_p"]))
    # Larger blocks at each level, so that it ends however short the jumps are.
    entered = on_chain(doors, key, "_p", "_g", block=4 * block)
    held = blocks.join(entered.withColumn("_door", F.lit(True)), [*key, "_p"], "left")
    per_block = held.where("_door").groupBy(*key, "_block").agg(F.min("_p").alias("_in"))
    return map_groups(blocks.join(per_block, [*key, "_block"]).select(*key, "_block", "_p", "_g", "_in"), [*key, "_block"], ["_p"], mark, f"{fields}, _p bigint").withColumnRenamed("_p", place)
