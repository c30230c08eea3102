"""Running values over an ordered key without one task per key.

``Window.partitionBy(source)`` puts a whole source into one task. A source that
holds a third of all rows then decides the run time of the job. ``scan`` cuts
every source into blocks of its order instead:

1. windows inside ``(key, block)``, spread over the cluster by hash;
2. one summary row per block, aggregated map-side before its shuffle;
3. a window over the block summaries (thousands of times fewer rows);
4. an equi-join that carries the summary of the earlier (or later) blocks in.

Step 4 joins on the partitioning of step 1, so the big side is shuffled once.
``block`` must not decrease along ``order``. Without a block, plain windows by
key run instead: that is for keys whose rows all come from one input row, where
a group cannot outgrow a row and the partitioning by key is already there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut

BLOCK_ROWS = 4096
# Blocks by the first order column: by time for milliseconds, by rows otherwise.
AUTO = "auto"
BLOCK_MS = 900_000

FIRST = Window.unboundedPreceding


@dataclass(frozen=True)
class Running:
    """One running value: in the block, of the block, across blocks, merged.

    A ``backward`` one gets windows in descending order. A frame that ends with its key is built anew for every row,
    which takes the square of the rows; the same rows read backward are one pass.
    """

    inside: Callable
    total: Callable
    across: Callable
    merge: Callable
    backward: bool = False


def _first_of(a: Column, b: Column | None) -> Column:
    return a if b is None else F.coalesce(a, b)


def by_rows(position: str, rows: int | None = BLOCK_ROWS) -> Column | None:
    return None if rows is None else F.floor(F.col(position) / F.lit(rows))


def by_time(column: str, ms: int | None = BLOCK_MS) -> Column | None:
    return None if ms is None else F.floor(F.col(column) / F.lit(ms))


def running_sum(value: Column, *, inclusive: bool = True) -> Running:
    stop = 0 if inclusive else -1
    zero = F.lit(0)
    return Running(
        lambda w, order: F.sum(value).over(w.rowsBetween(FIRST, stop)),
        lambda order: F.sum(value),
        lambda total, w: F.sum(total).over(w.rowsBetween(FIRST, -1)),
        lambda a, b: F.coalesce(a, zero) if b is None else F.coalesce(a, zero) + F.coalesce(b, zero),
    )


def max_before(value: Column, *, inclusive: bool = False) -> Running:
    stop = 0 if inclusive else -1
    return Running(
        lambda w, order: F.max(value).over(w.rowsBetween(FIRST, stop)),
        lambda order: F.max(value),
        lambda total, w: F.max(total).over(w.rowsBetween(FIRST, -1)),
        lambda a, b: a if b is None else F.greatest(a, b),
    )


def min_after(value: Column, *, inclusive: bool = False) -> Running:
    stop = 0 if inclusive else -1
    return Running(
        lambda w, order: F.min(value).over(w.rowsBetween(FIRST, stop)),
        lambda order: F.min(value),
        lambda total, w: F.min(total).over(w.rowsBetween(FIRST, -1)),
        lambda a, b: a if b is None else F.least(a, b),
        backward=True,
    )


def previous(value: Column) -> Running:
    """``lag(value)``, also across block edges."""
    box = F.struct(value.alias("v"))
    return Running(
        lambda w, order: F.lag(box).over(w),
        lambda order: F.max_by(box, order),
        lambda total, w: F.lag(total).over(w),
        lambda a, b: _first_of(a, b)["v"],
    )


def following(value: Column) -> Running:
    """``lead(value)``, also across block edges."""
    box = F.struct(value.alias("v"))
    return Running(
        lambda w, order: F.lead(box).over(w),
        lambda order: F.min_by(box, order),
        lambda total, w: F.lead(total).over(w),
        lambda a, b: _first_of(a, b)["v"],
    )


def latest(value: Column, *, inclusive: bool = True) -> Running:
    """Last non-null value up to this row."""
    stop = 0 if inclusive else -1
    return Running(
        lambda w, order: F.last(value, True).over(w.rowsBetween(FIRST, stop)),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda total, w: F.last(total, True).over(w.rowsBetween(FIRST, -1)),
        lambda a, b: _first_of(a, b),
    )


def upcoming(value: Column, *, inclusive: bool = True) -> Running:
    """First non-null value from this row on."""
    stop = 0 if inclusive else -1
    return Running(
        lambda w, order: F.last(value, True).over(w.rowsBetween(FIRST, stop)),
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        lambda total, w: F.last(total, True).over(w.rowsBetween(FIRST, -1)),
        lambda a, b: _first_of(a, b),
        backward=True,
    )


def _lines(key: list[str], order: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """The rows of a key along ``order``, forward and backward."""
    line = Window.partitionBy(*key)
    return line.orderBy(*order), line.orderBy(*[F.desc(c) for c in order])


def scan(df: DataFrame, key: Sequence[str], order: Sequence[str], block: Column | str | None, /,
         **values: Running) -> DataFrame:
    """Append one column per keyword in ``values``; ``order`` must be total in a key."""
    key, order = list(key), list(order)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    if isinstance(block, str):
        block = by_time(order[0]) if order[0].endswith("_ms") else by_rows(order[0])
    if block is None:
        whole = _lines(key, order)
        return (df.select("*", *[v.inside(whole[v.backward], place).alias(f"_in_{n}") for n, v in values.items()])
                .select(*[F.col(c) for c in df.columns],
                        *[v.merge(F.col(f"_in_{n}"), None).alias(n) for n, v in values.items()]))
    blocked = df.withColumn("_block", block)
    near = _lines([*key, "_block"], order)
    inside = blocked.select(
        "*", *[v.inside(near[v.backward], place).alias(f"_in_{n}") for n, v in values.items()])
    totals = blocked.groupBy(*key, "_block").agg(
        *[v.total(place).alias(f"_t_{n}") for n, v in values.items()])
    far = _lines(key, ["_block"])
    carried = totals.select(
        *key, "_block",
        *[v.across(F.col(f"_t_{n}"), far[v.backward]).alias(f"_c_{n}") for n, v in values.items()])
    joined = inside.join(carried, [*key, "_block"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[v.merge(F.col(f"_in_{n}"), F.col(f"_c_{n}")).alias(n) for n, v in values.items()])


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """``df``, stored, with a column ``_block`` of at most ``rows`` rows that does not decrease along ``order`` in a key.

    Blocks are cut by counts, whatever the values of ``order``: the rows are dealt by ranges of (key, order), sorted,
    and numbered inside their partition. The ranges come from a sample, so the result is stored before it is used.
    """
    place = [*key, *order]
    dealt = df.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_n", F.monotonically_increasing_id())
    within = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    return cut(dealt.withColumn("_block", F.shiftright("_n", 33) * (1 << 20) + F.floor(within / rows)).drop("_n"))


# States and maps of an automaton are written in these letters: letter i of a map is where state i goes.
STATES = "0123456789abcdefghijklmnopqrstuvwxyz"
FAN = 512


def mapping(states: Sequence, goes: Mapping) -> str:
    """Map of ``states``: to ``goes[state]`` where it is given, else nowhere else."""
    return "".join(STATES[states.index(goes.get(s, s))] for s in states)


def join_same(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal values of ``names``, null being a value; the names stay those of ``a``."""
    other, test = b.withColumnsRenamed({n: f"_r_{n}" for n in names}), F.lit(True)
    for n in names:
        test = test & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return a.join(other, test, how).drop(*[f"_r_{n}" for n in names])


def automaton(df: DataFrame, key: Sequence[str], order: Sequence[str], step: Column, start: Column | str, size: int, name: str,
              *, fan: int = FAN) -> DataFrame:
    """Append the state of an automaton before each row; ``step`` is a row's map of ``size`` states, in letters.

    Maps compose, so a long key is no sequential walk: its rows are cut into blocks by counts, the maps of a block are
    composed into one, the states before the blocks come from this function applied to the block maps, and each block
    is then walked from its own start. Keys of at most ``fan`` rows are one block. ``start`` is a letter or a column
    that is equal in a key; ``order`` must be total in a key.
    """
    key, order, letters = list(key), list(order), F.lit(STATES[:size])
    rows = df.select("*", step.alias("_map"), (F.lit(start) if isinstance(start, str) else start).alias("_start"))
    apply = lambda state, r: F.call_function("translate", state, letters, r["_own"]["_map"])
    own = F.struct(*[c for c in rows.columns if c not in key])
    listed = F.array_sort(F.collect_list(F.struct(*order, own.alias("_own")))).alias("_rows")
    longest = rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if longest <= fan:
        held = rows.groupBy(*key).agg(listed)
        entry = F.col("_rows")[0]["_own"]["_start"]
    else:
        blocks = ranked(rows, key, order, fan).groupBy(*key, "_block").agg(listed)
        total = F.aggregate("_rows", letters, apply)
        totals = cut(blocks.select(*key, F.col("_block").alias("_line"), total.alias("_total"), F.col("_rows")[0]["_own"]["_start"].alias("_from")))
        entries = automaton(totals, key, ["_line"], F.col("_total"), F.col("_from"), size, "_entry", fan=fan).select(*key, F.col("_line").alias("_block"), "_entry")
        held = join_same(blocks, entries, [*key, "_block"]).select(*key, "_rows", "_entry")
        entry = F.col("_entry")
    path = F.aggregate("_rows", entry, lambda seen, r: F.concat(seen, apply(F.right(seen, F.lit(1)), r)))
    each = held.select(*key, path.alias("_path"), F.posexplode("_rows").alias("_at", "_r"))
    return each.select(*[F.col(c) if c in key else F.col(f"_r._own.{c}").alias(c) for c in df.columns],
                       F.expr("substring(_path, _at + 1, 1)").alias(name))
