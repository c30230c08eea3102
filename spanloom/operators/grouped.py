"""Sequential rules per group, streamed through a task.

``applyInPandas`` builds one pandas frame per group, which costs milliseconds
for each of millions of small groups. Here Spark shuffles by the group key and
sorts inside the partitions; a task then walks its Arrow batches, finds the
group edges with one vector comparison and hands plain arrays to the rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Rows = dict[str, np.ndarray]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or column.null_count:
        out = np.empty(len(column), dtype=object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def _array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow array of the parts; masked entries and None become null."""
    if any(isinstance(p, np.ma.MaskedArray) for p in parts):
        whole = np.ma.concatenate(parts)
        return pa.array(whole.data, mask=np.ma.getmaskarray(whole), type=kind)
    return pa.array(np.concatenate(parts), type=kind, from_pandas=True)


def _edges(rows: Rows, keys: Sequence[str]) -> np.ndarray:
    size = len(rows[keys[0]])
    changed = np.zeros(max(size - 1, 0), bool)
    for k in keys:
        changed |= rows[k][1:] != rows[k][:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [size]]).astype(int)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               rule: Callable[[Rows], Rows | None], schema: str, *, placed: bool = False) -> DataFrame:
    """Apply ``rule`` to the arrays of each group, rows in ``order``.

    With ``placed`` every group already lies in one partition, as behind a window by these keys, and is not dealt again.
    """
    names, keys = df.columns, list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []

        def emit(groups: list[Rows]) -> Iterator[pa.RecordBatch]:
            made = [r for r in (rule(g) for g in groups) if r is not None]
            if made:
                yield pa.RecordBatch.from_arrays([_array([m[f.name] for m in made], f.type) for f in target], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: _column(batch, n) for n in names}
            if held and any(rows[k][0] != held[-1][k][-1] for k in keys):
                yield from emit([_join(held)])
                held = []
            cuts = _edges(rows, keys)
            pieces = [{n: v[a:b] for n, v in rows.items()} for a, b in zip(cuts[:-1], cuts[1:])]
            if len(pieces) == 1:
                held.append(pieces[0])
                continue
            yield from emit([_join([*held, pieces[0]]), *pieces[1:-1]])
            held = [pieces[-1]]
        if held:
            yield from emit([_join(held)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))
    dealt = df if placed else df.repartition(parts, *keys)
    return (dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema))


def _join(pieces: list[Rows]) -> Rows:
    if len(pieces) == 1:
        return pieces[0]
    return {n: np.concatenate([p[n] for p in pieces]) for n in pieces[0]}
