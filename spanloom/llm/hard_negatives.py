"""Hard negatives by a secondary-sort shuffle.

Pair scores are packed into keys (anchor, descending score, positives first, id). Spark deals the keys to tasks by
their anchor and sorts them inside the partitions (the DataFrame form of ``repartitionAndSortWithinPartitions``); an
iterator then walks the sorted keys. A row of the anchor's label opens a window below its own score, a row of another
label is emitted for every open window that holds its score. The iterator keeps the at most ``positives`` windows of
one anchor, never the anchor's pairs.

Which pairs enter the shuffle: of the rows of its label a task sends the first ``positives`` of every anchor, of the
others the first ``negatives`` of every window. A pair left out has that many better ones in its own task, so the
answer stays exact, and the shuffle grows with anchors times tasks instead of anchors times rows. The windows are
known after a first pass, which finds the positives.

Rules. Scores are integer inner products of ``floor(256 * x)``; ties go to the smaller id. Rows with a null id, label
or vector, or with a null or non-finite component, take no part. Vectors of another length than the anchor's are no
partners of it. Anchors that repeat a row are one anchor; anchors that share only the id are anchors of their own. A
row with the anchor's id is never its partner; any other repeated row counts by itself. Scores outside 64 bits are set
to the nearest 64-bit number. Other columns, whatever their names, are not read. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut

from .vectors import BLOCK_BYTES, block_column, matrices, usable

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
ROWS = 1024
PAIR = "anchor long, twin int, key binary"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FIRST, LAST = -(1 << 63), (1 << 63) - 1
# Numbers of the packed key, most significant byte first, so that keys sort as byte strings.
KEY = np.dtype([("anchor", ">u8"), ("twin", ">u4"), ("score", ">u8"), ("other", "u1"), ("id", ">u8")])


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(x.astype(np.float64) * 256)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` with all rows of ``b``.

    No partial sum exceeds the product of two norms; while that is below the mantissa, floating point is exact.
    """
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    with np.errstate(over="ignore"):
        bound = np.sqrt((a * a).sum(1).max() * (b * b).sum(1).max())
    if bound < 1 << 23:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 1 << 52:
        return a @ b.T
    whole = lambda m: [[int(v) for v in r] for r in m]
    return np.array([[min(max(sum(x * y for x, y in zip(p, q)), FIRST), LAST) for q in whole(b)] for p in whole(a)], dtype=np.int64)


def _ahead(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of every group, by descending score, then by id."""
    order = np.lexsort((ids, -scores, groups))
    edge = np.flatnonzero(np.diff(groups[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(edge, np.diff(np.append(edge, len(order))))
    return order[rank < k]


class _First:
    """The first ``k`` (score, id, row) of each of ``n`` groups, kept over many batches."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.bar = k, least
        self.groups, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        groups, scores, ids = (np.concatenate(p) for p in ((self.groups, groups), (self.scores, scores), (self.ids, ids)))
        keep = _ahead(groups, scores, ids, self.k)
        self.groups, self.scores, self.ids = groups[keep], scores[keep], ids[keep]
        full, counts = np.unique(self.groups, return_counts=True)
        ends = np.cumsum(counts)[counts == self.k] - 1
        self.bar[full[counts == self.k]] = self.scores[ends]


def _packed(anchors: dict, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, other: int) -> pa.RecordBatch:
    flip = np.uint64(1 << 63)
    keys = np.empty(len(at), KEY)
    keys["anchor"] = anchors["id"][at].astype(np.uint64) ^ flip
    keys["twin"] = anchors["twin"][at]
    keys["score"] = ~(scores.astype(np.int64).astype(np.uint64) ^ flip)
    keys["other"] = other
    keys["id"] = ids.astype(np.int64).astype(np.uint64) ^ flip
    packed = pa.Array.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(anchors["id"][at]), pa.array(anchors["twin"][at].astype(np.int32)), packed], ["anchor", "twin", "key"])


def _walk_rows(batches: Iterator[pa.RecordBatch], anchors: dict[int, dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Vector length, scores of all its anchors, ids and labels, for portions of rows."""
    for batch in batches:
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for rows, matrix in matrices(batch.column(2)):
            if matrix.shape[1] not in anchors:
                continue
            for at in range(0, len(rows), ROWS):
                part = rows[at:at + ROWS]
                yield matrix.shape[1], products(anchors[matrix.shape[1]]["vectors"], quantised(matrix[at:at + ROWS])), ids[part], labels[part]


def _nearest(blocks: Broadcast, k: int):
    """First pass: the first ``k`` rows of the anchor's label in the rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held = blocks.value, {}
        for size, scores, ids, labels in _walk_rows(batches, anchors):
            a = anchors[size]
            if size not in held:
                held[size] = _First(len(a["id"]), k, np.full(len(a["id"]), FIRST, np.int64))
            fits = (labels == a["label"][:, None]) & (ids != a["id"][:, None]) & (scores >= held[size].bar[:, None])
            at, row = np.nonzero(fits)
            held[size].add(at, scores[at, row].astype(np.int64), ids[row])
        for size, h in held.items():
            yield _packed(anchors[size], h.groups, h.scores, h.ids, 0)

    return run


def _windows(blocks: Broadcast, k: int):
    """Second pass: the first ``k`` rows of other labels in each window, from the rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held = blocks.value, {}
        for size, scores, ids, labels in _walk_rows(batches, anchors):
            a = anchors[size]
            n, width = a["low"].shape
            if size not in held:
                held[size] = _First(n * width, k, a["low"].reshape(-1).copy())
            others = (labels != a["label"][:, None]) & (ids != a["id"][:, None])
            bars, found = held[size].bar.reshape(n, width), []
            for j in range(width):
                at, row = np.nonzero(others & (scores >= bars[:, j, None]) & (scores <= a["high"][:, j, None]))
                found.append((at * width + j, scores[at, row].astype(np.int64), ids[row]))
            held[size].add(*(np.concatenate(x) for x in zip(*found)))
        for size, h in held.items():
            # A row can stand in several windows of its anchor; its pair is sent once for as often as it is a row.
            width = anchors[size]["low"].shape[1]
            rows = np.stack([h.groups // width, h.scores, h.ids], 1)
            kinds, inverse = np.unique(rows, axis=0, return_inverse=True)
            times = np.zeros(len(kinds), np.int64)
            for j in range(width):
                times = np.maximum(times, np.bincount(inverse.reshape(-1)[h.groups % width == j], minlength=len(kinds)))
            kinds = np.repeat(kinds, times, axis=0)
            yield _packed(anchors[size], kinds[:, 0], kinds[:, 1], kinds[:, 2], 1)

    return run


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)
    flip = np.uint64(1 << 63)
    back = lambda v: (v.astype(np.uint64) ^ flip).astype(np.int64)
    return back(keys["anchor"]), keys["twin"].astype(np.int64), back(~keys["score"].astype(np.uint64)), keys["other"], back(keys["id"])


def windows_of(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Walk sorted pairs: rows of the label open windows, other rows go to the windows that hold their score."""
    now, opened, out = None, [], []
    for batch in batches:
        for anchor, twin, score, other, row in zip(*(c.tolist() for c in _unpacked(batch))):
            if (anchor, twin) != now:
                now, opened = (anchor, twin), []
            if not other:
                if len(opened) < positives:
                    opened.append([row, score, 0])
                continue
            for window in opened:
                if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                    window[2] += 1
                    out.append((anchor, window[0], window[2], row, window[1], score))
        if out:
            yield _found(out)
            out = []


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _anchor_arrays(rows: pa.Table, low: int, high: int) -> dict[int, dict]:
    """Arrays of one block of anchors by vector length, with the score windows of their positives."""
    rows, out = rows.combine_chunks(), {}
    if not rows.num_rows:
        return out
    ids, twins, labels = (rows.column(n).to_numpy() for n in ("anchor", "twin", "label"))
    scores = rows.column("scores").to_pylist() if "scores" in rows.column_names else None
    for at, matrix in matrices(rows.column("vector")):
        one = {"id": ids[at], "twin": twins[at], "label": labels[at], "vectors": quantised(matrix)}
        if scores is not None:
            width = max(len(scores[i]) for i in at)
            one["low"], one["high"] = np.full((len(at), width), LAST, np.int64), np.full((len(at), width), FIRST, np.int64)
            for n, i in enumerate(at):
                for j, s in enumerate(scores[i]):
                    one["low"][n, j], one["high"][n, j] = -(-low * s // 100), high * s // 100
        out[matrix.shape[1]] = one
    return out


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor and each of its first positives, the first rows of other labels in the score window.

    ``rows`` has ``vec_id``, ``label`` and ``embedding``; ``low`` and ``high`` bound a window in percent of the
    positive's score. Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = rows.sparkSession
    part = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    all_rows = part.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    twin = Window.partitionBy("anchor").orderBy("label", "vector")
    anchors = (part.where(is_anchor).select(F.col("vec_id").cast("long").alias("anchor"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
               .distinct().withColumn("twin", F.row_number().over(twin) - 1))
    anchors, blocks = block_column(anchors, "vector", ["anchor"], block_bytes)
    anchors = cut(anchors)

    def passes(table: DataFrame, work, k: int) -> DataFrame | None:
        """One pass over all rows for each block of anchors; every pass is stored, its broadcast released."""
        done = None
        for b in range(blocks):
            shared = spark.sparkContext.broadcast(_anchor_arrays(table.where(F.col("block") == b).drop("block").toArrow(), low, high))
            part = cut(all_rows.mapInArrow(work(shared, k), PAIR))
            done = part if done is None else done.unionByName(part)
            shared.unpersist()
        return done

    same = passes(anchors, _nearest, positives)
    if same is None:
        return spark.createDataFrame([], FOUND)
    # Keys of one anchor sort by descending score, then id: the least keys are its positives.
    order = Window.partitionBy("anchor", "twin").orderBy("key")
    score = F.conv(F.hex(F.substring("key", 13, 8)), 16, 10).cast("decimal(20,0)")
    # The packed score counts down from the largest number.
    value = (F.lit(LAST).cast("decimal(20,0)") - score).cast("long")
    first = same.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).groupBy("anchor", "twin").agg(F.array_sort(F.collect_list(value)).alias("scores"))
    other = passes(cut(anchors.join(first, ["anchor", "twin"])), _windows, negatives)
    pairs = same.unionByName(other).repartition("anchor", "twin").sortWithinPartitions("anchor", "twin", "key")
    return pairs.mapInArrow(lambda batches: windows_of(batches, positives, negatives, low, high), FOUND)
