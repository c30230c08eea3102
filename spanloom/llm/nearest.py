"""Approximate nearest neighbours by inner product: one small-world graph per shard, shard results merged.

Rows are dealt to shards by a hash of their id. A shard's distinct vectors become a graph (``hnsw``); copies of a
vector share a node, however many they are, and are read back when a node is found. The index is a table: flat arrays
of ids, vectors, levels and neighbours, one row per shard. Queries come in blocks of bounded size, broadcast one at a
time; every shard answers with its best ``k`` candidates, scored exactly, and the merge keeps the best ``k`` of all.

Shards hold at most ``MOST`` rows, so a task's graph stays below 200 MB, and at least ``LEAST`` unless the table is
smaller; between them there are ``SHARDS`` shards. Fewer rows than a search's width are compared one by one.

Rules. The score is the inner product in double precision, added up from the first component to the last; ties go to
the smaller id. Rows with a null id or vector, a vector of zeros only, or a null or non-finite component take no part.
A query meets only vectors of its own length. Rows that repeat an id and vector count once; rows that share only
the id all count, and none of them is a candidate of a query with that id. Queries that share only the id are answered together: the best
score of a candidate counts. Other columns are not read. No rows in, no rows out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut

from . import hnsw
from .vectors import BLOCK_BYTES, block_column, matrices, usable

K, WIDTH = 20, 32
LEAST, MOST, SHARDS = 4096, 131_072, 12
PORTION = 512
ARRAYS = ("ids", "node_ends", "vectors", "level_sizes", "neighbours")
INDEX = ", ".join(["shard int", "size int", *(f"{n} binary" for n in ARRAYS)])
FLAT = pa.schema([("shard", pa.int32()), ("size", pa.int32()), *((n, pa.binary()) for n in ARRAYS)])
HITS = "query_id long, vec_id long, score double"


def _graph_row(shard: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Flat arrays of one shard and vector length."""
    order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    new = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
    node = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # A node's level comes from the least id that has its vector.
    marks = (ids[first].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    marks ^= marks >> np.uint64(29)
    marks *= np.uint64(0xBF58476D1CE4E5B9)
    level = hnsw.levels(marks ^ (marks >> np.uint64(32)))
    rank = np.argsort(-level, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    graph = hnsw.build(hnsw.augmented(vectors[first])[rank], level[rank])
    by_node = np.lexsort((ids, place[node]))
    ends = np.cumsum(np.bincount(place[node], minlength=len(first)))
    return {"shard": shard, "size": vectors.shape[1], "ids": ids[by_node].tobytes(), "node_ends": ends.astype(np.int64).tobytes(),
            "vectors": vectors[first][rank].astype(np.float64).tobytes(), "level_sizes": np.array([len(l) for l in graph.layers], np.int32).tobytes(),
            "neighbours": b"".join(l.astype(np.int32).tobytes() for l in graph.layers)}


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Graphs of the shards of a task, whose rows come sorted by shard; one shard is held at a time."""
    def graphs(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = rows.column("id").to_numpy()
        for at, matrix in matrices(rows.column("vector")):
            yield pa.RecordBatch.from_pylist([_graph_row(shard, ids[at], matrix)], schema=FLAT)

    held, now = [], None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(shards))
        for a, b in zip(edges[:-1], edges[1:]):
            if held and shards[a] != now:
                yield from graphs(now, held)
                held = []
            now = int(shards[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from graphs(now, held)


def index(rows: DataFrame, *, least: int = LEAST, most: int = MOST, shards: int = SHARDS) -> DataFrame:
    """One row per shard and vector length with its graph as flat arrays; ``rows`` has ``vec_id`` and ``embedding``."""
    part = _taking_part(rows)
    count = part.count()
    number = max(1, math.ceil(count / min(max(least, math.ceil(count / shards)), most)))
    dealt = part.distinct().withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(number)).cast("int"))
    return cut(dealt.repartitionByRange(number, "shard").sortWithinPartitions("shard").mapInArrow(_build, INDEX))


def _taking_part(rows: DataFrame) -> DataFrame:
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & usable("embedding")).where(some).select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, components added from the first to the last."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        total += a[:, c] * b[:, c]
    return total


def _answer(row: dict, ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of the best ``k`` candidates of a shard for each query."""
    read = lambda name, kind: np.frombuffer(row[name], kind)
    ends, own, size = read("node_ends", np.int64), read("ids", np.int64), row["size"]
    vectors = read("vectors", np.float64).reshape(len(ends), size)
    flat, layers = read("neighbours", np.int32), []
    for l, n in enumerate(read("level_sizes", np.int32)):
        columns = (2 if l == 0 else 1) * hnsw.LINKS + 1
        layers.append(flat[:n * columns].reshape(n, columns))
        flat = flat[n * columns:]
    graph = hnsw.Graph(hnsw.augmented(vectors), layers)
    begins, out = np.append(0, ends[:-1]), []
    for at in range(0, len(ids), PORTION):
        some = queries[at:at + PORTION]
        scaled = (some / np.maximum(np.abs(some).max(1, keepdims=True), 1e-300)).astype(np.float32)
        found = graph.search(np.concatenate([scaled, np.zeros((len(some), 1), np.float32)], 1), max(width, k + 1))
        q, c = np.nonzero(found >= 0)
        node = found[q, c]
        score = _exact(some[q], vectors[node])
        # The first copies of a node by id are enough: one of them may be the query itself.
        times = np.minimum(ends[node] - begins[node], k + 1)
        q, score = np.repeat(q, times), np.repeat(score, times)
        place = np.repeat(begins[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = own[place] != ids[at:at + PORTION][q]
        q, score, who = q[other], score[other], own[place][other]
        order = np.lexsort((who, -score, q))
        edge = np.flatnonzero(np.diff(q[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(edge, np.diff(np.append(edge, len(order))))
        best = order[rank < k]
        out.append((q[best] + at, who[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(shards: DataFrame, rows: DataFrame, is_query: Column, *, k: int = K, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best ``k`` candidates found for each row of ``rows`` that ``is_query`` marks: ``query_id, rank, vec_id, score``."""
    spark = rows.sparkSession
    queries, blocks = block_column(_taking_part(rows.where(is_query)).distinct(), "vector", ["id"], block_bytes)
    queries, hits, number = cut(queries), None, max(1, shards.count())

    def answers(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["size"] in shared.value:
                        ids, vectors = shared.value[row["size"]]
                        at, who, score = _answer(row, ids, vectors, k, width)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(who), pa.array(score)], ["query_id", "vec_id", "score"])
        return run

    for b in range(blocks):
        block = queries.where(F.col("block") == b).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids = block.column("id").to_numpy()
        shared = spark.sparkContext.broadcast({m.shape[1]: (ids[at], m) for at, m in matrices(block.column("vector"))})
        # One index row is a task's work: a task per row, whatever its file.
        tasks = shards.select("shard", "size", *ARRAYS).repartitionByRange(number, "shard", "size")
        part = cut(tasks.mapInArrow(answers(shared), HITS))
        hits = part if hits is None else hits.unionByName(part)
        shared.unpersist()
    if hits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
