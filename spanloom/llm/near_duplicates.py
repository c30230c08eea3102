"""Near-duplicate documents by weighted minwise hashing with darts.

Darts are points (element, weight, rank) thrown by hash functions with one dart expected per
unit of weight and rank, each with a coordinate from 0 to ``SIGNATURE - 1``. A weighted set
catches the darts under its elements' weights; the caught dart of least rank is its value at
that coordinate. Two sets agree at a coordinate with the probability of their weighted
Jaccard similarity. A set of total weight ``W`` only looks at ranks below about
``SIGNATURE ln(SIGNATURE) / W``, so the cost follows its size and not size times signature.

1. Equal texts are folded by a 64-bit hash; all later steps see one row per text.
2. Signatures over the set of five-word shingles give ``BANDS`` band values of ``BAND_ROWS``
   coordinates. Texts of a band value are linked to its least text: rows, not pairs.
3. Components of these links are families: every pair that shares a band value is inside one.
4. All pairs of a family are compared exactly, as a product of shingle incidence matrices in
   a task; families above ``FAMILY`` texts are dealt to block pairs, so no task holds more
   than two blocks. Links of at least ``SIMILARITY`` are returned as forests.
5. Components of the links are the classes; a class is named by its least doc_id.

A pair of similarity 0.8 meets in a band with probability 1 - (1 - 0.8^5)^24 > 0.9999.
Texts of fewer than five words have one shingle, of all their words; texts without words are
only equal to equal texts. Null texts are equal to each other. Repeated rows get a row each;
a class whose ids are all null has a null class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

from .chars import Block, Sums, map_texts, mix
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
SIGNATURE = 120
BAND_ROWS = 5
BANDS = SIGNATURE // BAND_ROWS
FAMILY = 512
BLOCK_TEXTS = 256
BIN_TEXTS = 2048
_FINE = 6
_WIDTHS = np.array([4.0 ** -_FINE] + [3 * 4.0 ** -(_FINE + 1 - c) for c in range(1, _FINE + 1)] + [1.0])


def _poisson() -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a cell of each width."""
    rows = [np.cumsum([math.exp(-w) * w ** n / math.factorial(n) for n in range(16)]) for w in _WIDTHS]
    return np.array(rows)


_CUMULATIVE = _poisson()


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def signatures(element: np.ndarray, weight: np.ndarray, at: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """``size`` values of each weighted set ``at[i]:at[i+1]``; elements are distinct within a set.

    Weights are positive; scale them so that a typical one is about 1. Empty sets get zeros.
    """
    n = len(at) - 1
    out = np.zeros((n, size), np.uint64)
    sums = np.concatenate([[0.0], np.cumsum(weight)])
    total = sums[at[1:]] - sums[at[:-1]]
    todo, limit = np.flatnonzero(total > 0), np.zeros(n)
    limit[todo] = (size * math.log(size) + 3 * size) / total[todo]
    while len(todo):
        ready = _throw(element, weight, at, limit, todo, size, out)
        todo = todo[~ready]
        limit[todo] *= 2
    return out


def _throw(element, weight, at, limit, todo, size, out) -> np.ndarray:
    """Fill the signatures of the sets ``todo`` with the darts below their rank limits; whether each is full."""
    count = at[todo + 1] - at[todo]
    index = np.repeat(at[todo], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    local = np.repeat(np.arange(len(todo)), count)
    layers = np.ceil(weight[index]).astype(np.int64)
    cells = np.where(limit[todo] >= 1, _FINE + np.ceil(limit[todo]), np.ceil(np.log(np.maximum(limit[todo], 1e-300)) / math.log(4)) + _FINE + 1).astype(np.int64)
    cells = np.maximum(cells, 1)
    times = layers * cells[local]
    pick = np.repeat(np.arange(len(index)), times)
    step = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
    cell, layer = step % cells[local[pick]], step // cells[local[pick]]
    h = mix(element[index[pick]] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + layer.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    kind, u = np.minimum(cell, _FINE + 1), _unit(h)
    some = np.flatnonzero(u >= _CUMULATIVE[kind, 0])
    darts = (u[some][:, None] >= _CUMULATIVE[kind[some]]).sum(1)
    some = np.repeat(some, darts)
    number = np.arange(len(some)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(h[some] ^ (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    low = np.where(cell[some] == 0, 0.0, np.where(cell[some] <= _FINE, 4.0 ** (kind[some] - _FINE - 1.0), cell[some] - _FINE))
    rank = low + _WIDTHS[kind[some]] * _unit(mix(dart + np.uint64(1)))
    owner = local[pick[some]]
    caught = (rank < limit[todo][owner]) & (layer[some] + _unit(mix(dart + np.uint64(2))) < weight[index[pick[some]]])
    dart, rank, owner = dart[caught], rank[caught], owner[caught]
    slot = owner * size + (mix(dart + np.uint64(3)) % np.uint64(size)).astype(np.int64)
    order = np.lexsort((dart, rank, slot))
    slots, first = np.unique(slot[order], return_index=True)
    flat = np.zeros(len(todo) * size, np.uint64)
    flat[slots] = dart[order][first]
    full = np.bincount(slots // size, minlength=len(todo)) == size
    out[todo[full]] = flat.reshape(len(todo), size)[full]
    return full


def shingles(texts: list[str], weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted; their weights (1, or how often they occur); and bounds."""
    block = Block(texts)
    words, at = block.words, block.word_at
    n = np.diff(at)
    start = np.arange(len(words))
    doc = block.word_doc
    full = start + SHINGLE <= at[doc + 1]
    short = (n[doc] < SHINGLE) & (start == at[doc])
    start = start[full | short]
    doc = doc[full | short]
    value = Sums(words).hash(start, np.minimum(start + SHINGLE, at[doc + 1]))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    weight = np.diff(np.append(first, len(value))).astype(float) if weighted else np.ones(len(first))
    return value[fresh], weight, np.searchsorted(doc[fresh], np.arange(len(texts) + 1))


def sketch(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """``(doc_id, text_hash, bands)`` of every row."""
    def run(columns, texts):
        value, weight, at = shingles(texts, weighted)
        rows = signatures(value, weight, at).reshape(len(texts), BANDS, BAND_ROWS)
        band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), BANDS)).copy()
        for r in range(BAND_ROWS):
            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
        have = np.diff(at) > 0
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(have * BANDS)]), pa.int64()), pa.array(band[have].view(np.int64).ravel()))
        return columns["doc_id"], columns["text_hash"], lists.cast(pa.list_(pa.int64()))

    return map_texts(_hashed(docs), run, "doc_id long, text_hash long, bands array<bigint>")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), text.alias("text"))


def similar(sets: list[np.ndarray], side: np.ndarray | None, least: float) -> np.ndarray:
    """Matrix of the pairs with Jaccard similarity of at least ``least``; of different sides only, if given."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1 if len(flat) else fresh
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, 8192):
        part = slice(*np.searchsorted(column, [a, a + 8192]))
        rows = np.zeros((n, 8192), np.float32)
        rows[owner[part], column[part] - a] = 1
        common += rows @ rows.T
    both = sizes[:, None] + sizes[None, :] - common
    linked = (common >= np.float32(least) * both - 1e-3) & (common > 0)
    return linked if side is None else linked & (side[:, None] != side[None, :])


def _forest(keys: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """``(text, root)`` of each text that is linked to another one."""
    label = np.arange(len(keys))
    reach = linked | np.eye(len(keys), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(keys)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(keys[i]), int(keys[r])) for i, r in enumerate(label) if i != r]


def _compare(least: float):
    """Group function: links of the families, or of the two blocks, that a group holds."""
    def run(table):
        table = table.sort_by([("root", "ascending"), ("side", "ascending"), ("text_hash", "ascending")])
        key, root, side = (table[c].to_numpy() for c in ("text_hash", "root", "side"))
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        edges = []
        bounds = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]]))
        for a, b in zip(bounds, bounds[1:]):
            own = np.concatenate([[True], key[a + 1:b] != key[a:b - 1]])
            rows = np.flatnonzero(own) + a
            two = side[rows]
            edges += _forest(key[rows], similar([sets[i] for i in rows], two if two[0] != two[-1] else None, least))
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return run


def links(docs: DataFrame, sketches: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(a, b)`` text hashes: forests of the links between different texts."""
    members = sketches.select("text_hash", F.explode("bands").alias("band"))
    low = members.groupBy("band").agg(F.min("text_hash").alias("_low"), F.max("text_hash").alias("_high")).filter("_low < _high")
    family = cut(components(members.join(low, "band").filter("text_hash <> _low").select(F.col("text_hash").alias("a"), F.col("_low").alias("b")).distinct()))
    size = family.groupBy("root").agg(F.count("*").alias("_n"))
    total = max(1, -(-family.count() // BIN_TEXTS))
    # One row of each text: that of its least id.
    owner = sketches.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    wanted = family.join(size, "root").join(owner.withColumnRenamed("text_hash", "node"), "node").select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), "root", "_n")
    rows = _hashed(docs)
    texts = rows.join(wanted, (rows["text_hash"] == wanted["_node"]) & rows["doc_id"].eqNullSafe(wanted["_id"])).select("text_hash", "root", "_n", "text")

    def run(columns, texts):
        value, _, at = shingles(texts)
        return columns["text_hash"], columns["root"], columns["_n"], [value[a:b].tobytes() for a, b in zip(at, at[1:])]

    sets = map_texts(texts, run, "text_hash long, root long, _n long, shingles binary")
    blocks = F.ceil(F.col("_n") / BLOCK_TEXTS).cast("int")
    block = F.pmod(F.xxhash64("text_hash"), blocks).cast("int")
    # Families that fit a task share bins; larger ones go to each pair of blocks.
    spots = F.when(F.col("_n") <= FAMILY, F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(total)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.col("root").alias("g"), F.least(x, block).alias("i"), F.greatest(x, block).alias("j"), block.alias("side"))))
    dealt = sets.withColumn("s", F.explode(spots)).select("text_hash", "root", "shingles", "s.g", "s.i", "s.j", "s.side")
    return dealt.groupBy("g", "i", "j").applyInArrow(_compare(least), "a long, b long")


def classes(docs: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``(doc_id, text_hash, class_key, class_id, class_texts)`` of every row; alone in its class: its own id.

    ``class_id`` is the least doc_id of the class, ``class_texts`` its number of different
    texts, ``class_key`` the hash of one of them.
    """
    sketches = cut(sketch(docs, weighted))
    root = components(links(docs, sketches, least))
    texts = sketches.groupBy("text_hash").agg(F.min("doc_id").alias("_least"))
    named = texts.join(root.withColumnRenamed("node", "text_hash"), "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    whole = named.groupBy("root").agg(F.min("_least").alias("class_id"), F.count("*").alias("class_texts"))
    label = named.join(whole, "root").select("text_hash", F.col("root").alias("class_key"), "class_id", "class_texts")
    return sketches.select("doc_id", "text_hash").join(label, "text_hash").select("doc_id", "text_hash", "class_key", "class_id", "class_texts")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class: that of the least id, null ids last; all columns stay."""
    first = classes(docs, least).groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("r"))
    wanted = first.select(F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_want"))
    # The columns of docs travel in one struct, so their names cannot clash with those of the join.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_for"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("_hash"))
    found = rows.join(wanted, F.col("_for").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_want")))
    return found.dropDuplicates(["_for", "_hash"]).select("_row.*")
