"""Benchmark passages in documents: q-gram lemma filter, then banded alignment.

Texts are compared by their letters and digits in lower case, so case, punctuation and
white space do not hide a passage. A stretch of ``REGION`` characters of an item (or the
whole of a shorter item) with at most ``k`` edits shares at least ``REGION + 1 - q (k + 1)``
q-grams with its copy, on diagonals that differ by at most ``k``:

1. q-grams of a document that occur in the benchmark are looked up in a hashed table;
2. they are counted per document, item and diagonal band; bands are ``2 (k + 1)`` wide and
   start every ``k + 1`` diagonals, so every such set of diagonals lies in one of them;
3. where ``REGION`` characters of an item hold enough q-grams in one band, all windows of
   the item that hold them are aligned with the document inside the band; at most ``k``
   edits are a match.

A passage that covers ``REGION`` characters of an item is thus always found. The benchmark is the stated query set: it is sent to the tasks in blocks of at most about
``BLOCK_CHARS`` characters (an item is never split), one pass over the documents each.

Null and empty texts match nothing; so do items with fewer than ``Q`` letters and digits.
Items with equal texts are all reported. Repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import Block, Sums, _letters, map_texts, text_portions

Q = 8
REGION = 64
EDIT_RATE = 0.08
STRIDE = 8
BLOCK_CHARS = 4_000_000
_BITS = 22
_tables: dict[str, np.ndarray] = {}


def _kept() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    if "kept" not in _tables:
        table = np.zeros(0x110000, bool)
        for c in range(0x30000):
            table[c] = chr(c).isalnum()
        _tables["kept"] = table
    return _tables["kept"]


class Letters:
    """Letters and digits of a batch of texts, with their places in the texts."""

    def __init__(self, texts: list[str]):
        block = Block(texts, lower=True)
        self.place = np.flatnonzero(_kept()[block.cp])
        self.code = block.cp[self.place]
        self.at = np.searchsorted(self.place, block.doc_at)
        self.doc_at = block.doc_at
        self.doc = np.repeat(np.arange(block.n), np.diff(self.at))

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each q-gram inside one text."""
        start = np.arange(max(len(self.code) - q + 1, 0))
        start = start[self.doc[start] == self.doc[start + q - 1]] if len(start) else start
        return start, Sums(_letters()[self.code]).hash(start, start + q)


@dataclass
class Index:
    """Benchmark items as letters, and where each q-gram occurs in them."""

    item: np.ndarray
    code: np.ndarray
    at: np.ndarray
    present: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    where: np.ndarray
    q: int
    region: int
    rate: float

    @classmethod
    def build(cls, items: list[tuple[int, str]], q: int, region: int, rate: float) -> "Index":
        letters = Letters([t for _, t in items])
        start, value = letters.grams(q)
        order = np.argsort(value, kind="stable")
        gram, first = np.unique(value[order], return_index=True)
        present = np.zeros(1 << _BITS, bool)
        present[gram & np.uint64((1 << _BITS) - 1)] = True
        return cls(np.array([i for i, _ in items], np.int64), letters.code, letters.at, present, gram, np.append(first, len(order)), start[order], q, region, rate)

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """``(item, start, end)`` of the verified regions of each text, by item and place."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        letters = Letters(texts)
        start, value = letters.grams(self.q)
        maybe = self.present[value & np.uint64((1 << _BITS) - 1)]
        start, value = start[maybe], value[maybe]
        at = np.minimum(np.searchsorted(self.gram, value), max(len(self.gram) - 1, 0))
        hit = self.gram[at] == value if len(self.gram) else np.zeros(0, bool)
        start, at = start[hit], at[hit]
        times = self.first[at + 1] - self.first[at]
        pos = np.repeat(start, times)
        if not len(pos):
            return out
        step = np.arange(len(pos)) - np.repeat(np.cumsum(times) - times, times)
        spot = self.where[np.repeat(self.first[at], times) + step]
        owner = np.searchsorted(self.at, spot, side="right") - 1
        for length in np.unique(np.minimum(np.diff(self.at)[owner], self.region)):
            own = np.minimum(np.diff(self.at)[owner], self.region) == length
            for doc, item, a, b in self._verified(letters, pos[own], spot[own], owner[own], int(length)):
                out[doc].append((int(self.item[item]), a, b))
        return [_merged(x) for x in out]

    def _verified(self, letters: Letters, pos, spot, owner, length: int):
        """Regions for items whose windows have ``length`` characters."""
        k = int(self.rate * length)
        bound = max(length + 1 - self.q * (k + 1), 1)
        doc = letters.doc[pos]
        diagonal = pos - spot
        low = diagonal.min()
        band = (diagonal - low) // (k + 1)
        doc, owner, spot, band = (np.concatenate([x, x]) for x in (doc, owner, spot, band))
        band[len(pos):] -= 1
        order = np.lexsort((spot, band, owner, doc))
        doc, owner, spot, band = doc[order], owner[order], spot[order], band[order]
        same = np.zeros(len(spot), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (owner[1:] == owner[:-1]) & (band[1:] == band[:-1])
        fresh = ~same
        fresh[1:] |= spot[1:] != spot[:-1]
        doc, owner, spot, band, group = doc[fresh], owner[fresh], spot[fresh], band[fresh], np.cumsum(~same)[fresh]
        last = np.arange(len(spot)) + bound - 1
        last = last[last < len(spot)]
        n = len(last)
        good = np.flatnonzero((group[:n] == group[last]) & (spot[last] - spot[:n] <= length - self.q))
        if not len(good):
            return
        # Windows of the item that hold all q-grams of such a set.
        lo = np.maximum(spot[last[good]] + self.q - length, self.at[owner[good]])
        hi = np.minimum(spot[good], self.at[owner[good] + 1] - length)
        times = hi - lo + 1
        pick = np.repeat(np.arange(len(good)), times)
        window = lo[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
        keys = np.unique(np.column_stack([doc[good][pick], owner[good][pick], band[good][pick], window]), axis=0)
        for part in np.array_split(keys, max(1, len(keys) // 4096)):
            d, o, b, w = part.T
            edits, end = self._align(letters, d, w, low + b * (k + 1), k, length)
            for i in np.flatnonzero(edits <= k):
                a = int(np.clip(end[i] - length, letters.at[d[i]], end[i] - 1))
                shift = letters.doc_at[d[i]]
                yield int(d[i]), int(o[i]), int(letters.place[a] - shift), int(letters.place[end[i] - 1] + 1 - shift)

    def _align(self, letters: Letters, doc, window, diagonal, k: int, length: int):
        """Edits between an item's window and the best stretch of the text within the band, and its end."""
        width = 2 * (k + 1) + 2 * k + 1
        offset = np.arange(width)
        left, right = letters.at[doc][:, None], letters.at[doc + 1][:, None]
        place = window[:, None] + diagonal[:, None] - k + offset
        cost = np.where((place >= left) & (place <= right), 0, 10 ** 6)
        for r in range(length):
            inside = (place >= left) & (place < right)
            same = (letters.code[np.clip(place, 0, len(letters.code) - 1)] == self.code[window + r][:, None]) & inside
            across = cost + ~same + np.where(inside, 0, 10 ** 6)
            across[:, :-1] = np.minimum(across[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(across - offset, axis=1) + offset
            place = place + 1
        best = cost.argmin(1)
        rows = np.arange(len(doc))
        return cost[rows, best], np.clip(place[rows, best], left[:, 0] + 1, right[:, 0])


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping regions of one item joined."""
    out: list[tuple[int, int, int]] = []
    for item, a, b in sorted(found):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((item, a, b))
    return out


def indexes(benchmark: DataFrame, q: int = Q, region: int = REGION, rate: float = EDIT_RATE) -> list:
    """Broadcast indexes of the benchmark's blocks; ``benchmark`` has ``item_id`` and ``text``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = []
    for block in range(blocks):
        rows = sorted((r["item_id"], r["text"]) for r in dealt.filter(F.col("_block") == block).collect())
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index.build(rows, q, region, rate)))
    return out


REGIONS = "array<struct<item_id:bigint,start:bigint,end:bigint>>"


def find(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, regions)`` of every row: item and code points of each matching region."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(index) -> DataFrame:
        def run(columns, texts):
            found = index.value.matches(texts)
            return columns["doc_id"], columns["_text"], pa.array([[{"item_id": i, "start": a, "end": b} for i, a, b in x] for x in found], kind)
        return map_texts(rows, run, f"doc_id long, _text long, regions {REGIONS}")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("_text"), F.col("text").cast("string").alias("text"))
    parts = [scan(i) for i in indexes(benchmark, **options)]
    if len(parts) == 1:
        return parts[0].drop("_text")
    # Each pass has every row once; the sets of regions of a row's passes are put together.
    more = parts[1].filter(F.size("regions") > 0)
    for part in parts[2:]:
        more = more.unionByName(part.filter(F.size("regions") > 0))
    more = more.groupBy("doc_id", "_text").agg(F.flatten(F.collect_set("regions")).alias("_more")).withColumnsRenamed({"doc_id": "_id", "_text": "_key"})
    joined = parts[0].join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    return joined.select("doc_id", F.array_sort(F.concat("regions", F.coalesce("_more", F.array().cast(REGIONS)))).alias("regions"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, whose texts hold no region of the benchmark."""
    def keep(table: DataFrame, index) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part, texts in text_portions(batch):
                    yield part.filter(pa.array([not m for m in index.value.matches(texts)], pa.bool_()))

        return table.mapInArrow(run, docs.schema)

    for index in indexes(benchmark, **options):
        docs = keep(docs, index)
    return docs
