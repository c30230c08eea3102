"""Vectorised text helpers: many texts as one array of code points.

Python strings of a batch are laid end to end, each closed by a line feed, so
that words, lines and their hashes come from a few array operations per batch
and not from a loop over words. A batch holds about ``BATCH_CHARS`` characters
(one longer text is a batch of its own), so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_CHARS = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of the SplitMix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 2 * BATCH_CHARS)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base & _MASK, np.uint64)
            row[0] = 1
            _tables[name] = np.multiply.accumulate(row)
    return _tables["up"], _tables["down"]


@lru_cache(1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Sums:
    """Polynomial prefix sums of a sequence: the hash of any stretch in one step."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:len(codes)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


@lru_cache(1)
def _small_letters() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


class Block:
    """Code points, words and lines of a batch of texts."""

    def __init__(self, texts: list[str], lower: bool = False):
        self.n = len(texts)
        joined = "\n".join(texts) + "\n" if texts else ""
        self.cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.doc_at = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.doc_at[1:])
        if lower:
            self.cp = _small_letters()[self.cp]
        space = (self.cp == 32) | ((self.cp >= 9) & (self.cp <= 13))
        before = np.ones(len(space), bool)
        before[1:] = space[:-1]
        self.space = space
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)

    @property
    def chars(self) -> Sums:
        if not hasattr(self, "_chars"):
            self._chars = Sums(_letters()[self.cp])
        return self._chars

    @property
    def words(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not hasattr(self, "_words"):
            self._words = self.chars.hash(self.start, self.end)
        return self._words

    @property
    def word_at(self) -> np.ndarray:
        """Number of words before each text, and of all."""
        return np.searchsorted(self.start, self.doc_at)

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each line."""
        end = np.flatnonzero(self.cp == 10)
        start = np.zeros(len(end), np.int64)
        start[1:] = end[:-1] + 1
        return start, end, np.searchsorted(self.doc_at, start, side="right") - 1

    def per_doc(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over each stretch ``at[i]:at[i+1]``."""
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]


def repeated(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, value): whether it occurs twice or more, and whether it occurred earlier."""
    if not len(value):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((value, doc)) if len(doc) else np.zeros(0, np.int64)
    d, v = doc[order], value[order]
    same = np.zeros(len(v), bool)
    same[1:] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out_twice, out_later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    out_twice[order], out_later[order] = twice, same
    return out_twice, out_later


def portions(sizes: Iterable[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` characters."""
    first, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size + 1
    if i >= first:
        yield first, i + 1


def text_portions(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive slices of a batch and their strings, null ones as empty.

    A batch of Arrow holds thousands of texts; only the strings of one slice exist at a time.
    """
    column = batch.column(batch.schema.get_field_index(text))
    for a, b in portions(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).tolist()):
        yield batch.slice(a, b - a), [t or "" for t in column.slice(a, b - a).to_pylist()]


def map_texts(df: DataFrame, function: Callable, schema: str, *, text: str = "text") -> DataFrame:
    """Apply ``function(columns, texts)`` to portions of ``df``'s rows.

    ``columns`` maps each other column to an Arrow array; ``texts`` has the strings, null
    ones as empty. The function returns the columns of ``schema`` in order.
    """
    others = [c for c in df.columns if c != text]

    def run(batches):
        for batch in batches:
            for part, texts in text_portions(batch, text):
                columns = {c: part.column(part.schema.get_field_index(c)) for c in others}
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in function(columns, texts)], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return df.mapInArrow(run, schema)
