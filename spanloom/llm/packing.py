"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

1. A document's ids are cut into whole windows and one remainder. Whole windows are
   sequences of their own.
2. The remainders are packed online. ``levels[h]`` counts the open windows that hold
   ``h`` ids; a piece goes to the level (or to a new window) for which the sum of the
   squared counts is smallest afterwards, ties to the fullest window. That keeps the
   open windows spread over the levels, so a fitting gap is nearly always there.
3. Pieces are dealt to packing groups by a hash; the number of groups follows the number
   of pieces, so one task holds about ``GROUP_PIECES`` rows whatever the input size.

The order within a group is that of a hash of the piece's key, so a task that runs
again after an executor was lost gives the same windows.

Null texts count as empty; an empty document is one piece with the closing id alone.
Repeated rows are packed each; rows with a null doc_id are packed under the null key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

from .chars import map_texts
from .tokens import encoder

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 20_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids)``: each document cut at multiples of ``window``."""
    close = np.array([end_id], "<u4").tobytes()

    def run(columns, texts):
        own = columns["doc_id"]
        row, start, length, total, ids = [], [], [], [], []
        for i, data in enumerate(encoder(tokenizer).encode(texts)):
            data += close
            n = len(data) // 4
            for at in range(0, n, window):
                row.append(i)
                start.append(at)
                length.append(min(window, n - at))
                total.append(n)
                ids.append(data[4 * at:4 * (at + window)])
        return own.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES)


class Packer:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """Window number and offset for a piece of ``size`` ids."""
        b, levels = self.window, self.levels
        if size < b:
            # Change of the sum of squares if the piece is put at level h; a new window is level 0.
            change = 2 * (levels[size:] - levels[:b - size]) + 2
            change[levels[:b - size] == 0] = np.iinfo(np.int64).max
            change[0] = 2 * levels[size] + 1
            fits = b - size
            closing = 1 - 2 * levels[fits] if levels[fits] else np.iinfo(np.int64).max
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if closing <= change[at]:
                at = fits
        else:
            at = 0
        if at:
            number = self.open[at].pop()
            levels[at] -= 1
        else:
            number, self.made = self.made, self.made + 1
        if at + size < b:
            levels[at + size] += 1
            self.open[at + size].append(number)
        return number, at


def place(parts: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; ``parts`` has ``doc_id``, ``start`` and ``length``.

    The rows are counted first, so ``parts`` should be a stored table.
    """
    groups = max(1, -(-parts.count() // group_pieces))
    kept = parts.columns
    dealt = (parts.withColumn("_order", F.xxhash64("doc_id", "start", "length"))
             .withColumn("_group", F.pmod(F.hash("_order"), F.lit(groups))))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in parts.schema] + ["sequence_id long", "offset long"]

    def run(table):
        packer = Packer(window)
        base = table["_group"][0].as_py() << 40
        table = table.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        spots = np.array([packer.put(n) for n in table["length"].to_pylist()], np.int64).reshape(-1, 2)
        return (table.select(kept).append_column("sequence_id", pa.array(spots[:, 0] + base))
                .append_column("offset", pa.array(spots[:, 1])))

    return dealt.groupBy("_group").applyInArrow(run, ", ".join(fields))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset."""
    return place(cut(pieces(docs, tokenizer, window, end_id)), window)


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of a piece's little-endian ids."""
    return F.crc32(ids)
