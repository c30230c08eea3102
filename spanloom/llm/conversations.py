"""Conversation structure: faults of turns and the cheapest repair of their order.

The rows of all conversations are sorted by ranges of (conversation, turn, role, text digest), so a conversation with a
third of all rows lies in many partitions. What a partition holds of a conversation is a piece. The repair works on one
digit a row (``four_russians``): for each piece the map from the cost vector behind it to the one before it; these maps
composed from the last piece to the first; for each piece the edits from every state it may be entered in; and the
states followed from the first piece to the last. Only the summaries of the pieces of one conversation meet in a task.
Digests of whole conversations are made by a stream over sorted rows that keeps one running hash.

Rules. Null ids, roles and texts: null ``conv_id`` is a conversation of its own, null role or text is one space. Rows are
taken by turn, nulls first; equal turns by role, then by digest of role and text, then by ``copy`` if that column is there.
The first fault of a row counts: blank, duplicate, truncated. Repeated rows are duplicates after the first. Edits: keep 0,
rerole to user or assistant 3, delete 4 (needed for blank and duplicate rows), insert an empty user or assistant turn
3; a truncated row that stays costs 3 more. Of the cheapest edits the ASCII-least string of initials is taken. A role
counts by its first character; an empty one is none that may stay. Very long texts are never cut. Other columns are not read. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import cut

from . import four_russians as fr

PIECE_ROWS = 65_536
INK = r"[^ \t\n\x0B\f\r]"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
SUMMARY = "conv string, " + ", ".join(f"{c} long" for c in COUNTS) + ", repaired_sha256 string"


def _record(**arrays: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in arrays.items()])


def ordered(rows: DataFrame) -> DataFrame:
    """All rows in their order: ``conv, turn, role, text, digest, blank, open, pos``; stored."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / PIECE_ROWS))
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("k"), F.col("conv_id").cast("string")))
    copy = F.col("copy").cast("long") if "copy" in rows.columns else F.lit(0).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copy.alias("copy"))
    last = F.regexp_extract("text", rf"({INK})[ \t\n\x0B\f\r]*\z", 1)
    plain = plain.select("*", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest"),
                         (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    keys = ["conv", "turn", "role", "digest", "copy"]
    return cut(plain.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("copy").withColumn("pos", F.monotonically_increasing_id()))


def marked(rows: DataFrame) -> DataFrame:
    """``conv, pos, fault`` and the digit of each row of ``ordered``; stored."""
    slim = rows.select("conv", "pos", "digest", "blank", "open", F.substring("role", 1, 1).alias("initial"))
    first = slim.groupBy("conv", "digest").agg(F.min("pos").alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise(""))
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 4).otherwise(6)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), fr.GONE).otherwise(role + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    return cut(slim.join(first, ["conv", "digest"]).withColumn("fault", fault).select("conv", "pos", "fault", symbol.cast("string").alias("symbol")))


@F.pandas_udf(_record(to=T.IntegerType(), add=T.LongType()))
def _transfers(symbols: pd.Series) -> pd.DataFrame:
    made = [fr.transfer(s) for s in symbols]
    return pd.DataFrame({"to": [m[0] for m in made], "add": [m[1] for m in made]})


@F.udf(T.StructType([T.StructField("cost", T.LongType()), T.StructField("rights", T.ArrayType(T.IntegerType()))]), useArrow=True)
def _rights(pieces):
    """Vector behind each piece, from the last piece to the first, and the cost of the whole conversation."""
    now, cost, out = 0, 0, []
    for piece in reversed(pieces):
        out.append(now)
        cost += piece["add"][now]
        now = piece["to"][now]
    return int(cost + fr.tables()[0][now][0]), out[::-1]


@F.udf(_record(made=T.StringType(), exits=T.IntegerType()), useArrow=True)
def _traces(symbols, behind, first, last):
    """Edits and exit state of a piece for each state it can be entered in."""
    found = [fr.trace(symbols, behind, state, last) for state in ([0] if first else range(4))]
    return [f[0] for f in found], [f[1] for f in found]


@F.udf(T.ArrayType(T.IntegerType()), useArrow=True)
def _entries(pieces):
    now, out = 0, []
    for piece in pieces:
        out.append(now)
        now = piece["exits"][now]
    return out


def edits(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edit letters of every piece (``conv, piece, places, made``) and the cost of every conversation (``conv, cost``)."""
    row = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    pieces = cut(marks.groupBy("conv", F.shiftright("pos", 33).alias("piece")).agg(row.alias("rows")).select(
        "conv", "piece", F.col("rows.pos").alias("places"), F.array_join("rows.symbol", "").alias("symbols")))
    listed = lambda *c: F.array_sort(F.collect_list(F.struct("piece", *c)))
    maps = pieces.select("conv", "piece", _transfers("symbols").alias("m")).select("conv", "piece", "m.*")
    whole = cut(maps.groupBy("conv").agg(listed("to", "add").alias("p")).select("conv", F.col("p.piece").alias("pieces"), _rights("p").alias("r")).select("conv", "pieces", "r.*"))
    at = whole.select("conv", F.size("pieces").alias("n"), F.posexplode(F.arrays_zip("pieces", "rights")).alias("i", "z"))
    behind = at.select("conv", F.col("z.pieces").alias("piece"), F.col("z.rights").alias("behind"), (F.col("i") == 0).alias("first"), (F.col("i") == F.col("n") - 1).alias("last"))
    traced = cut(pieces.join(behind, ["conv", "piece"]).select("conv", "piece", "places", _traces("symbols", "behind", "first", "last").alias("t")).select("conv", "piece", "places", "t.*"))
    ways = traced.groupBy("conv").agg(listed("exits").alias("p")).select("conv", F.arrays_zip(F.col("p.piece").alias("piece"), _entries("p").alias("entry")).alias("z"))
    entry = ways.select("conv", F.explode("z").alias("z")).select("conv", "z.piece", "z.entry")
    chosen = traced.join(entry, ["conv", "piece"]).select("conv", "piece", "places", F.get("made", F.col("entry")).alias("made"))
    return cut(chosen), whole.select("conv", "cost")


def edited(rows: DataFrame, made: DataFrame) -> DataFrame:
    """The rows of ``ordered`` with their edit letters: inserts before the row, the row's own, inserts behind the last row."""
    own = F.regexp_extract_all("made", F.lit(r"[UA]*[uakd](?:[UA]+$)?"), 0)
    return rows.join(made.select(F.explode(F.arrays_zip("places", own.alias("edit"))).alias("z")).select(F.col("z.places").alias("pos"), "z.edit"), "pos")


def _turns() -> Column:
    """Repaired turns that come from a row, in order."""
    role = lambda c: F.when(c.isin("u", "U"), "user").when(c.isin("a", "A"), "assistant").otherwise(F.col("role"))
    return F.transform(F.filter(F.split("edit", ""), lambda c: (c != "d") & (c != "")), lambda c: F.struct(
        role(c).alias("role"), F.when(c.isin("U", "A"), "").otherwise(F.col("text")).alias("text"), c.isin("U", "A").alias("inserted")))


def repair(rows: DataFrame) -> DataFrame:
    """Repaired turns: ``conv_id, pos, part, role, text, inserted``, in the order of ``pos`` and ``part``."""
    table = ordered(rows)
    made, _ = edits(marked(table))
    turns = edited(table, made).select("conv", "pos", F.posexplode(_turns()).alias("part", "t")).select("conv", "pos", "part", "t.*")
    conv_id = F.when(F.col("conv") != "n", F.expr("substring(conv, 2)")).cast(rows.schema["conv_id"].dataType)
    return turns.select(conv_id.alias("conv_id"), "pos", "part", "role", "text", "inserted")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digest of each conversation of a task, whose rows come in order; one running hash is kept."""
    now, out = None, []

    def closed() -> tuple:
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        return now, gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["hash"].hexdigest()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv", *COUNTS, "repaired_sha256"])

    for batch in batches:
        for conv, turn, initial, fault, lines in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "lines"))):
            if conv != now:
                if now is not None:
                    out.append(closed())
                now = conv
                state = {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "hash": hashlib.sha256(), "some": False, "role": None}
            if turn is not None:
                state["low"] = turn if state["low"] is None else state["low"]
                state["turns"] += turn != state["high"]
                state["high"] = turn
            if fault:
                state[fault] += 1
            if state["role"] is not None:
                state["illegal"] += state["role"] + initial not in ("su", "ua", "au")
            state["role"] = initial
            if lines is not None:
                if state["some"]:
                    state["hash"].update(b"\n")
                state["some"] = True
                state["hash"].update(lines.encode())
        if out:
            yield batch_of(out)
            out = []
    if now is not None:
        yield batch_of([closed()])


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation with rows: ``conv``, counts of faults, cost, audit and the digest of the repaired turns."""
    table = ordered(rows)
    marks = marked(table)
    made, costs = edits(marks)
    turns = _turns()
    lines = F.when(F.size(turns) > 0, F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    stream = edited(table, made).join(marks.select("pos", "fault"), "pos").select(
        "conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault", lines.alias("lines"))
    counted = stream.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_summaries, SUMMARY)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "made"))), lambda p: p["made"]), "")
    audits = made.groupBy("conv").agg(F.translate(letters, "UAuakd", "IIRRKD").alias("audit"))
    return counted.join(costs, "conv").join(audits, "conv")
