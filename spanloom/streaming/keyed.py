"""Rules per key over micro-batches that may bring rows late, twice or in any order.

Spark's stateful operators follow arrival: a row behind the watermark is dropped, and a row with an older place than
its key's state gets a wrong neighbour. Here a micro-batch works on tables in one folder of its own instead:

* ``out``: what each batch said about (key, place), dealt to buckets of keys; the last batch that spoke counts;
* ``state``: per key its last place and what the rule carries on from there, in two slots used in turn;
* ``late``: the rows that came behind their key's last place.

Rows of keys without late rows are computed from the carried state alone. For keys with late rows the rule runs again
over all their rows, read from their buckets, and what changes is said again. A batch that runs twice replaces its own
files and reads only those of earlier batches, so a failure in between does no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import join_same
from ..session import cut, shared_folder

BUCKETS = 64


class Folder:
    """Tables of one stream; ``out`` and ``late`` have a part for each batch."""

    def __init__(self, root: str, key: Sequence[str], place: Sequence[str], schema: T.StructType):
        self.root, self.key, self.place, self.schema = root, list(key), list(place), schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int")

    def say(self, rows: DataFrame, batch: int, name: str = "out") -> None:
        """Write what ``batch`` says; an own earlier attempt is replaced."""
        rows.withColumn("_bucket", self.bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{name}/_batch={batch}")

    def said(self, session, before: int | None = None, name: str = "out") -> DataFrame:
        """All that was said, by earlier batches than ``before``, with ``_batch`` and ``_bucket``."""
        fields = [*self.schema.fields, T.StructField("_batch", T.IntegerType()), T.StructField("_bucket", T.IntegerType())]
        parts = session.read.schema(T.StructType(fields)).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return parts if before is None else parts.where(F.col("_batch") < before)

    def now(self, session, before: int | None = None) -> DataFrame:
        """The last word on every key and place."""
        return latest(self.said(session, before), [*self.key, *self.place])

    def open(self, session) -> None:
        """Empty parts, so that the first batch finds tables."""
        for name in ("out", "late"):
            session.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.root}/{name}/_batch=-1/_bucket=0")


def latest(said: DataFrame, place: Sequence[str]) -> DataFrame:
    values = [c for c in said.columns if c not in (*place, "_batch", "_bucket")]
    last = said.groupBy(*place).agg(F.max_by(F.struct(*values, "_bucket"), "_batch").alias("_v"))
    return last.select(*place, *[F.col(f"_v.{c}").alias(c) for c in values], F.col("_v._bucket").alias("_bucket"))


def run(stream: DataFrame, key: Sequence[str], place: str, rule: Callable[[DataFrame], DataFrame], result: str, carry: str, *, root: str | None = None) -> Folder:
    """Run all available input through ``rule``; returns the folder of its tables.

    ``rule`` gets rows with a column ``_carry`` (what the key carries, null at its beginning) and returns the columns
    of ``result``, which hold ``key``, ``place``, the columns of the stream and ``_after``: what the key carries from
    that row on, of type ``carry``. Of rows that repeat a key and place the first that came counts.
    """
    session, key = stream.sparkSession, list(key)
    fields, inputs = T.StructType.fromDDL(result), stream.columns
    folder = Folder(root or shared_folder(session), key, [place], fields)
    folder.open(session)
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    state = T.StructType([*[T.StructField(k, kinds[k]) for k in key], T.StructField("_last", kinds[place]), T.StructField("_carry", T.StructType.fromDDL(f"c {carry}").fields[0].dataType)])

    def work(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.groupBy(*key, place).agg(F.min(F.struct(*[c for c in inputs if c not in (*key, place)])).alias("_v")).select(*key, place, "_v.*")
        slot = f"{folder.root}/state/slot={(batch - 1) % 2}"
        held = spark.createDataFrame([], state) if batch == 0 else spark.read.schema(state).parquet(slot)
        known = cut(join_same(rows, held, key, "left"))
        behind = known.where(F.col(place) <= F.col("_last"))
        keys = cut(behind.select(*key, folder.bucket().alias("_bucket")).distinct())
        buckets = [r["_bucket"] for r in keys.select("_bucket").distinct().collect()]
        fresh = cut(rule(join_same(known, keys, key, "left_anti").drop("_last")).select(*fields.fieldNames()))
        said, again = fresh, None
        if buckets:
            past = folder.said(spark, batch).where(F.col("_bucket").isin(buckets))
            past = cut(latest(join_same(past, keys, key, "left_semi"), [*key, place]).select(*fields.fieldNames()))
            came = join_same(known, keys, key, "left_semi").select(*inputs)
            new = cut(join_same(came, past, [*key, place], "left_anti"))
            again = cut(rule(past.select(*inputs).unionByName(new).withColumn("_carry", F.lit(None).cast(carry))).select(*fields.fieldNames()))
            said = said.unionByName(join_same(again, past, fields.fieldNames(), "left_anti"))
        folder.say(said, batch)
        folder.say(_shaped(behind.select(*inputs), fields), batch, "late")
        done = fresh if again is None else fresh.unionByName(again)
        ends = cut(done.groupBy(*key).agg(F.max(place).alias("_last"), F.max_by("_after", place).alias("_carry")))
        join_same(held, ends, key, "left_anti").unionByName(ends).write.mode("overwrite").parquet(f"{folder.root}/state/slot={batch % 2}")

    (stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder.root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return folder


def _shaped(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` with the columns of ``schema``, those it lacks as nulls."""
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def merge(stream: DataFrame, key: Sequence[str], place: Sequence[str], rule: Callable[[DataFrame, DataFrame], DataFrame], result: str, *, root: str | None = None) -> Folder:
    """Run all available input through a rule that merges new rows with what was said of their keys.

    ``rule(rows, past)`` returns rows of ``result``; those that differ from ``past`` are said. Every input row counts
    once, in whatever batch it comes; a batch that runs again sees the same ``past``.
    """
    session = stream.sparkSession
    fields = T.StructType.fromDDL(result)
    folder = Folder(root or shared_folder(session), key, place, fields)
    folder.open(session)

    def work(rows: DataFrame, batch: int) -> None:
        rows = cut(rows)
        keys = cut(rows.select(*key, folder.bucket().alias("_bucket")).distinct())
        buckets = [r["_bucket"] for r in keys.select("_bucket").distinct().collect()]
        past = folder.said(rows.sparkSession, batch).where(F.col("_bucket").isin(buckets))
        past = cut(latest(join_same(past, keys, key, "left_semi"), [*key, *place]).select(*fields.fieldNames()))
        made = cut(rule(rows, past).select(*fields.fieldNames()))
        folder.say(join_same(made, past, fields.fieldNames(), "left_anti"), batch)

    (stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder.root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return folder
