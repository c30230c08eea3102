"""Timed tables derived from the input tables with integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LATIN
from ..functions.times import wall_millis
from ..operators import scan as sc
from ..operators import windows as wn
from ..session import table

# Copies of one row per key used to split a hot key's side of a join.
SALTS = 16


def shuffle_partitions(spark: SparkSession) -> int:
    """Explicit partition count for an exchange whose rows are exploded afterwards.

    The adaptive planner would coalesce by the bytes that are shuffled, which are
    the raw texts, not the much larger rows the next operators make of them.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Timed words of every document.

    The text is shuffled once by document, before it is exploded; the window by
    document then needs no shuffle. One document is one input row, so a group
    never exceeds what a single row already holds.
    """
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    tokens = F.filter(F.split("text", r"[ \t\r\n\f]+"), lambda t: t != "")
    raw = (docs.repartition(shuffle_partitions(spark), "source_id")
           .select("source_id", F.posexplode(tokens).alias("p", "text"))
           .withColumn("pos", F.col("p").cast("bigint") + 1))
    dur = F.length("text").cast("bigint") * 60 + 40
    gap = (F.when(F.col("pos") % 241 == 0, 3600)
           .when(F.substring("text", -1, 1).isin(".", "!", "?"), 450).otherwise(20)).cast("bigint")
    before = Window.partitionBy("source_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    timed = raw.withColumn("dur", dur).withColumn("gap", gap).withColumn(
        "start_ms", F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0).cast("bigint")))
    return timed.select("source_id", "pos", "text", "start_ms",
                        (F.col("start_ms") + F.col("dur")).alias("end_ms"))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Plain sentences; all words of a source come from one row, so windows by source stay bounded."""
    rows = wn.plain_sentences(words(spark, sf), block_rows=None)
    return wn.numbered(rows, ["source_id"], ["first_word"], None)


FRAME_MS = 1000


def level_frames(words: DataFrame) -> DataFrame:
    """Level of every second in which a word starts; it changes from one stretch of forty words to the next."""
    db = F.lit(-30.0) + F.pmod(F.floor(F.col("pos") / 40) * 17, F.lit(40)) * 0.5 - F.pmod(F.length("text") * 7 + F.col("pos"), F.lit(10)) * 0.5
    db = F.when(F.col("source_id") % 11 == 0, F.lit(-70.0)).otherwise(db)
    return words.groupBy("source_id", F.floor(F.col("start_ms") / FRAME_MS).alias("frame")).agg(F.max(db).alias("rms_db"))


def plain_features(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix sums of the sentences, without levels."""
    return wn.sentence_features(sentences(spark, sf), LATIN, block_rows=None)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix sums and level runs of the sentences."""
    return wn.bounded_loudness(plain_features(spark, sf), level_frames(words(spark, sf)), frame_ms=FRAME_MS)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """One timed sentence per conversation turn."""
    t = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), "role", "text")
    dur = F.greatest(F.length("text").cast("bigint"), F.lit(1)) * 50
    gap = F.when(F.col("pos") % 7 == 6, 3500).otherwise(800).cast("bigint")
    timed = sc.scan(t.withColumn("dur", dur).withColumn("gap", gap), ["source_id"], ["pos"],
                    sc.by_rows("pos"), start_ms=sc.running_sum(F.col("dur") + F.col("gap"), inclusive=False))
    return timed.select("source_id", "pos", "role", "text", "start_ms",
                        (F.col("start_ms") + F.col("dur")).alias("end_ms"))


def per_key(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """Join one row per key to many rows per key, a hot key being split over salts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events on each user's own clock: ``at_ms`` counts from the user's first event."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"), "event_id", "event_type", "value", "props",
        wall_millis(F.col("ts")).alias("ms"))
    first = e.groupBy("source_id").agg(F.min("ms").alias("_first"))
    return (per_key(e, first, "source_id", "event_id")
            .withColumn("at_ms", F.col("ms") - F.col("_first")).drop("_first"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "source_id", "event_id", "event_type", "value", F.col("at_ms").alias("start_ms"),
        (F.col("at_ms") + F.ceil(F.col("value")) * 60000).alias("end_ms"))


def marked_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with punctuation that opens questions, colons, quotations and reasons.

    The generated prose has none of these, so the turn number decides which mark
    a turn gets; all turns stay.
    """
    bare = F.regexp_replace("text", r"[.!?]+\s*$", "")
    k = F.col("pos") % 12
    text = (F.when(k == 0, F.concat(bare, F.lit("?"))).when(k == 2, F.concat(F.lit("Because "), bare))
            .when(k == 3, F.concat(F.lit("So "), F.col("text"))).when(k == 5, F.concat(bare, F.lit(":")))
            .when(k == 6, F.concat(F.lit('"'), F.col("text"))).when(k == 8, F.concat(F.col("text"), F.lit('"')))
            .when(k == 9, F.concat(F.lit("what is "), bare)).when(k == 11, F.concat(F.col("text"), F.lit("“")))
            .otherwise(F.col("text")))
    return turns(spark, sf).withColumn("text", text)


# Units of a discourse, by turn: what stands before and behind the turn's first words or its whole text.
DISCOURSE = (
    ("我想知道", "short", ""), ("因为", "short", "。"), ("另一个是", "short", "。"), ("但是因为", "short", ""), ("我们目前在工作方面", "", ""), ("遇到", "short", ""),
    ("因为", "short", ""), ("所以", "short", "。"), ("这就是大家说的一些办法", "", ""), ("是", "short", "。"), ("", "short", "就是"), ("", "text", ""),
    ("", "short", "反而"), ("不", "short", ""), ("", "short", "?"), ("", "text", ""), ("还有一个原因是", "short", ""), ("下面", "short", ""),
    ("我想知道但已经知道", "short", ""), ("嗯。", "", ""), ("我不是我想知道", "short", ""), ("“我想知道", "short", ""), ("", "short", "”"), ("哪个方面在", "short", "？"),
    ("我们在这个方面", "", "。"), ("因为这个词", "short", ""), ("我想知道", "short", ""), ("是的", "short", ""), ("为什么这样？因为", "short", ""), ("第二个原因是", "short", "。"),
    ("因为", "short", ""), ("下面因为", "short", ""), ("我们目前在生活方面", "", ""), ("", "text", ""), ("这就是那些说", "", ""), ("", "short", "反而"), ("", "text", ""), ("", "x300", ""))


def discourse_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with Han constructions that open and continue intents, causes, slots, questions and quotations; all turns stay."""
    at = F.pmod(F.col("source_id") * 7 + F.col("pos"), F.lit(len(DISCOURSE))).cast("int")
    part = lambda i: F.get(F.array(*[F.lit(d[i]) for d in DISCOURSE]), at)
    short = F.regexp_extract("text", "^[A-Za-z]+(?: [A-Za-z]+)?", 0)
    body = F.when(part(1) == "short", short).when(part(1) == "text", F.col("text")).when(part(1) == "x300", F.repeat(F.lit("x"), 300)).otherwise("")
    return turns(spark, sf).withColumn("text", F.concat(part(0), body, part(2)))
