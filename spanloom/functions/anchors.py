"""Discourse anchors and cue notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Openings that lean on what came before.
DEPENDENT_OPENING = (r"^(?:而且|所以|但是|因为|也是|还有|还行|是这样|这个|那个|这种|那种|他(?:就是|说|们)|她(?:就是|说|们)|它(?:这个|的|是|们)|"
                     r"[一-鿿]{1,5}(?:不出来|不了|不到|不清楚|不明白))")
CONDITION_BEFORE = r"(?:如果|假如|要是|倘若|当)$"
CONDITION_AFTER = r"(?:的时候|的话)"
ASKING = r"[?？]|吗|呢"


def opens_dependent(text: Column, pattern: str = DEPENDENT_OPENING) -> Column:
    return F.regexp_replace(text, r"\s", "").rlike(pattern)


def question_in_condition(before: Column, following: Column) -> Column:
    """A question cue that is probably part of a conditional phrase; both texts without white space.

    The last 16 characters before the cue and the 48 from it are what the rule looks at; the
    conditional ending counts within the first 32.
    """
    near, ahead = F.right(before, F.lit(16)), F.left(following, F.lit(48))
    head = F.left(following, F.lit(32))
    has_suffix = head.rlike(CONDITION_AFTER)
    asks = F.when(has_suffix, F.get(F.split(head, CONDITION_AFTER), F.lit(0))).otherwise(ahead).rlike(ASKING)
    return near.rlike(CONDITION_BEFORE) | (has_suffix & ~asks)


def condition_cues(words: DataFrame, anchors: DataFrame, *, before: int = 10, after: int = 30) -> DataFrame:
    """``anchors`` (source_id, pos) with ``before``, ``following`` and whether the cue stands in a condition.

    Each anchor looks up the words around it by position, so no source is one group.
    """
    bare = words.select("source_id", "pos", F.regexp_replace("text", r"\s", "").alias("w"))
    asked = anchors.select("source_id", F.col("pos").alias("_at"), F.explode(F.sequence(F.col("pos") - before, F.col("pos") + after - 1)).alias("pos"))
    side = lambda keep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "_at", "w"))), keep), lambda x: x["w"]), "")
    texts = asked.join(bare, ["source_id", "pos"]).groupBy("source_id", "_at").agg(
        side(lambda x: x["pos"] < x["_at"]).alias("before"), side(lambda x: x["pos"] >= x["_at"]).alias("following"))
    return texts.select("source_id", F.col("_at").alias("pos"), "before", "following",
                        question_in_condition(F.col("before"), F.col("following")).alias("in_condition"))


def discourse_anchors(words: DataFrame, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """Leftmost non-overlapping cue phrases that start at a word, the longest first.

    Only words that open a phrase look up the words behind them, by position; the
    overlap rule then is a greedy selection along the positions.
    """
    plain = words.select("source_id", "pos", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "").alias("w"))
    split = [(kind, phrase.split(" ")) for kind, phrase in phrases]
    reach = max(len(p) for _, p in split)
    opening = plain.where(F.col("w").isin(sorted({p[0] for _, p in split}))).select("source_id", F.col("pos").alias("start"))
    asked = opening.select("source_id", "start", F.explode(F.sequence(F.col("start"), F.col("start") + reach - 1)).alias("pos"))
    near = asked.join(plain, ["source_id", "pos"]).groupBy("source_id", "start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda r: r["w"]).alias("ws"))
    found = F.lit(None)
    for kind, parts in sorted(split, key=lambda p: len(p[1])):
        same = F.slice("ws", 1, len(parts)) == F.array(*[F.lit(x) for x in parts])
        found = F.when(same, F.struct(F.lit(kind).alias("kind"), F.lit(" ".join(parts)).alias("quote"), F.lit(len(parts)).alias("n"))).otherwise(found)
    hits = near.select("source_id", F.col("start").alias("pos"), found.alias("f")).where("f IS NOT NULL").select(
        "source_id", "pos", "f.kind", "f.quote", (F.col("pos") + F.col("f.n") - 1).alias("last"))
    from ..operators.greedy import greedy_line
    fate = greedy_line(hits, ["source_id"], [F.col("pos")], "pos", start="pos", end="last", overlap=True, stretch=8192)
    return hits.join(fate.where("retained").select("source_id", "pos"), ["source_id", "pos"])
