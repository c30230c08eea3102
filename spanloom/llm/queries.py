"""Queries of the corpus operators over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import cut, table

from . import conversations, decontamination, hard_negatives, labelled, near_duplicates, nearest, packing, pii, quality_classifier, quality_rules, secrets, substring_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids."""
    parts = packing.pieces(documents(spark, sf), tokenizer_path())
    digests = parts.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens")
    return packing.place(cut(digests))


@query
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of encoded lengths with the answers for every limit."""
    return token_counts.suffix_sums(cut(token_counts.histogram(token_counts.lengths(documents(spark, sf), tokenizer_path()))))


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = documents(spark, sf)
    return quality_rules.judge(docs, quality_rules.line_model(docs, table(spark, sf, "labels")))


@query
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fifth."""
    docs = documents(spark, sf)
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def _kind_counts(kinds: tuple[str, ...]) -> list:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [count(k) for k in kinds]


def _base_sha256() -> Column:
    return F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")


@query
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts, base digest and all spans of personal data of every document."""
    return pii.find(documents(spark, sf)).select("doc_id", *_kind_counts(pii.KINDS), _base_sha256(), pii.joined(F.col("spans")).alias("spans"))


@query
def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts, base digest and all spans of secrets of every document."""
    found = secrets.find(documents(spark, sf), tokenizer_path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", *_kind_counts(secrets.KINDS), _base_sha256(), pii.joined(F.col("spans")).alias("spans"))


@query
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Category probabilities and verdict of every document."""
    docs = documents(spark, sf)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query
def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items and regions found in every document."""
    found = decontamination.find(documents(spark, sf), table(spark, sf, "benchmark"))
    span = F.transform("regions", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", (F.size("regions") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.col("regions.item_id"))).alias("items"), F.array_join(span, ",").alias("regions"))


@query
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates.classes(documents(spark, sf)).select("doc_id", "class_id", "class_texts")


@query
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the 50-word windows that a smaller document holds."""
    left = substring_dedup.remove_repeats(documents(spark, sf))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    rows = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


@query
def op12_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest neighbours found of every row whose id is divisible by 20, among all rows."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return nearest.search(nearest.index(rows), rows, F.col("vec_id") % 20 == 0)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows damaged by the checksum of their place: dropped, emptied, unpunctuated, repeated or given to the user."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(place.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


@query
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    rows = table(spark, sf, "conversations")
    found = conversations.audit(damaged(rows))
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("k"), F.col("conv_id").cast("string")))
    whole = rows.select("conv_id").distinct().withColumn("conv", conv).join(found, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select("conv_id", *[zero(c) for c in (*conversations.COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
