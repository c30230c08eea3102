"""Readers: analysis documents, strict JSON and probe metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPAN = "start: double, end: double"
ANALYSIS_SCHEMA = (
    "schema_version string, "
    "media struct<source_sha256: string, normalized_sha256: string, time_reference: string, duration_seconds: double, "
    "has_audio: boolean, total_frames: bigint, fps: bigint>, "
    f"shots array<struct<{_SPAN}>>, speech array<struct<{_SPAN}>>, silence array<struct<{_SPAN}>>, "
    f"words array<struct<id: string, {_SPAN}, text: string, probability: double>>, "
    f"sentences array<struct<id: string, {_SPAN}, text: string, word_ids: array<string>>>")
TABLES = ("words", "sentences", "shots", "speech", "silence")


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """Analysis documents, one JSON object per file, with an explicit schema."""
    return spark.read.schema(ANALYSIS_SCHEMA + ", _corrupt_record string").json(
        path, multiLine=True, allowNonNumericNumbers=False, columnNameOfCorruptRecord="_corrupt_record")


def millis(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def explode_analysis(docs: DataFrame) -> dict[str, DataFrame]:
    """One table per array, keyed by the normalised hash, times in milliseconds."""
    out = {}
    for name in TABLES:
        rows = docs.select(F.col("media.normalized_sha256").alias("source_id"), F.posexplode(name).alias("_p", "r"))
        fields = [f.name for f in docs.schema[name].dataType.elementType.fields if f.name not in ("start", "end")]
        out[name] = rows.select("source_id", (F.col("_p") + 1).cast("bigint").alias("pos"), *[F.col(f"r.{f}") for f in fields],
                                millis(F.col("r.start")).alias("start_ms"), millis(F.col("r.end")).alias("end_ms"))
    return out


def union_versions(*frames: DataFrame) -> DataFrame:
    """Documents of several schema versions in one table; absent fields are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def strict_json(rows: DataFrame, raw: str, schema: str) -> DataFrame:
    """Parse a JSON object column; duplicate keys, non-finite numbers and malformed text are rejected.

    ``parsed`` is null and ``reject`` says why.
    """
    text = F.col(raw)
    parsed = F.from_json(text, schema + ", _bad string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"})
    keys = F.json_object_keys(text)
    full = rows.withColumn("_parsed", parsed)
    reason = (F.when(F.trim(text).rlike(r"^[^{]|^$"), "not_an_object")
              .when(text.rlike(r"[:\[,]\s*-?(?:NaN|Infinity)\b"), "non_finite_number")
              .when(F.col("_parsed").isNull() | F.col("_parsed._bad").isNotNull() | keys.isNull(), "malformed")
              .when(F.size(keys) != F.size(F.array_distinct(keys)), "duplicate_keys"))
    fields = [f.name for f in full.schema["_parsed"].dataType.fields if f.name != "_bad"]
    return full.withColumn("reject", reason).select(
        *rows.columns, "reject", *[F.when(F.col("reject").isNull(), F.col(f"_parsed.{f}")).alias(f) for f in fields])


MISMATCH_FIELDS = ("time_reference", "duration_ms", "total_frames", "fps")


def combine_analysers(shots: DataFrame, speech: DataFrame, words: DataFrame) -> DataFrame:
    """Join three analyser outputs on the media hash and list the identity fields that differ."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("normalized_sha256", F.col("payload").alias(f"{tag}_payload"),
                         *[F.col(c).alias(f"{tag}_{c}") for c in MISMATCH_FIELDS])

    full = side(shots, "shots").join(side(speech, "speech"), "normalized_sha256", "full_outer").join(
        side(words, "words"), "normalized_sha256", "full_outer")
    missing = [F.when(F.col(f"{t}_payload").isNull(), F.lit(f"missing_{t}")) for t in ("shots", "speech", "words")]
    differ = [F.when(~(F.col(f"shots_{c}").eqNullSafe(F.col(f"speech_{c}")) & F.col(f"shots_{c}").eqNullSafe(F.col(f"words_{c}"))), F.lit(c)) for c in MISMATCH_FIELDS]
    absent = F.array_join(F.filter(F.array(*missing), lambda x: x.isNotNull()), ",")
    changed = F.array_join(F.filter(F.array(*differ), lambda x: x.isNotNull()), ",")
    return full.select("normalized_sha256", "shots_payload", "speech_payload", "words_payload",
                       F.when(absent != "", absent).otherwise(changed).alias("mismatch"))


_STREAM = ("struct<index: bigint, codec_type: string, codec_name: string, width: string, height: string, avg_frame_rate: string, "
           "sample_rate: string, channels: string, disposition: struct<attached_pic: bigint>>")
PROBE_SCHEMA = f"streams array<{_STREAM}>, format struct<duration: string, format_name: string>"


def positive(value: Column) -> Column:
    """A positive finite number, else null."""
    number = value.try_cast("double")
    return F.when((number > 0) & ~F.isnan(number) & (number != float("inf")), number)


def rational(value: Column) -> tuple[Column, Column]:
    """Numerator and denominator of ``n/d`` or ``n``; nulls when it is not a positive fraction."""
    parts = F.split(value, "/")
    num = F.get(parts, F.lit(0)).try_cast("bigint")
    den = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    good = (num > 0) & (den > 0) & (F.size(parts) <= 2)
    return F.when(good, num), F.when(good, den)


def normalize_probe(rows: DataFrame, raw: str) -> DataFrame:
    """First video stream that is not a cover, first audio stream, exact frame rate."""
    parsed = rows.withColumn("_m", F.from_json(F.col(raw), PROBE_SCHEMA))
    streams = F.col("_m.streams")
    video = F.get(F.filter(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    audio = F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))
    full = parsed.withColumn("_v", video).withColumn("_a", audio)
    num, den = rational(F.col("_v.avg_frame_rate"))
    keep = [c for c in rows.columns if c != raw]
    return full.select(
        *keep, positive(F.col("_m.format.duration")).alias("duration_seconds"), F.col("_m.format.format_name").alias("container_format"),
        F.col("_v.index").alias("video_index"), F.col("_v.codec_name").alias("video_codec"), positive(F.col("_v.width")).cast("bigint").alias("width"),
        positive(F.col("_v.height")).cast("bigint").alias("height"), num.alias("fps_num"), den.alias("fps_den"),
        F.col("_a.index").alias("audio_index"), positive(F.col("_a.sample_rate")).cast("bigint").alias("sample_rate"),
        F.when(F.col("_v").isNull(), "no_video_stream").alias("reject"))
