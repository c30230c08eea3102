"""Writers and incremental reuse: exclusive output, marked publication, fingerprints, text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write to a path that must not exist yet."""
    df.write.mode("errorifexists").format(fmt).save(path)


def publish(df: DataFrame, root: str, run_id: str) -> None:
    """Write the data of a run, then its completion row.

    The row is appended after the data job has committed, so a reader that goes
    by the completion table never sees a run that was lost halfway.
    """
    write_new(df, f"{root}/runs/run_id={run_id}")
    done = df.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("completed_at"))
    done.write.mode("append").parquet(f"{root}/completed")


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """Rows of completed runs only."""
    done = spark.read.parquet(f"{root}/completed").select("run_id").distinct()
    return spark.read.parquet(f"{root}/runs").join(done, "run_id", "left_semi")


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the ordered JSON of the descriptor columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def split_by_reuse(inputs: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs still to process, and inputs whose earlier successful result is reused.

    Failed or degraded results never count.
    """
    good = processed.where("status = 'ok'").select("fingerprint", "result").dropDuplicates(["fingerprint"])
    return inputs.join(good, "fingerprint", "left_anti"), inputs.join(good, "fingerprint")


def history_page(records: DataFrame, *, limit: int, offset: int) -> DataFrame:
    """Readable records, newest first, of one page, with the count of unreadable ones.

    ``place`` numbers the rows of the page and ``more`` says whether another page follows;
    only the page and one row beyond it are numbered.
    """
    bad = records.where("readable = false").agg(F.count(F.lit(1)).alias("unavailable_count")).withColumn("_k", F.lit(1))
    page = records.where("readable").orderBy(F.desc("instant"), F.desc("id")).offset(offset).limit(limit + 1)
    every = Window.partitionBy(F.lit(1))
    seen = page.select("*", F.row_number().over(every.orderBy(F.desc("instant"), F.desc("id"))).alias("place"), (F.count(F.lit(1)).over(every) > limit).alias("more"))
    # The count is one row.
    return seen.where(F.col("place") <= limit).withColumn("_k", F.lit(1)).join(F.broadcast(bad), "_k").drop("_k").orderBy("place")


def write_subtitles(blocks: DataFrame, path: str) -> None:
    """One table of all lists' blocks, range-partitioned and sorted by list and number.

    A list's rows lie in few files whose statistics name their range, so reading one list
    skips the others; the number of files follows the size and not the number of lists.
    """
    ordered = blocks.select("edl_id", "number", "block").repartitionByRange("edl_id", "number").sortWithinPartitions("edl_id", "number")
    ordered.write.mode("errorifexists").parquet(path)


def subtitle_text(spark: SparkSession, path: str, edl_id: int) -> str:
    """The text of one list, its blocks in order."""
    rows = spark.read.parquet(path).where(F.col("edl_id") == edl_id).orderBy("number").select("block").toLocalIterator()
    return "\n".join(r["block"] for r in rows)
