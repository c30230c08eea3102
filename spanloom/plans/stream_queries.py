"""Streaming forms over the event table, which comes in three parts in the wrong order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming import keyed, reviews as rv
from . import function_queries as fq
from .catalog import CHECKS, query
from .oracle import with_

# Remainders of the event number modulo 3, in the order in which the parts come.
PARTS = (1, 2, 0)


def in_parts(spark, sf: str, start: Callable[[DataFrame, str], keyed.Folder]) -> keyed.Folder:
    """Run a stream over the events, stopped and started again for each part."""
    root, events, folder = shared_folder(spark), table(spark, sf, "events"), None
    for part in PARTS:
        events.where(F.pmod("event_id", F.lit(len(PARTS))) == part).write.mode("append").parquet(f"{root}/in")
        folder = start(spark.readStream.schema(events.schema).parquet(f"{root}/in"), root)
    return folder


def reviews(events: DataFrame) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return events.select(
        i.alias("sequence"), F.lit(1).cast("bigint").alias("task_id"), F.when(i % 9 == 4, i - 1).otherwise(i).alias("request_id"), (u % 2).alias("candidate_id"),
        F.lit("s1").alias("snapshot"), F.expr(fq.DECISION).alias("decision"), F.lit("a").alias("actor"), F.lit("r").alias("reason"))


@query("review_requests_stream", f"SELECT sequence, request_id, outcome FROM ({CHECKS['review_requests']})")
def review_requests_stream(spark, sf):
    return in_parts(spark, sf, lambda e, root: rv.accept_requests_stream(reviews(e), root=root)).now(spark).select("sequence", "request_id", "outcome")


@query("review_state_stream", with_("rev", """SELECT sequence, candidate_id, decision, coalesce(lag(decision) OVER (PARTITION BY candidate_id ORDER BY sequence), 'undecided') AS before FROM rev"""))
def review_state_stream(spark, sf):
    return in_parts(spark, sf, lambda e, root: rv.review_state_stream(reviews(e), root=root)).now(spark).select("sequence", "candidate_id", "decision", "before")


@query("late_reviews", with_("rev", """SELECT sequence, candidate_id, decision FROM (SELECT *, (sequence % 3 + 2) % 3 AS part FROM rev) r
  WHERE sequence < (SELECT max(sequence) FROM rev e WHERE e.candidate_id = r.candidate_id AND (e.sequence % 3 + 2) % 3 < part)"""))
def late_reviews(spark, sf):
    """Reviews that came behind a later one of their candidate."""
    return in_parts(spark, sf, lambda e, root: rv.review_state_stream(reviews(e), root=root)).said(spark, 1 << 30, "late").where("_batch >= 0").select("sequence", "candidate_id", "decision")


def jobs(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("sequence"), F.expr(fq.STATUS).alias("status"))


@query("job_states_stream", CHECKS["job_states"])
def job_states_stream(spark, sf):
    folder = in_parts(spark, sf, lambda e, root: rv.job_states_stream(jobs(e), root=root))
    return folder.now(spark).select("task_id", "sequence", "status", "before", "accepted")


@query("session_stream", """SELECT user_id, label, min(t) AS start, max(t) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id, label ORDER BY t, event_id) AS session FROM (SELECT user_id, event_type AS label, ts AS t, event_id,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, label, session""")
def session_stream(spark, sf):
    plain = lambda e: e.select("user_id", F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("at"))
    folder = in_parts(spark, sf, lambda e, root: rv.sessions(plain(e), "user_id", "at", "6 hours", root=root))
    return folder.now(spark).where("n > 0").select("user_id", "label", "start", "end", "n")


@query("level_stream", """SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, sqrt(sum(round_even(x * x * 1e9::DOUBLE, 0)::BIGINT)::BIGINT / 1e9::DOUBLE / count(*)) AS rms, max(abs(x)) AS peak, count(*) AS n
  FROM (SELECT user_id, ts, value * 0.001::DOUBLE AS x FROM events) GROUP BY 1, 2""")
def level_stream(spark, sf):
    plain = lambda e: e.select("user_id", F.col("ts").cast("timestamp").alias("at"), (F.col("value") * 0.001).alias("x"))
    folder = in_parts(spark, sf, lambda e, root: rv.level_windows(plain(e), "user_id", "at", "1 day", root=root))
    return folder.now(spark).select("user_id", "start", F.sqrt(F.col("_p") / 1e9 / F.col("n")).alias("rms"), "peak", "n")
