"""Review and job events: idempotent append, latest state and legal transitions, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan as sc
from ..session import cut
from ..sources.outputs import fingerprint
from . import keyed

REVIEW_SCHEMA = ("sequence bigint, task_id bigint, request_id bigint, candidate_id bigint, snapshot string, "
                 "decision string, actor string, reason string, created_at timestamp")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Append-only review events as a file stream."""
    return spark.readStream.schema(REVIEW_SCHEMA).parquet(path)


def content(df: DataFrame) -> DataFrame:
    """Append the fingerprint of what a request says."""
    return df.withColumn("content_hash", fingerprint(F.col("candidate_id"), F.col("snapshot"), F.col("decision"), F.col("actor"), F.col("reason")))


def accept_requests(events: DataFrame) -> DataFrame:
    """Outcome of every event: accepted first, repeated, or conflicting content under one request id.

    The first event of a request is found by aggregation, then joined back; the
    copies of a hot request are reduced map-side.
    """
    rows = content(events)
    key = ["task_id", "request_id"]
    first = rows.groupBy(*key).agg(F.min(F.struct("sequence", "content_hash")).alias("_f"))
    full = rows.join(first, key)
    outcome = (F.when(F.col("sequence") == F.col("_f.sequence"), "accepted")
               .when(F.col("content_hash") == F.col("_f.content_hash"), "repeated").otherwise("conflict"))
    return full.withColumn("outcome", outcome).drop("_f", "content_hash")


def review_state(events: DataFrame, *, block_rows: int = sc.BLOCK_ROWS) -> DataFrame:
    """Each event with the decision before it, and whether it is the latest of its candidate."""
    key = ["task_id", "snapshot", "candidate_id"]
    seen = sc.scan(events, key, ["sequence"], sc.by_rows("sequence", block_rows),
                   _before=sc.previous(F.col("decision")), _after=sc.following(F.col("sequence")))
    return seen.withColumn("before", F.coalesce("_before", F.lit("undecided"))).withColumn(
        "latest", F.col("_after").isNull()).drop("_before", "_after")


def latest_decisions(events: DataFrame) -> DataFrame:
    """Last decision per candidate, reduced map-side."""
    return events.groupBy("task_id", "snapshot", "candidate_id").agg(
        F.max("sequence").alias("sequence"), F.max_by("decision", "sequence").alias("decision"), F.count(F.lit(1)).alias("events"))


REQUEST_RESULT = ("task_id bigint, request_id bigint, sequence bigint, candidate_id bigint, snapshot string, decision string, actor string, reason string, "
                  "content_hash string, outcome string, _after string")


def accept_requests_stream(events: DataFrame, *, root: str | None = None) -> keyed.Folder:
    """Streaming form of ``accept_requests``: an event that comes late under its request id changes the outcomes it should."""
    key = ["task_id", "request_id"]

    def rule(rows: DataFrame) -> DataFrame:
        said = cut(content(rows))
        first = said.groupBy(*key).agg(F.min(F.struct("sequence", "content_hash")).alias("_f"))
        full = sc.join_same(said, first, key)
        outcome = (F.when(F.col("_carry").isNull() & (F.col("sequence") == F.col("_f.sequence")), "accepted")
                   .when(F.col("content_hash") == F.coalesce("_carry", "_f.content_hash"), "repeated").otherwise("conflict"))
        return full.withColumn("outcome", outcome).withColumn("_after", F.coalesce("_carry", "_f.content_hash"))

    plain = events.select(*key, "sequence", "candidate_id", "snapshot", "decision", "actor", "reason")
    return keyed.run(plain, key, "sequence", rule, REQUEST_RESULT, "string", root=root)


def request_conflicts_stream(events: DataFrame, *, keep: str = "7 days") -> DataFrame:
    """Requests that came with different contents, for an update-mode side output."""
    said = content(events).withWatermark("created_at", keep)
    grouped = said.groupBy(F.window("created_at", keep).alias("w"), "task_id", "request_id").agg(
        F.min("content_hash").alias("_a"), F.max("content_hash").alias("_b"), F.count(F.lit(1)).alias("events"))
    return grouped.where("_a <> _b").select("task_id", "request_id", "events")


def review_state_stream(events: DataFrame, *, root: str | None = None) -> keyed.Folder:
    """Streaming form of ``review_state``: every event with its previous decision, in whatever order events come."""
    key = ["task_id", "snapshot", "candidate_id"]

    def rule(rows: DataFrame) -> DataFrame:
        seen = sc.scan(sc.ranked(rows, key, ["sequence"]), key, ["sequence"], F.col("_block"), _before=sc.previous(F.col("decision")))
        return seen.withColumn("before", F.coalesce("_before", "_carry", F.lit("undecided"))).withColumn("_after", F.col("decision"))

    return keyed.run(events.select(*key, "sequence", "decision"), key, "sequence", rule,
                     "task_id bigint, snapshot string, candidate_id bigint, sequence bigint, decision string, before string, _after string", "string", root=root)


# A status may only follow one of these.
TRANSITIONS = {"QUEUED": (None,), "RUNNING": ("QUEUED", "SUBMISSION_UNKNOWN"), "SUBMISSION_UNKNOWN": ("QUEUED",),
               "SUCCEEDED": ("RUNNING",), "FAILED": ("RUNNING",)}


JOB_STATES = (None, *TRANSITIONS)


def job_states(events: DataFrame, start: Column | None = None) -> DataFrame:
    """Legal and refused transitions in sequence order per task.

    Whether a transition is legal depends on the status before it. Each event is a map of the six states; the maps are
    composed by ``scan.automaton``, so a task with very many events is spread over many blocks. ``start`` is the status
    a task begins with, none by default. An unknown status is refused.
    """
    maps = {w: sc.mapping(JOB_STATES, dict.fromkeys(was, w)) for w, was in TRANSITIONS.items()}
    lookup = lambda pairs, k: F.create_map(*[F.lit(x) for kv in pairs for x in kv])[k]
    step = F.coalesce(lookup(maps.items(), F.col("status")), F.lit(sc.mapping(JOB_STATES, {})))
    letters = {s: sc.STATES[i] for i, s in enumerate(JOB_STATES) if s is not None}
    first = F.lit(sc.STATES[0]) if start is None else F.coalesce(lookup(letters.items(), start), F.lit(sc.STATES[0]))
    rows = events.select("task_id", "sequence", "status", first.alias("_first"))
    seen = sc.automaton(rows, ["task_id"], ["sequence"], step, F.col("_first"), len(JOB_STATES), "_state")
    before = lookup([(v, k) for k, v in letters.items()], F.col("_state"))
    legal = [(F.col("status") == w) & (F.coalesce(before, F.lit("")).isin([s or "" for s in was])) for w, was in TRANSITIONS.items()]
    accepted = F.lit(False)
    for one in legal:
        accepted = accepted | F.coalesce(one, F.lit(False))
    return seen.select("task_id", "sequence", "status", before.alias("before"), accepted.alias("accepted"))


def job_states_stream(events: DataFrame, *, root: str | None = None) -> keyed.Folder:
    """Streaming form of ``job_states``; a late event is put in its place and the events behind it are judged again."""
    def rule(rows: DataFrame) -> DataFrame:
        return job_states(rows, F.col("_carry")).withColumn("_after", F.when(F.col("accepted"), F.col("status")).otherwise(F.col("before")))

    return keyed.run(events.select("task_id", "sequence", "status"), ["task_id"], "sequence", rule,
                     "task_id bigint, sequence bigint, status string, before string, accepted boolean, _after string", "string", root=root)


def sessions(events: DataFrame, key: str, at: str, gap: str, *, root: str | None = None) -> keyed.Folder:
    """Runs of one label whose events are less than ``gap`` apart; ``n`` is 0 for a session that became part of another.

    Sessions still open are said like closed ones, and a late event joins the sessions it connects.
    """
    whole = [key, "label"]

    def rule(rows: DataFrame, past: DataFrame) -> DataFrame:
        new = rows.select(*whole, F.col(at).alias("start"), (F.col(at) + F.expr(f"INTERVAL {gap}")).alias("end"), F.lit(1).cast("bigint").alias("n"))
        held = past.where("n > 0").unionByName(new).groupBy(*whole, "start").agg(F.max("end").alias("end"), F.sum("n").alias("n"))
        line = sc.ranked(held, whole, ["start"])
        line = sc.scan(line, whole, ["start"], F.col("_block"), _reach=sc.max_before(F.col("end")))
        fresh = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start"))
        line = sc.scan(line.withColumn("_fresh", fresh), whole, ["start"], F.col("_block"), _session=sc.latest(F.col("_fresh")))
        made = line.groupBy(*whole, F.col("_session").alias("start")).agg(F.max("end").alias("end"), F.sum("n").alias("n"))
        gone = sc.join_same(past, made, [*whole, "start"], "left_anti").withColumn("n", F.lit(0).cast("bigint"))
        return made.unionByName(gone)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return keyed.merge(events, whole, ["start"], rule, f"{key} {kinds[key]}, label {kinds['label']}, start {kinds[at]}, end {kinds[at]}, n bigint", root=root)


def level_windows(samples: DataFrame, key: str, at: str, size: str, *, root: str | None = None) -> keyed.Folder:
    """Power, peak and number of samples of tumbling windows (``_p`` in billionths); every sample counts, however late."""
    place = [key, "start"]

    def rule(rows: DataFrame, past: DataFrame) -> DataFrame:
        new = rows.select(key, F.window(at, size)["start"].alias("start"), F.rint(F.col("x") * F.col("x") * 1e9).cast("bigint").alias("_p"), F.abs("x").alias("peak"), F.lit(1).cast("bigint").alias("n"))
        return new.unionByName(past).groupBy(*place).agg(F.sum("_p").alias("_p"), F.max("peak").alias("peak"), F.sum("n").alias("n"))

    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    return keyed.merge(samples, [key], ["start"], rule, f"{key} {kinds[key]}, start {kinds[at]}, _p bigint, peak double, n bigint", root=root)


def audit_trail(*parts: DataFrame) -> DataFrame:
    """Reviews, adoptions and edits in one table; ``orderBy(instant, sequence)`` lists them."""
    from ..sources.documents import union_versions
    return union_versions(*parts)
