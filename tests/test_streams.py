"""Streams whose files come in any order, twice or after a restart, against the batch rules."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import reviews as rv

START = 1_700_000_000


def feed(spark, root, parts, schema, start):
    """Run the stream once for each part, from its checkpoint."""
    folder = None
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
        folder = start(spark.readStream.schema(schema).parquet(f"{root}/in"))
    return folder


def parts_of(rng, rows, n=3):
    rows = list(rows)
    rng.shuffle(rows)
    return [rows[i::n] for i in range(n)]


def test_requests_reviews_and_jobs_in_wrong_order_equal_the_batch_rules(spark, tmp_path):
    rng = random.Random(1)
    reviews = [(i, rng.choice([1, 1, 2]), i - i % 3, rng.choice([5, 5, 6]), "s", rng.choice(["accepted", "rejected"]), "a", "r") for i in range(120)]
    schema = "sequence long, task_id long, request_id long, candidate_id long, snapshot string, decision string, actor string, reason string"
    whole, parts = spark.createDataFrame(reviews, schema), parts_of(rng, reviews)
    state = feed(spark, f"{tmp_path}/a", parts, schema, lambda s: rv.review_state_stream(s, root=f"{tmp_path}/a/state"))
    names = ["task_id", "snapshot", "candidate_id", "sequence", "decision", "before"]
    assert sorted(map(tuple, state.now(spark).select(names).collect())) == sorted(map(tuple, rv.review_state(whole).select(names).collect()))
    late = {r["sequence"] for r in state.said(spark, 1 << 30, "late").where("_batch >= 0").collect()}
    key = lambda r: (r[1], r[4], r[3])
    want, last = set(), {}
    for part in parts:
        want |= {r[0] for r in part if r[0] <= last.get(key(r), -1)}
        for r in part:
            last[key(r)] = max(last.get(key(r), -1), r[0])
    assert late == want and late
    requests = feed(spark, f"{tmp_path}/b", parts, schema, lambda s: rv.accept_requests_stream(s, root=f"{tmp_path}/b/state"))
    names = ["task_id", "request_id", "sequence", "outcome"]
    got = sorted(map(tuple, requests.now(spark).select(names).collect()))
    assert got == sorted(map(tuple, rv.accept_requests(whole).select(names).collect())) and {r[3] for r in got} == {"accepted", "repeated", "conflict"}


def test_job_states_of_one_hot_task_in_wrong_order(spark, tmp_path):
    rng = random.Random(2)
    jobs = [(1, i, rng.choice([*rv.TRANSITIONS, "QUEUED", "RUNNING"])) for i in range(150)] + [(2, i, "QUEUED") for i in range(3)]
    schema = "task_id long, sequence long, status string"
    got = feed(spark, str(tmp_path), parts_of(rng, jobs), schema, lambda s: rv.job_states_stream(s, root=f"{tmp_path}/state")).now(spark)
    names = ["task_id", "sequence", "status", "before", "accepted"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, rv.job_states(spark.createDataFrame(jobs, schema)).select(names).collect()))


def plain_sessions(rows, gap):
    out = []
    for key in {r[:2] for r in rows}:
        run = []
        for t in [*sorted(r[2] for r in rows if r[:2] == key), None]:
            if run and (t is None or t - run[-1] >= gap):
                out.append((*key, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(t)
    return sorted(out)


def test_late_events_join_sessions_and_levels_count_all_samples(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 2]), rng.choice("ab"), START + 60 * rng.randrange(3000)) for _ in range(90)]
    parts = [[(*r, r[2] % 7 / 8) for r in p] for p in parts_of(rng, rows)]
    schema = "user long, label string, s long, x double"
    plain = lambda s: s.withColumn("at", F.timestamp_seconds("s"))
    found = feed(spark, f"{tmp_path}/a", parts, schema, lambda s: rv.sessions(plain(s).select("user", "label", "at"), "user", "at", "30 minutes", root=f"{tmp_path}/a/state"))
    got = found.now(spark).where("n > 0").select("user", "label", F.unix_timestamp("start"), F.unix_timestamp("end"), "n").collect()
    assert sorted(map(tuple, got)) == plain_sessions(rows, 1800)
    levels = feed(spark, f"{tmp_path}/b", parts, schema, lambda s: rv.level_windows(plain(s).select("user", "at", "x"), "user", "at", "1 hour", root=f"{tmp_path}/b/state"))
    want = {}
    for r in (r for p in parts for r in p):
        p, peak, n = want.get((r[0], r[2] // 3600 * 3600), (0, 0.0, 0))
        want[r[0], r[2] // 3600 * 3600] = (p + round(r[3] * r[3] * 1e9), max(peak, r[3]), n + 1)
    got = levels.now(spark).select("user", F.unix_timestamp("start").alias("s"), "_p", "peak", "n").collect()
    assert {(r["user"], r["s"]): (r["_p"], r["peak"], r["n"]) for r in got} == want


def test_a_batch_that_runs_again_replaces_its_own_words(spark, tmp_path):
    from spanloom.streaming import keyed
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("k long, at long, v string")
    folder = keyed.Folder(str(tmp_path), ["k"], ["at"], schema)
    folder.open(spark)
    folder.say(spark.createDataFrame([(1, 1, "first"), (1, 2, "lost")], schema), 0)
    folder.say(spark.createDataFrame([(1, 1, "second")], schema), 0)
    folder.say(spark.createDataFrame([(1, 3, "later")], schema), 1)
    assert sorted((r["at"], r["v"]) for r in folder.now(spark).collect()) == [(1, "second"), (3, "later")]
    assert [r["v"] for r in folder.now(spark, 1).collect()] == ["second"]
