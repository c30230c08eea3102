import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from spanloom.operators.scorers import ScorerRegistry
from spanloom.plans import load_catalog
from spanloom.sources import documents as sd, outputs as so
from spanloom.streaming import reviews as rv


def test_catalog_loads_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 140 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True)


def test_entry_is_lazy_and_small(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).limit(5).count() == 5


def test_every_query_has_a_unique_name():
    queries, checks = load_catalog()
    assert set(checks) <= set(queries)


def test_exclusive_and_marked_output(spark, tmp_path):
    df = spark.range(3)
    so.write_new(df, str(tmp_path / "a"))
    with pytest.raises(Exception):
        so.write_new(df, str(tmp_path / "a"))
    so.publish(df, str(tmp_path / "p"), "r1")
    so.write_new(df, str(tmp_path / "p" / "runs" / "run_id=r2"))
    assert {r["run_id"] for r in so.read_published(spark, str(tmp_path / "p")).collect()} == {"r1"}


def test_read_analysis_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"media": {"normalized_sha256": "h"}, "words": [{"id": "w1", "start": 0.5, "end": 1.25, "text": "x"}], '
                                     '"sentences": [], "shots": [], "speech": [], "silence": []}')
    tables = sd.explode_analysis(sd.read_analysis(spark, str(tmp_path)))
    assert [tuple(r) for r in tables["words"].select("source_id", "start_ms", "end_ms").collect()] == [("h", 500, 1250)]


def test_scorer_registry():
    r = ScorerRegistry()
    r.register("x", lambda df: df)
    with pytest.raises(ValueError):
        r.register("x", lambda df: df)


def test_conflicting_requests_reach_the_side_output(spark, tmp_path):
    rows = [(1, 1, 7, 1, "s", "accepted", "a", "r"), (2, 1, 7, 1, "s", "rejected", "a", "r"), (3, 1, 8, 1, "s", "accepted", "a", "r")]
    df = spark.createDataFrame(rows, "sequence long, task_id long, request_id long, candidate_id long, snapshot string, decision string, actor string, reason string")
    df.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000))).write.parquet(str(tmp_path / "in"))
    out = rv.request_conflicts_stream(rv.read_reviews(spark, str(tmp_path / "in")))
    q = out.writeStream.outputMode("update").format("memory").queryName("conflicts").start()
    q.processAllAvailable()
    q.stop()
    assert [r["request_id"] for r in spark.sql("SELECT * FROM conflicts").collect()] == [7]
