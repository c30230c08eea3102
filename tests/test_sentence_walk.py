"""The sentence rule of documents walks a document's words where they lie."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.functions import text as tx
from spanloom.operators import selection as sl, sentences as se, windows as wn
from spanloom.plans import tables as tb
from test_placement import exchanges, only_by_source


def words(spark):
    r, rows = random.Random(4), []
    for source in range(1, 9):
        at = 0
        for pos in range(1, 260):
            text = r.choice(["ab", "abcdefgh", "x" * 30, "y.", "z!”", "”", "),", "q,", "w:", ".", "我们。", "x" * 70])
            length = r.choice([40, 300, 2000, 9000])
            rows.append((source, 3 * pos, text, at, at + length))
            at += max(length + r.choice([-600, 0, 10, 20, 120, 160, 420, 1100, 3100]), 1)
    return spark.createDataFrame(rows, "source_id bigint, pos bigint, text string, start_ms bigint, end_ms bigint")


def test_sentences_walked_in_place_equal_those_of_dealt_stretches(spark):
    w = words(spark)
    got = se.bounded_sentences(w.repartition(4, "source_id")).collect()
    want = se.split_sentences(se.token_units(w)).collect()
    assert {r["reason"] for r in want} >= {"terminal_punctuation", "pause", "limit_at_pause", "limit_at_soft_mark", "limit_without_boundary"}
    assert sorted((r["source_id"], r["first_word"], r["last_word"], r["reason"]) for r in got) == sorted(map(tuple, want))
    held = {}
    for r in sorted(w.collect()):
        held.setdefault(r["source_id"], []).append(r)
    for r in got:
        own = [x for x in held[r["source_id"]] if r["first_word"] <= x["pos"] <= r["last_word"]]
        assert (r["start_ms"], r["end_ms"], r["n_words"]) == (min(x["start_ms"] for x in own), max(x["end_ms"] for x in own), len(own))
        assert r["text"] == " ".join(x["text"] for x in own)


def test_units_of_rule_sentences_are_not_dealt(spark):
    plan = exchanges(entry.queries()["rule_sentences"](spark, entry.SMOKE_DIR))
    assert len(plan) == 1 and only_by_source(plan), plan


def test_split_audit_reads_its_flags_from_the_end_rows(spark):
    got = entry.queries()["split_audit"](spark, entry.SMOKE_DIR)
    plan = exchanges(got)
    assert len(plan) == 2 and only_by_source(plan), plan
    few = F.col("source_id") < 12
    s = se.rule_sentences(spark, entry.SMOKE_DIR).where(few).localCheckpoint()
    w = wn.sentence_windows(wn.sentence_features(s, tx.LATIN, block_rows=None)).select("source_id", "first_pos", "last_pos")
    rows = lambda df: sorted(map(tuple, df.select("source_id", "first_pos", "last_pos", "bad_start", "bad_end").collect()))
    assert rows(got.where(few)) == rows(sl.split_audit(w, s, block=None)) != []
