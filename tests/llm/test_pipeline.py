import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F

from spanloom.llm import pii, quality_rules
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.tokens import encoder

from .conftest import ODD_TEXTS
from .test_near_duplicates import expected

CLEAN = "The river {0} ran slowly past the old mill of {0} and on.\nNobody had walked there for {1} years, and the path was lost.\nBirds sang over {1} fields."
JUNK = "BUY {0}!!! ### NOW!!! ***\n$$$ %%% WIN!!! | | | {1}\n### CLICK!!! $$$ &&& HERE!!! {0} {1} || ##"


def test_pipeline_equals_its_stages_by_brute_force(spark, docs, tmp_path):
    passage = "questions about amber lanterns, copper kettles, velvet curtains, marble stairs and silver mirrors are asked here"
    rows = [(i, (CLEAN if i % 3 else JUNK).format(f"name{i}x{i * 7}", f"no{i * 13}k")) for i in range(60)]
    rows += [(100, rows[1][1]), (101, rows[1][1] + " end"), (102, rows[2][1] + f"\n{passage.upper()}"), (103, rows[4][1] + "\nwrite to me@home.org or call +1 (974) 555-3436 please"), (None, rows[5][1]), (5, rows[5][1])]
    rows += [(200 + i, t) for i, t in enumerate(ODD_TEXTS)]
    table = docs(rows).withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sf = str(tmp_path)
    table.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[0][1](spark, table, sf).collect()]
    verdict = quality_rules.judge(table, quality_rules.line_model(table, labels))
    assert len(kept) == verdict.filter("kept").count()
    assert {i for i, _ in kept if i is not None and i < 60} == {i for i in range(60) if i % 3}
    texts = dict((str(i), t) for i, t in reversed(kept) if i is not None)
    left = {c: texts[c] for _, c in expected(kept)}
    left = {c: t for c, t in left.items() if passage.upper() not in t}
    left = {c: pii.cover(t, pii.base_spans(t)) for c, t in left.items()}
    e, want = encoder(tokenizer_path()), {}
    for c, t in left.items():
        want[int(c)] = e.whole(t) + b"\1\0\0\0"
    got = {}
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    assert got == want
    assert "<EMAIL>" in left["103"] and "<PHONE>" in left["103"] and "102" not in left and "100" not in left


def test_entry_lists_the_queries_only_with_the_subpackage(tmp_path):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(sorted(n for n in q if n.startswith('op') and n[2].isdigit()), 'pipeline' in q, set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout
    assert out.count("op") == 13 and out.strip().endswith("True True")
