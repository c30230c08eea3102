"""Texts of an Arrow batch are worked on slice by slice."""

import tracemalloc

import pyarrow as pa

from spanloom.llm import pii
from spanloom.llm.chars import BATCH_CHARS, map_texts, text_portions


class Caught:
    """Keeps the function that a table would be mapped by."""

    columns = ["doc_id", "text"]

    def mapInArrow(self, run, schema):
        return run


def test_only_the_strings_of_one_slice_exist_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"{i:05d}" * 2000 for i in range(2000)])], names=["doc_id", "text"])
    run = map_texts(Caught(), lambda columns, texts: [columns["doc_id"], pa.array([len(t) for t in texts])], "doc_id long, n long")
    tracemalloc.start()
    rows = sum(out.num_rows for out in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 5_000_000


def test_slices_hold_every_row_once_in_order():
    texts = [None, "", "é" * BATCH_CHARS, "a", None, "語" * (BATCH_CHARS + 5), *["x" * 999] * 700, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(text_portions(batch))
    assert [t for _, own in parts for t in own] == [t or "" for t in texts]
    assert [i for part, _ in parts for i in part.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(len(own) == part.num_rows and (len(own) == 1 or sum(map(len, own)) <= BATCH_CHARS) for part, own in parts)
    assert list(text_portions(batch.slice(0, 0))) == []


def test_redaction_keeps_null_texts_null(spark, docs):
    table = docs([(1, None), (2, ""), (3, "write to anna.bell@example.org today"), (None, "nothing")])
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in pii.redact(table).collect()), key=lambda r: r[0])
    assert got == [(0, "nothing"), (1, None), (2, ""), (3, "write to <EMAIL> today")]
