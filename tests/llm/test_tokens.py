import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings, strategies as st

from spanloom.llm import packing, token_counts
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.tokens import encoder

from .conftest import ODD_TEXTS


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t,.'#sST1aé́Σσ \x1c")), max_size=60), max_size=4))
@example(["A\nĀ", "Über “Äpfel” It'S Ā ÀB,"])
def test_cached_ids_equal_the_tokenizer(texts):
    e = encoder(tokenizer_path())
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_pieces_cover_every_id_once(docs):
    rows = list(enumerate(ODD_TEXTS)) + [(3, "again"), (3, "again"), (None, "no id")]
    got = packing.pack(docs(rows), tokenizer_path(), window=64).collect()
    e = encoder(tokenizer_path())
    want = sorted((i if i is not None else -1, e.whole(t or "") + b"\1\0\0\0") for i, t in rows)
    whole = {}
    for r in sorted(got, key=lambda r: r["start"]):
        whole.setdefault((r["doc_id"] if r["doc_id"] is not None else -1, r["doc_tokens"]), []).append(bytes(r["ids"]))
        assert len(r["ids"]) == 4 * r["length"]
    assert sum(len(b) for v in whole.values() for b in v) == sum(len(b) for _, b in want)
    for i, data in want:
        if i != 3:
            assert b"".join(whole[(i, len(data) // 4)]) == data
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in by.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))]
        assert sum(n for _, n in spots) <= 64


def test_packer_takes_the_level_with_the_least_sum_of_squares():
    rng, b = np.random.default_rng(1), 32
    packer, fill = packing.Packer(b), {}
    for size in rng.integers(1, b + 1, 400):
        counts = np.bincount([f for f in fill.values() if f < b], minlength=b + 1)
        best = {}
        for level in [0, *sorted({f for f in fill.values() if f + size <= b})]:
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < b
            best[level] = int((after[1:b] ** 2).sum())
        number, offset = packer.put(int(size))
        assert best[offset] == min(best.values())
        assert fill.get(number, 0) == offset
        fill[number] = offset + int(size)
    assert sum(b - f for f in fill.values()) < 0.1 * sum(fill.values())


def test_packing_an_empty_table(docs):
    assert packing.pack(docs([]), tokenizer_path()).count() == 0


def test_crc_of_ids(docs):
    row = packing.pieces(docs([(1, "a b")]), tokenizer_path()).select("ids", packing.ids_crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(bytes(row["ids"]))


def test_histogram_answers_equal_brute_force(spark, docs):
    rows = list(enumerate(ODD_TEXTS * 2))
    hist = token_counts.histogram(token_counts.lengths(docs(rows), tokenizer_path()))
    n = [len(encoder(tokenizer_path()).whole(t or "")) // 4 for _, t in rows]
    sums = token_counts.suffix_sums(hist)
    for r in sums.collect():
        at = r["length"]
        assert (r["n_docs"], r["docs_from"], r["ids_from"]) == (n.count(at), sum(x >= at for x in n), sum(x for x in n if x >= at))
        assert (r["total_docs"], r["total_ids"], r["ids_cut"]) == (len(n), sum(n), sum(min(x, at) for x in n))
        assert r["rank"] == pytest.approx(sum(x <= at for x in n) / len(n))
    for r in token_counts.at_limits(hist, [0, 1, 3, 10**6]).collect():
        assert (r["docs_fit"], r["ids_cut"]) == (sum(x <= r["context"] for x in n), sum(min(x, r["context"]) for x in n))
    got = {r["share"]: r["length"] for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert got == {p: sorted(n)[int(np.ceil(p * len(n))) - 1] for p in (0.1, 0.5, 1.0)}
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs([]), tokenizer_path()))).count() == 0
