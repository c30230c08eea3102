import random

import pytest

from spanloom.llm import decontamination as dc

from .conftest import ODD_TEXTS


def least_edits(window, text):
    """Edits between a window and the best stretch of a text (plain dynamic programme)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def letters(text):
    return "".join(c for c in text.lower() if c.isalnum())


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i:i + 1] = rng.choice([[], [rng.choice("abcde")], [out[i], rng.choice("abcde")]])
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_matches_equal_brute_force(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([4, 9, 16, 30])))) for i in range(5)]
    texts = []
    for _ in range(14):
        body = " ".join(rng.choices(words, k=25))
        item = rng.choice(items)[1]
        part = item[rng.randrange(1 + len(item) // 3):]
        texts.append(body[:60] + ". " + edited(part, rng.randint(0, 9), rng).upper() + " - " + body[60:])
    region, q = 24, 4
    index = dc.Index.build(items, q, region, dc.EDIT_RATE)
    got = index.matches(texts)
    for text, found in zip(texts, got):
        hits, own = {i for i, _, _ in found}, letters(text)
        for i, item in items:
            item = letters(item)
            n = min(len(item), region)
            k = int(dc.EDIT_RATE * n)
            every = [s for s in range(len(item) - n + 1) if least_edits(item[s:s + n], own) <= k]
            if i in hits:
                assert every
            # All windows of a run of matching starts that meets the grid are looked at.
            if any(s % dc.STRIDE == 0 for s in every):
                assert i in hits, (text, item)


@pytest.mark.parametrize("seed", range(4))
def test_edited_windows_at_every_start_equal_brute_force(seed):
    rng = random.Random(100 + seed)
    items = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.choice([30, 60, 101])))) for i in range(4)]
    texts = []
    for _ in range(30):
        item = rng.choice(items)[1]
        at = rng.choice([rng.randrange(len(item) - 23), len(item) - 24])
        texts.append("z" * 20 + edited(item[at:at + 24], 1, rng) + "y" * 20)
    for text, found in zip(texts, dc.Index.build(items, 4, 24, dc.EDIT_RATE).matches(texts)):
        want = {i for i, item in items if any(least_edits(item[s:s + 24], text) <= 1 for s in range(len(item) - 23))}
        assert want and {i for i, _, _ in found} == want, text


def test_regions_point_at_the_passage_and_clean_documents_stay(spark, docs):
    rng = random.Random(9)
    passage = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(20))
    other = " ".join("".join(rng.choice("mnopqrstuvwxyz") for _ in range(6)) for _ in range(200))
    bench = spark.createDataFrame([(7, passage), (8, passage), (9, "short"), (10, None), (11, ""), (None, "x" * 90)], "item_id long, text string")
    text = f"{other[:300]}\n{passage.upper().replace(' ', ' - ')}\n{other[300:]}"
    rows = [(1, text), (2, other), (1, other), (None, passage), (3, passage[:60])] + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    table = docs(rows)
    got = dc.find(table, bench).collect()
    assert len(got) == len(rows)
    by = sorted((str(r["doc_id"]), sorted({x["item_id"] for x in r["regions"]})) for r in got if r["regions"])
    assert by == [("1", [7, 8]), ("None", [7, 8])]
    for r in got:
        for x in r["regions"]:
            if r["doc_id"] == 1:
                assert len(letters(text[x["start"]:x["end"]])) >= dc.REGION and letters(text[x["start"]:x["end"]]) in letters(passage)
    left = dc.clean(table, bench)
    assert left.columns == table.columns and left.count() == len(rows) - 2
    assert dc.find(docs([]), bench).count() == 0 and all(not r["regions"] for r in dc.find(table, bench.limit(0)).collect())


def test_blocks_of_the_benchmark_give_the_same_regions(spark, docs, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(15))) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs([(i, f"lead in {t} and out {items[(i + 1) % 6][1]}") for i, t in items] + [(50, None), (0, "same id")])
    want = sorted((r["doc_id"], r["regions"]) for r in dc.find(table, bench).collect())
    monkeypatch.setattr(dc, "BLOCK_CHARS", 200)
    assert sorted((r["doc_id"], r["regions"]) for r in dc.find(table, bench).collect()) == want
    assert dc.clean(table, bench).count() == 2
