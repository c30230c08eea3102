import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.functions import anchors, text as tx
from spanloom.operators import discourse, evaluation as ev, islands, sentences as se
from spanloom.sources import outputs


def units(spark, rows):
    return spark.createDataFrame([(1, i + 1, i + 1, t, a, b) for i, (t, a, b) in enumerate(rows)],
                                 "source_id bigint, unit bigint, last_word bigint, text string, start_ms bigint, end_ms bigint")


def cut(spark, rows, block):
    by = None if block is None else F.floor(F.col("unit") / block)
    got = se.split_sentences(units(spark, rows), block=by).collect()
    return sorted((r["first_word"], r["last_word"], r["reason"]) for r in got)


@pytest.mark.parametrize("block", [None, 3])
def test_a_limit_reads_past_a_terminal_mark_to_the_next_pause(spark, block):
    rows, at = [], 0
    for t in ["abcde"] * 11 + ["k."]:
        rows.append((t, at, at + 100))
        at += 110
    rows += [("yy", at + 10, at + 60), ("zz", at + 400, at + 450)]
    assert cut(spark, rows, block) == [(1, 12, "terminal_punctuation"), (13, 14, "end_of_input")]


@pytest.mark.parametrize("block", [None, 2])
def test_a_pause_is_measured_from_the_latest_end(spark, block):
    assert cut(spark, [("a", 0, 5000), ("b", 100, 300), ("c", 1500, 1700)], block) == [(1, 3, "end_of_input")]


@pytest.mark.parametrize("block", [None, 4])
def test_reasons_of_the_length_rule(spark, block):
    def row(words, gap):
        out, at = [], 0
        for w in words:
            out.append((w, at, at + 100))
            at += 100 + gap
        return out
    assert cut(spark, row(["abcdefghij"] * 9, 20), block) == [(1, 5, "limit_without_boundary"), (6, 9, "end_of_input")]
    assert cut(spark, row(["abcdefghij"] * 2 + ["abcdefghi,"] + ["abcdefghij"] * 4, 20), block)[0] == (1, 3, "limit_at_soft_mark")
    assert cut(spark, row(["abcdefghij"] * 7, 120), block)[0] == (1, 5, "limit_at_upcoming_pause")
    assert cut(spark, row(["abcdefg"] * 3, 500), block)[0] == (1, 2, "pause")
    assert cut(spark, row(["abc"] * 3, 2000), block) == [(1, 1, "pause"), (2, 2, "pause"), (3, 3, "end_of_input")]


def table_counts(a, b):
    """Cheapest alignment by a full table; ties prefer the diagonal, then a deletion, then an insertion."""
    best = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = []
            if i and j:
                c, s, d, n, k = best[i - 1, j - 1]
                same = a[i - 1] == b[j - 1]
                options.append((c + (not same), 0, (s + (not same), d, n, k + same)))
            if i:
                c, s, d, n, k = best[i - 1, j]
                options.append((c + 1, 1, (s, d + 1, n, k)))
            if j:
                c, s, d, n, k = best[i, j - 1]
                options.append((c + 1, 2, (s, d, n + 1, k)))
            best[i, j] = (min(options)[0], *min(options)[2]) if options else (0, 0, 0, 0, 0)
    return best[len(a), len(b)][1:]


def test_alignment_counts_equal_a_full_table():
    rng = np.random.default_rng(4)
    pairs = [("".join(rng.choice(list("abé"), rng.integers(0, 12))), "".join(rng.choice(list("abé"), rng.integers(0, 12)))) for _ in range(150)]
    got = ev._align(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert [tuple(r) for r in got.itertuples(index=False)] == [table_counts(a, b) for a, b in pairs]


def quotes(spark, texts):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "source_id bigint, pos bigint, text string")
    return sorted((r["first_unit"], r["last_unit"], r["kind"]) for r in discourse.quotations(df).collect()) if texts else []


def test_quotations(spark):
    assert quotes(spark, ["“a", "b”", '"c"', 'd "', '" e']) == [(0, 1, "paired_quotation"), (3, 4, "paired_quotation")]
    got = discourse.quotations(spark.createDataFrame([(1, 0, "a” it's dogs' “b")], "source_id bigint, pos bigint, text string")).collect()
    assert {(r["first_unit"], r["last_unit"], r["kind"]) for r in got} == {(None, 0, "quotation_missing_opener"), (0, None, "quotation_missing_closer")}


def test_deep_quotations_keep_all_rows(spark):
    rows = [(1, 0, "“‘" * 40), (2, 0, "“x"), (2, 1, "y”")]
    got = discourse.quotations(spark.createDataFrame(rows, "source_id bigint, pos bigint, text string")).collect()
    assert sorted((r["source_id"], r["kind"]) for r in got) == [(1, "quotation_missing_closer")] * 80 + [(2, "paired_quotation")]


def test_equal_null_labels_are_one_run(spark):
    df = spark.createDataFrame([(1, i, None if i < 4 else "x") for i in range(6)], "source_id bigint, at bigint, label string")
    got = islands.label_runs(df, ["source_id"], ["at"], "label", "at", F.floor(F.col("at") / 2)).collect()
    assert sorted((r["start_ms"], r["n"]) for r in got) == [(0, 4), (4, 2)]


def test_conditional_tail_needs_no_consequence(spark):
    df = spark.createDataFrame([("如果明天下雨",), ("如果明天下雨就走",), ("要是如果去吗",)], "t string")
    assert [r[0] for r in df.select(tx.tail_signal(F.col("t"), tx.CHINESE)).collect()] == ["conditional_tail_needs_review", None, None]


def test_condition_cues_use_word_windows(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(["他", "说", "如果", "为什么", "这样", "的话", "呢"])], "source_id bigint, pos bigint, text string")
    got = anchors.condition_cues(words, words.where("pos in (3, 4)").select("source_id", "pos")).orderBy("pos").collect()
    assert [(r["before"], r["in_condition"]) for r in got] == [("他说如果", True), ("他说如果为什么", True)]


def test_a_cluster_must_name_the_shared_folder():
    class Fake:
        master = "spark://host:7077"
        conf = type("C", (), {"get": staticmethod(lambda *a: "")})()

        def getConf(self):
            return self.conf

        def getCheckpointDir(self):
            return None

        @property
        def sparkContext(self):
            return self

    with pytest.raises(ValueError):
        session.shared_folder(Fake())


def test_written_subtitles_read_back_in_order(spark, tmp_path):
    blocks = spark.createDataFrame([(e, n, f"{n}\ntext {e}\n") for e in (2, 1) for n in (3, 1, 2)], "edl_id bigint, number bigint, block string")
    outputs.write_subtitles(blocks, str(tmp_path / "s"))
    assert outputs.subtitle_text(spark, str(tmp_path / "s"), 1) == "1\ntext 1\n\n2\ntext 1\n\n3\ntext 1\n"
    with pytest.raises(Exception):
        outputs.write_subtitles(blocks, str(tmp_path / "s"))


def test_a_page_says_whether_more_follow(spark):
    records = spark.createDataFrame([(i, i, i != 2) for i in range(6)], "id bigint, instant bigint, readable boolean")
    first = outputs.history_page(records, limit=2, offset=0).collect()
    assert [(r["id"], r["place"], r["more"], r["unavailable_count"]) for r in first] == [(5, 1, True, 1), (4, 2, True, 1)]
    assert [(r["id"], r["more"]) for r in outputs.history_page(records, limit=2, offset=3).collect()] == [(1, False), (0, False)]


def test_pairs_of_one_table_have_the_counts_of_single_pairs(monkeypatch):
    import random
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc é") for _ in range(r.randrange(n)))
    pairs = [(word(60), word(60)) for _ in range(300)] + [("", ""), ("", "ab"), ("ab", ""), (word(900), "b"), ("b", word(900))]
    one = [ev._counts(*(np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in p)).tolist() for p in pairs]
    monkeypatch.setattr(ev, "_counts", None)
    assert ev._align(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])).to_numpy().tolist() == one
