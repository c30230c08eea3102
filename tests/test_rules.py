import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spanloom.functions import text as tx, times as tm
from spanloom.operators import editing as ed, evaluation as ev, sentences as sn, topics as tp, windows as wn


def test_windows_match_the_hand_fixture(spark):
    s = spark.createDataFrame([(1, 1, 0, 10000, "a"), (1, 2, 10000, 20000, "b"), (1, 3, 20000, 30000, "c")],
                              "source_id long, pos long, start_ms long, end_ms long, text string")
    f = wn.sentence_features(s, tx.LATIN)
    want = [(0, 20000), (0, 30000), (10000, 30000)]
    for bounded in (False, True):
        got = wn.sentence_windows(f, bounded=bounded).orderBy("start_ms", "end_ms").collect()
        assert [(r["start_ms"], r["end_ms"]) for r in got] == want


def test_overlong_sentence_is_skipped_and_blocks_nothing(spark):
    s = spark.createDataFrame([(1, 1, 0, 91000, "a"), (1, 2, 92000, 110000, "b")], "source_id long, pos long, start_ms long, end_ms long, text string")
    got = wn.sentence_windows(wn.sentence_features(s, tx.LATIN)).collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(92000, 110000)]


def test_blocked_and_bounded_scores_agree(spark):
    r = random.Random(4)
    data, t = [], 0
    for i in range(1, 80):
        d = r.randrange(2000, 9000)
        data.append((1, i, t, t + d, r.choice(["what is the", "because so", "for and the end", "plain words", "why not"])))
        t += d + r.choice([20, 450, 3600])
    s = spark.createDataFrame(data, "source_id long, pos long, start_ms long, end_ms long, text string")
    a = wn.score_rule(wn.sentence_features(s, tx.LATIN, block_rows=5)).collect()
    b = wn.score_rule(wn.sentence_features(s, tx.LATIN, block_rows=None), bounded=True).collect()
    assert len(a) > 100 and sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_sentence_rule_reasons(spark):
    text = ["Hello", "there.", "one,"] + ["wordword"] * 6 + ["tail"]
    data, t = [], 0
    for i, w in enumerate(text, 1):
        data.append((1, i, w, t, t + 300))
        t += 320
    data.append((1, len(text) + 1, "after", t + 1500, t + 1700))
    words = spark.createDataFrame(data, "source_id long, pos long, text string, start_ms long, end_ms long")
    got = sn.split_sentences(sn.token_units(words)).orderBy("first_word").collect()
    assert got[0]["reason"] == "terminal_punctuation" and got[0]["last_word"] == 2
    assert got[-1]["reason"] == "end_of_input" and got[-2]["reason"] == "pause"
    covered = [w for g in got for w in range(g["first_word"], g["last_word"] + 1)]
    assert covered == list(range(1, len(data) + 1))


def test_cut_matching_on_the_hand_fixture_and_against_brute_force(spark):
    cases = {1: ([30, 60], [27, 32, 64]), 2: ([10, 14], [7, 11])}
    r = random.Random(8)
    for k in range(3, 12):
        cases[k] = (sorted(r.sample(range(1, 60), 9)), sorted(r.sample(range(1, 60), 8)))
    flat = lambda side: [(k, f) for k, v in cases.items() for f in v[side]]
    got = ev.match_cuts(spark.createDataFrame(flat(0), "source_id long, frame long"), spark.createDataFrame(flat(1), "source_id long, frame long")).collect()
    tp_ = {k: sum(g["outcome"] == "match" and g["source_id"] == k for g in got) for k in cases}
    assert tp_[1] == 1 and tp_[2] == 2

    def best(ref, pred):
        if not ref or not pred:
            return 0
        return max(best(ref[1:], pred), max((1 + best(ref[1:], pred[j + 1:]) for j, p in enumerate(pred) if abs(p - ref[0]) <= 3), default=0))

    assert all(tp_[k] == best(*v) for k, v in cases.items())
    assert len(got) == sum(len(a) + len(b) for a, b in cases.values()) - sum(tp_.values())


def test_edit_alignment_counts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(0, 12)))
    df = spark.createDataFrame([(word(), word()) for _ in range(60)], "a string, b string")
    for row in df.select("a", "b", ev.edit_counts("a", "b").alias("c"), F.levenshtein("a", "b").alias("d")).collect():
        c = row["c"]
        assert c["substitutions"] + c["deletions"] + c["insertions"] == row["d"]
        assert c["substitutions"] + c["deletions"] + c["correct"] == len(row["a"])


def test_similar_pairs_equal_all_pairs(spark):
    r = random.Random(6)
    vocabulary = [f"w{c}" .replace("w", "ab") + "xyz"[i % 3] for i, c in enumerate("abcdefghij")]
    docs = [(1, i, " ".join(r.choice(vocabulary) for _ in range(8))) for i in range(40)]
    docs += [(1, 100 + i, docs[i][2] + " " + vocabulary[0]) for i in range(5)]
    df = spark.createDataFrame(docs, "source_id long, id long, text string")
    fast = tp.similar_pairs(df, "id", tx.LATIN, 0.8).collect()
    full = tp.similar_pairs(df, "id", tx.LATIN, 0.8, prefix=False).collect()
    assert fast and sorted(map(tuple, fast)) == sorted(map(tuple, full))


def test_near_duplicates_fold_copies_but_not_negations(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    docs = [(1, 1, base), (1, 2, base + " phi"), (1, 3, base + " not"), (1, 4, "something else entirely with other words")]
    df = spark.createDataFrame(docs, "source_id long, id long, text string")
    got = [(r["a"], r["b"]) for r in tp.near_duplicates(df, "id", tx.LATIN).collect()]
    assert got == [(1, 2)]
    assert SequenceMatcher(None, tx_compact(docs[0][2]), tx_compact(docs[1][2]), autojunk=False).ratio() >= 0.92


def tx_compact(text):
    return "".join(c for c in text.lower() if c.isalnum())


def test_topic_groups_are_complete_link(spark):
    items = [(1, 1, "apple banana cherry"), (1, 2, "apple banana grape"), (1, 3, "engine wheel brake"), (1, 4, "engine wheel motor"), (1, 5, "apple engine bridge")]
    df = spark.createDataFrame(items, "source_id long, rank long, text string")
    got = {r["rank"]: r["topic"] for r in tp.group_topics(df, tx.LATIN).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3]


def plain_topics(items):
    """Sequential complete-link rule over the items of one source: topic by rank."""
    from collections import Counter
    from math import log, sqrt

    counts = {r: Counter(t.split()) for r, t in items}
    df = Counter(w for c in counts.values() for w in c)
    vectors = {r: {w: (1 + log(n)) * (1 + log((1 + len(items)) / (1 + df[w]))) for w, n in c.items()} for r, c in counts.items()}
    sim = {(a, b): sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) / sqrt(sum(x * x for x in vectors[a].values()) * sum(x * x for x in vectors[b].values()))
           for a in vectors for b in vectors}
    groups, topic = [], {}
    for r in sorted(vectors):
        fits = [(min(sim[r, o] for o in g), -i) for i, g in enumerate(groups) if min(sim[r, o] for o in g) >= 0.28]
        if fits:
            groups[-max(fits)[1]].append(r)
        else:
            groups.append([r])
    for g in groups:
        topic |= dict.fromkeys(g, g[0])
    return topic


def test_topic_groups_of_many_items_equal_the_sequential_rule(spark):
    r = random.Random(5)
    sources = {}
    for source in (1, 2):
        words = [[f"{c}{d}{chr(97 + source)}" for d in "abcdef"] for c in ("k", "m", "p", "r")]
        sources[source] = [(i, " ".join(r.sample(r.choice(words), 3))) for i in range(3, 40)]
    df = spark.createDataFrame([(s, i, t) for s, x in sources.items() for i, t in x], "source_id long, rank long, text string")
    got = {(x["source_id"], x["rank"]): x["topic"] for x in tp.group_topics(df, tx.LATIN).collect()}
    assert got == {(s, i): t for s, x in sources.items() for i, t in plain_topics(x).items()}


def test_topics_see_every_window_that_survives_the_overlap(spark, tmp_path):
    from spanloom.plans import load_catalog

    load_catalog()
    from spanloom.plans import selection_queries as sq, topic_queries as tq

    r = random.Random(6)
    words = ["".join(r.choice("bcdfgklmnp") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    text = " ".join(" ".join(r.choices(words, k=9)) + "." for _ in range(90))
    spark.createDataFrame([(1, text), (2, text[:3000])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    kept = {x["source_id"]: x["n"] for x in sq.window_nms(spark, sf).where("retained").groupBy("source_id").agg(F.count("*").alias("n")).collect()}
    assert kept[1] > 5
    topics = tq.lexical_topics(spark, sf).groupBy("source_id").agg(F.count("*").alias("n")).collect()
    assert {x["source_id"]: x["n"] for x in topics} == kept


def test_two_lines_break_at_the_middle_word_edge():
    shown, flags = ed.two_lines(["aaaa"] * 11, [4] * 11, 36, 2)
    assert [len(x) for x in shown.split("\n")] == [20, 24] and not flags
    assert ed.two_lines(["short"], [5], 36, 2) == ("short", [])
    assert "word_layout_split" in ed.two_lines(["x" * 60], [60], 36, 2)[1]


def test_frames_and_time_codes(spark):
    row = spark.range(1).select(tm.frame_half_up(F.lit(50)).alias("a"), tm.frame_half_up(F.lit(49)).alias("b"), tm.timecode_frame(F.lit("00:00:10:05")).alias("c"),
                                tm.timecode_frame(F.lit("00:00:10:30")).alias("d"), tm.clock(F.lit(3661001), 1000).alias("e")).first()
    assert tuple(row) == (2, 1, 305, None, "01:01:01,001")
