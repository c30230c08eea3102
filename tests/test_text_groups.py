"""Texts of bounded sources are compared where they lie, with the results of the operators that deal them."""

import random

import pytest

import __spark_entry__ as entry
from spanloom.functions import text as tx
from spanloom.operators import text_groups as tg, topics as tp
from test_placement import exchanges, only_by_source


def items(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "not", "12.5", "7", "我们目前在工作", "Straße", "ＡＢＣ", "the"]
    rows = []
    for source in (1, 2, 3):
        texts = [" ".join(r.choices(words, k=r.randint(1, 14))) for _ in range(30)]
        texts += [t + " eta" for t in texts[:6]] + [" ".join([t, "no"]) for t in texts[:4]] + ["", "?!"]
        rows += [(source, 3 * i + 2, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "source_id long, rank long, text string")


def found(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_texts_of_bounded_sources_give_the_same_pairs_topics_and_labels(spark):
    df = items(spark)
    assert found(tg.similar_pairs(df, "rank", tx.LATIN, 0.3)) == found(tp.similar_pairs(df, "rank", tx.LATIN, 0.3)) != []
    assert found(tg.near_duplicates(df, "rank", tx.LATIN)) == found(tp.near_duplicates(df, "rank", tx.LATIN)) != []
    groups = tp.group_topics(df, tx.LATIN)
    assert found(tg.group_topics(df, tx.LATIN)) == found(groups)
    assert found(tg.topic_labels(df, tx.LATIN)) == found(tp.topic_labels(groups, df, tx.LATIN)) != []


@pytest.mark.parametrize("name", ["near_duplicates", "lexical_topics", "topic_labels"])
def test_topics_of_documents_deal_texts_only_and_store_nothing(spark, monkeypatch, name):
    from spanloom import session

    def refuse(df):
        raise AssertionError("a table was written")

    monkeypatch.setattr(session, "cut", refuse)
    monkeypatch.setattr(tp, "cut", refuse)
    plan = exchanges(entry.queries()[name](spark, entry.SMOKE_DIR))
    assert only_by_source(plan), plan


def test_terms_of_similar_sentences_are_not_dealt(spark):
    plan = exchanges(entry.queries()["similar_pairs"](spark, entry.SMOKE_DIR))
    assert plan and not any("term#" in line for line in plan), plan
