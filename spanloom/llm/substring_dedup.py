"""Removal of long word passages that an earlier document holds, by suffix automata.

A window is ``WINDOW`` consecutive words. Its key is the least hash of its ``GRAM``-word
grams, so equal windows have equal keys wherever they stand. Consecutive windows of a text
with one key are a run; the words under a run are its context.

1. Runs of all texts: about one for every 22 words, without the words themselves.
2. Keys seen in one document only cannot repeat. The other runs are folded by context; a
   context belongs to the least document that holds it.
3. Contexts of one key are a reference shard. Its suffix automaton is built in a task, knows
   the least document of every stretch, and the shard's own contexts stream through it: the
   matching statistics give each window the least document that holds it.
4. A document loses every window whose least document is smaller than itself.

The corpus is its own reference and grows without bound, so shards are dealt to tasks by key
and never broadcast; ``remove_reference`` broadcasts the automata of a bounded reference. An
automaton takes some 700 bytes a word, so ``SHARD_WORDS`` words are about 300 MB in a task. A
key whose contexts hold more (a passage that very many documents share, each with other words
around it) is first cut to the windows whose hash occurs in two of its contexts, which leaves
few different contexts however many documents share it.

Words are runs of characters other than ASCII white space and are compared by 64-bit hash.
Null texts have no words. Null ids count as larger than all others; rows that repeat an id
are one document and remove nothing from each other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

from .chars import Block, Sums, map_texts
from .suffix_automaton import SuffixAutomaton

WINDOW = 50
GRAM = 8
SHARD_WORDS = 400_000
REFERENCE_WORDS = 2_000_000
NO_ID = (1 << 63) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPANS = "array<struct<first:bigint,last:bigint>>"


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), text.alias("text"))


def window_keys(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Least gram hash of each window of consecutive words."""
    n = len(words) - gram + 1
    low = Sums(words).hash(np.arange(n), np.arange(n) + gram) if n > 0 else np.zeros(0, np.uint64)
    wide, span = 1, window - gram + 1
    while 2 * wide <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    rest = span - wide
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def runs(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(key, context, doc_id, text_hash, start, n)``: runs of windows with one key."""
    def run(columns, texts):
        block = Block(texts)
        words, doc = block.words, block.word_doc
        key = window_keys(words, window, gram)
        at = np.arange(max(len(words) - window + 1, 0))
        inside = doc[at] == doc[at + window - 1] if len(at) else np.zeros(0, bool)
        at = at[inside]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (key[at[1:]] != key[at[:-1]]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
        first = np.flatnonzero(fresh)
        n = np.diff(np.append(first, len(at)))
        start = at[first]
        context = Sums(words).hash(start, start + n + window - 1)
        own = pa.array(doc[start])
        return key[start].view(np.int64), context.view(np.int64), columns["doc_id"].take(own), columns["text_hash"].take(own), start - block.word_at[doc[start]], n

    return map_texts(rows, run, "key long, context long, doc_id long, text_hash long, start long, n long")


def _contexts(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Word hashes of the wanted contexts, read from the documents that own them."""
    lists = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("key", "context", "start", "n")).alias("_want"))
    found = rows.join(lists, (rows["doc_id"] == lists["_id"]) & (rows["text_hash"] == lists["_hash"])).select("doc_id", "_want", "text")

    def run(columns, texts):
        words, at = (b := Block(texts)).words, b.word_at
        want, owner = columns["_want"], columns["doc_id"].to_pylist()
        out = []
        for i, row in enumerate(want.to_pylist()):
            for x in row:
                a = at[i] + x["start"]
                out.append((x["key"], x["context"], owner[i], words[a:a + x["n"] + window - 1].tobytes()))
        key, context, least, data = zip(*out) if out else ((), (), (), ())
        return pa.array(key, pa.int64()), pa.array(context, pa.int64()), pa.array(least, pa.int64()), pa.array(data, pa.binary())

    return map_texts(found, run, "key long, context long, least long, words binary")


def _busy(references: DataFrame, busy: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of busy keys cut to windows that two contexts share: folded pieces, and where they lie."""
    here = references.join(busy.select("key"), "key")

    def windows(batches):
        for batch in batches:
            out = []
            for k, c, w in zip(batch["key"].to_pylist(), batch["context"].to_pylist(), batch["words"].to_pylist()):
                words = np.frombuffer(w, np.uint64)
                at = np.arange(len(words) - window + 1)
                value = Sums(words).hash(at, at + window).view(np.int64)
                out.append(pa.table({"key": np.full(len(at), k), "context": np.full(len(at), c), "at": at, "value": value}))
            yield from pa.concat_tables(out).combine_chunks().to_batches() if out else []

    each = cut(here.select("key", "context", "words").mapInArrow(windows, "key long, context long, at long, value long"))
    twice = each.groupBy("key", "value").agg(F.min("context").alias("_a"), F.max("context").alias("_b")).filter("_a < _b").select("key", "value")
    places = each.join(twice, ["key", "value"]).groupBy("key", "context").agg(F.collect_list("at").alias("at"))

    def pieces(batches):
        for batch in batches:
            out = {n: [] for n in ("key", "context", "least", "offset", "piece", "words")}
            for k, c, least, w, at in zip(*(batch[n].to_pylist() for n in ("key", "context", "least", "words", "at"))):
                words, at = np.frombuffer(w, np.uint64), np.unique(at)
                edge = np.flatnonzero(np.diff(at) > 1) + 1
                for part in np.split(at, edge):
                    a, b = int(part[0]), int(part[-1]) + window
                    for n, v in zip(out, (k, c, least, a, int(Sums(words[a:b]).hash(np.array([0]), np.array([b - a])).view(np.int64)[0]), words[a:b].tobytes())):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.binary() if n == "words" else pa.int64()) for n in out]))

    found = cut(here.join(places, ["key", "context"]).select("key", "context", "least", "words", "at")
                .mapInArrow(pieces, "key long, context long, least long, offset long, piece long, words binary"))
    folded = found.groupBy("key", "piece").agg(F.min("least").alias("least"), F.min("words").alias("words"))
    return folded.select("key", F.col("piece").alias("context"), "least", "words"), found.select("key", "context", "offset", "piece", F.col("least").alias("own"))


def least_owners(references: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(key, context, first, last, least)``: windows of a context that a smaller document than its own holds."""
    total = references.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-total // (8 * shard_words)))

    def run(table):
        table = table.sort_by([("key", "ascending"), ("least", "ascending"), ("context", "ascending")])
        out = {n: [] for n in ("key", "context", "first", "last", "least")}
        keys = table["key"].to_numpy()
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        context, least, words = table["context"].to_pylist(), table["least"].to_pylist(), table["words"].to_pylist()
        for a, b in zip(bounds, bounds[1:]):
            if len(set(context[a:b])) < 2:  # one context: its own document is the least of all its windows
                continue
            texts = [np.frombuffer(w, np.uint64).tolist() for w in words[a:b]]
            automaton = SuffixAutomaton()
            for text, owner in zip(texts, least[a:b]):
                automaton.add(text, owner)
            automaton.close()
            for i, text in zip(range(a, b), texts):
                last = None
                for at, (n, owner) in enumerate(automaton.statistics(text, window)):
                    if n >= window and owner < least[i]:
                        first = at - window + 1
                        if last is not None and last == (first - 1, owner):
                            out["last"][-1] = first
                        else:
                            for name, v in zip(out, (int(keys[i]), context[i], first, first, owner)):
                                out[name].append(v)
                        last = (first, owner)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    dealt = references.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(run, "key long, context long, first long, last long, least long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, text_hash, spans)``: word ranges (both ends included) that a smaller document holds."""
    rows = _rows(docs)
    found = cut(runs(rows, window, gram))
    shared = found.groupBy("key").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).filter("_low < _high").select("key")
    found = cut(found.join(shared, "key"))
    owners = cut(found.groupBy("key", "context").agg(F.min(F.struct("doc_id", "text_hash", "start", "n")).alias("r")).select("key", "context", "r.*"))
    counts = owners.groupBy("key").agg(F.count("*").alias("_n"), F.sum(F.col("n") + window - 1).alias("_words"))
    # A key with one context needs no automaton.
    references = cut(_contexts(rows, owners.join(counts.filter("_n > 1"), "key"), window))
    busy = cut(counts.filter((F.col("_n") > 1) & (F.col("_words") > shard_words)))
    folded, places = _busy(references, busy, window)
    calm = least_owners(references.join(busy, "key", "left_anti"), window)
    pieces = least_owners(cut(folded), window).withColumnRenamed("context", "piece")
    folded_least = folded.select("key", F.col("context").alias("piece"), F.lit(0).cast("long").alias("first"), (F.floor(F.length("words") / 8) - window).cast("long").alias("last"), "least")
    in_busy = (places.join(pieces.unionByName(folded_least), ["key", "piece"]).filter("least < own")
               .select("key", "context", (F.col("first") + F.col("offset")).alias("first"), (F.col("last") + F.col("offset")).alias("last"), "least"))
    smaller = calm.unionByName(in_busy)
    own = owners.select("key", "context", F.col("doc_id").alias("_own"))
    whole = found.join(own, ["key", "context"])
    # Windows from `first` to `last` of a run cover the words up to `last` + window - 1.
    copied = whole.filter("_own < doc_id").select("doc_id", "text_hash", F.col("start").alias("first"), (F.col("start") + F.col("n") + window - 2).alias("last"))
    partly = (whole.filter("_own = doc_id").select("key", "context", "doc_id", "text_hash", "start").join(smaller, ["key", "context"])
              .select("doc_id", "text_hash", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + window - 1).alias("last")))
    return copied.unionByName(partly).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row; ``kept`` joins the words that stay by single spaces."""
    marks = spans.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "spans": "_spans"})
    rows = _rows(docs)
    joined = rows.join(marks, (rows["doc_id"] == marks["_id"]) & (rows["text_hash"] == marks["_hash"]), "left").select("doc_id", "_spans", "text")

    def run(columns, texts):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(texts, columns["_spans"].to_pylist()):
            words = _WORD.findall(text)
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [s["first"] for s in spans], 1)
                np.add.at(gone, [s["last"] + 1 for s in spans], -1)
                stay = np.cumsum(gone[:-1]) == 0
                left = [w for w, s in zip(words, stay.tolist()) if s]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(" ".join(left))
        ids = columns["doc_id"]
        return pa.compute.if_else(pa.compute.equal(ids, NO_ID), None, ids), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())

    return map_texts(joined, run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Every document without the windows that a smaller document holds."""
    return remove_spans(docs, repeated_spans(docs, window, **options))


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every document without its maximal stretches of ``window`` words or more that a reference text holds.

    The reference is cut into shards of whole texts, whose automata are broadcast one by one;
    it may hold ``REFERENCE_WORDS`` words at most, larger ones are refused.
    """
    count = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    held = reference.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").withColumn("_n", count).filter(F.col("_n") >= window)
    if (held.agg(F.sum("_n")).first()[0] or 0) > REFERENCE_WORDS:
        raise ValueError(f"the reference holds more than {REFERENCE_WORDS} words")
    texts = [r["text"] for r in held.select("text").collect()]
    shards, size = [SuffixAutomaton()], 0
    for text in sorted(texts):
        words = _WORD.findall(text)
        if size and size + len(words) > shard_words:
            shards, size = [*shards, SuffixAutomaton()], 0
        shards[-1].add(words, 0)
        size += len(words)
    sent = [docs.sparkSession.sparkContext.broadcast(s.close()) for s in shards]

    def run(columns, texts):
        spans = []
        for text in texts:
            words, own = _WORD.findall(text), []
            for shard in sent:
                for at, (n, _) in enumerate(shard.value.statistics(words, window)):
                    if n >= window:
                        own.append({"first": at - window + 1, "last": at})
            spans.append(own)
        return columns["doc_id"], columns["text_hash"], pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))

    found = map_texts(_rows(docs), run, f"doc_id long, text_hash long, spans {SPANS}").filter(F.size("spans") > 0)
    return remove_spans(docs, found.dropDuplicates(["doc_id", "text_hash"]))
