"""Similar texts, topics and labels of bounded sources, found where the texts of a source lie.

The operators in ``topics`` spread the items of a source over the cluster as rows of terms and pairs. A source that
is one input row has few items: one task reads its texts once, keeps a sparse vector an item, and compares an item
with those that share a term with it. Nothing is dealt but the texts. Results equal those of ``topics``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .grouped import Rows, map_groups

KEY = ["source_id"]
SCALE = 1e10
PARTS = re.compile(r"[一-鿿]+|[a-z]+|[0-9]+(?:\.[0-9]+)?")


def _folded(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").casefold()


def _terms(folded: str, stop: frozenset[str]) -> list[str]:
    """``tx.folded_terms`` of one text."""
    out = []
    for part in PARTS.findall(folded):
        if part[0] >= "一":
            out += [g for n in (2, 3) for i in range(len(part) - n + 1) if (g := part[i:i + n]) not in stop]
        elif part not in stop:
            out.append(part)
    return out


class Vectors:
    """Weighted terms of the items of one source; products are summed as integers, as in ``topics``."""

    def __init__(self, texts: list[str | None], lexicon: tx.Lexicon):
        self.folded = [_folded(t) for t in texts]
        stop, codes, items, terms, counts = frozenset(lexicon.stop), {}, [], [], []
        for i, text in enumerate(self.folded):
            held = Counter(_terms(text, stop))
            items += [i] * len(held)
            terms += [codes.setdefault(t, len(codes)) for t in held]
            counts += held.values()
        self.n, self.names = len(texts), list(codes)
        self.item, self.term = np.array(items, np.int64), np.array(terms, np.int64)
        df = np.bincount(self.term, minlength=len(codes)) if len(terms) else np.zeros(0, np.int64)
        # Logarithms come from a table of their few arguments.
        idf = {d: 1 + log((1 + self.n) / (1 + d)) for d in set(df.tolist())}
        tf = {c: 1 + log(c) for c in set(counts)}
        self.weight = np.array([tf[c] * idf[d] for c, d in zip(counts, df[self.term].tolist())], np.float64)
        self.norm = np.zeros(self.n, np.int64)
        np.add.at(self.norm, self.item, np.rint(self.weight * self.weight * SCALE).astype(np.int64))
        # Rows lie by item; ``line`` names them by term, each term's rows by item.
        self.begin = np.searchsorted(self.item, np.arange(self.n + 1))
        self.line = np.argsort(self.term, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.place = np.empty(len(self.line), np.int64)
        self.place[self.line] = np.arange(len(self.line))

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items ``a < b`` with a cosine of at least ``threshold``, and the cosine."""
        found = []
        for a in range(self.n):
            own = np.arange(self.begin[a], self.begin[a + 1])
            # The later holders of a term stand behind the item's own place in the term's line.
            low, high = self.place[own] + 1, self.first[self.term[own] + 1]
            size = high - low
            total = int(size.sum())
            if not total:
                continue
            rows = self.line[np.repeat(low - np.cumsum(size) + size, size) + np.arange(total)]
            dot = np.zeros(self.n - a, np.int64)
            np.add.at(dot, self.item[rows] - a, np.rint(np.repeat(self.weight[own], size) * self.weight[rows] * SCALE).astype(np.int64))
            b = np.flatnonzero(dot)
            cosine = np.minimum(1.0, dot[b] / (np.sqrt(self.norm[a].astype(float)) * np.sqrt(self.norm[a + b].astype(float))))
            cosine = np.rint(cosine * 1e9) / 1e9
            near = cosine >= threshold
            found.append((np.full(int(near.sum()), a), a + b[near], cosine[near]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def twins(self, pairs: tuple, lexicon: tx.Lexicon, threshold: float) -> np.ndarray:
        """Which of the ``pairs`` are nearly equal texts; the ratio is only taken of what its upper bounds let through."""
        negation = re.compile(lexicon.negation.replace(r"\d", "[0-9]"))
        forms: dict[int, tuple[str, list[str]]] = {}

        def form(i: int) -> tuple[str, list[str]]:
            if i not in forms:
                forms[i] = re.sub(r"[^一-鿿a-z0-9]", "", self.folded[i]), sorted(m.group(0) for m in negation.finditer(self.folded[i]))
            return forms[i]

        keep = np.zeros(len(pairs[0]), bool)
        for k in np.flatnonzero(pairs[2] >= threshold):
            (ca, ga), (cb, gb) = form(int(pairs[0][k])), form(int(pairs[1][k]))
            small, big = sorted((len(ca), len(cb)))
            if small < 20 or small * 10 < big * 9 or ga != gb:
                continue
            m = SequenceMatcher(None, ca, cb, autojunk=False)
            keep[k] = ca == cb or (m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold)
        return keep

    def label(self, members: list[int], k: int) -> str | None:
        """Up to ``k`` terms that all ``members`` share, heaviest first, none inside another."""
        rows = np.concatenate([np.arange(self.begin[i], self.begin[i + 1]) for i in members])
        unit = np.rint(self.weight[rows] / np.sqrt(self.norm[self.item[rows]] / SCALE) * SCALE).astype(np.int64)
        term, at, n = np.unique(self.term[rows], return_inverse=True, return_counts=True)
        total = np.zeros(len(term), np.int64)
        np.add.at(total, at, unit)
        shared = [(-int(total[i]), -len(self.names[term[i]]), self.names[term[i]]) for i in np.flatnonzero(n == len(members))]
        picked: list[str] = []
        for _, _, name in sorted(shared):
            if len(picked) == k:
                break
            if not any(name in p or p in name for p in picked):
                picked.append(name)
        return " · ".join(picked) if shared else None


def complete_link(item: np.ndarray, other: np.ndarray, sim: np.ndarray, *, first_fit: bool) -> dict[int, int]:
    """Head of every item's group; rows lie by ``item`` and name linked earlier items, or none (null)."""
    head: dict[int, int] = {}
    size: Counter = Counter()
    cuts = np.concatenate([[0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        linked: dict[int, list[float]] = {}
        for k in range(a, b):
            if other[k] is not None and other[k] == other[k]:
                linked.setdefault(head[int(other[k])], []).append(float(sim[k]))
        full = [(min(s), -g) for g, s in linked.items() if len(s) == size[g]]
        if full:
            chosen = min(-g for _, g in full) if first_fit else -max(full)[1]
        else:
            chosen = int(item[a])
        head[int(item[a])] = chosen
        size[chosen] += 1
    return head


def _linked(items: np.ndarray, item: np.ndarray, other: np.ndarray, sim: np.ndarray, first_fit: bool) -> np.ndarray:
    """Heads of ``items``, in their order, under the links ``item`` to ``other``."""
    who = np.concatenate([items, item]).astype(np.int64)
    to = np.concatenate([np.full(len(items), np.nan), other])
    order = np.lexsort((to, who))
    head = complete_link(who[order], to[order], np.concatenate([np.full(len(items), np.nan), sim])[order], first_fit=first_fit)
    return np.array([head[int(i)] for i in items], np.int64)


def _groups(v: Vectors, lexicon: tx.Lexicon, threshold: float, twin_threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and topic of every item, as item numbers; see ``topics.group_topics``."""
    everyone = np.arange(v.n)
    a, b, sim = pairs = v.pairs(min(threshold, twin_threshold))
    twin = v.twins(pairs, lexicon, twin_threshold)
    cluster = _linked(everyone, b[twin], a[twin], np.ones(int(twin.sum())), True)
    size = np.bincount(cluster, minlength=v.n)
    near = (sim >= threshold) & (cluster[a] != cluster[b])
    ca, cb, sim = cluster[a[near]], cluster[b[near]], sim[near]
    high, low = np.maximum(ca, cb), np.minimum(ca, cb)
    ident, at, n = np.unique(high * v.n + low, return_inverse=True, return_counts=True)
    least = np.full(len(ident), np.inf)
    np.minimum.at(least, at, sim)
    high, low = ident // max(v.n, 1), ident % max(v.n, 1)
    # Two clusters are linked only if all pairs between them are.
    whole = n == size[high] * size[low]
    heads = np.flatnonzero(size)
    topic = np.zeros(v.n, np.int64)
    topic[heads] = _linked(heads, high[whole], low[whole], least[whole], False)
    return cluster, topic[cluster]


def _per_source(items: DataFrame, ident: str, rule, schema: str, placed: bool) -> DataFrame:
    rows = items.select("source_id", F.col(ident).cast("bigint").alias("_id"), "text")
    return map_groups(rows, KEY, ["_id"], rule, "source_id bigint, " + schema, placed=placed)


def _source(rows: Rows, n: int) -> np.ndarray:
    return np.repeat(rows["source_id"][:1], n)


def similar_pairs(items: DataFrame, ident: str, lexicon: tx.Lexicon, threshold: float, *, placed: bool = False) -> DataFrame:
    """``topics.similar_pairs`` of bounded sources."""
    def rule(r: Rows) -> Rows:
        a, b, sim = Vectors(r["text"].tolist(), lexicon).pairs(threshold)
        return {"source_id": _source(r, len(a)), "a": r["_id"][a], "b": r["_id"][b], "similarity": sim}

    return _per_source(items, ident, rule, "a bigint, b bigint, similarity double", placed)


def near_duplicates(items: DataFrame, ident: str, lexicon: tx.Lexicon, *, threshold: float = 0.92, placed: bool = False) -> DataFrame:
    """``topics.near_duplicates`` of bounded sources."""
    def rule(r: Rows) -> Rows:
        v = Vectors(r["text"].tolist(), lexicon)
        a, b, sim = pairs = v.pairs(threshold)
        twin = v.twins(pairs, lexicon, threshold)
        return {"source_id": _source(r, int(twin.sum())), "a": r["_id"][a[twin]], "b": r["_id"][b[twin]], "similarity": sim[twin]}

    return _per_source(items, ident, rule, "a bigint, b bigint, similarity double", placed)


def group_topics(items: DataFrame, lexicon: tx.Lexicon, *, threshold: float = 0.28, twin_threshold: float = 0.92, placed: bool = False) -> DataFrame:
    """``topics.group_topics`` of bounded sources."""
    def rule(r: Rows) -> Rows:
        cluster, topic = _groups(Vectors(r["text"].tolist(), lexicon), lexicon, threshold, twin_threshold)
        return {"source_id": r["source_id"], "duplicate_of": r["_id"][cluster], "rank": r["_id"], "topic": r["_id"][topic]}

    return _per_source(items, "rank", rule, "duplicate_of bigint, rank bigint, topic bigint", placed)


def topic_labels(items: DataFrame, lexicon: tx.Lexicon, k: int = 3, *, threshold: float = 0.28, twin_threshold: float = 0.92,
                 placed: bool = False) -> DataFrame:
    """``topics.topic_labels`` of the topics of bounded sources; the vectors that found the topics also name them."""
    def rule(r: Rows) -> Rows:
        v = Vectors(r["text"].tolist(), lexicon)
        members: dict[int, list[int]] = {}
        for i, t in enumerate(_groups(v, lexicon, threshold, twin_threshold)[1].tolist()):
            members.setdefault(t, []).append(i)
        topics = r["_id"][np.array(list(members), np.int64)]
        labels = [v.label(m, k) or f"#{t}" for t, m in zip(topics.tolist(), members.values())]
        return {"source_id": _source(r, len(topics)), "topic": topics, "members": np.array([len(m) for m in members.values()], np.int64),
                "label": np.array(labels, dtype=object)}

    return _per_source(items, "rank", rule, "topic bigint, members bigint, label string", placed)


def window_items(windows: DataFrame, sentences: DataFrame) -> DataFrame:
    """``source_id, rank, text`` of the chosen ``windows`` of bounded sources: one shuffle brings them to their sentences.

    The items of a source come out in one partition (``placed``).
    """
    lines = sentences.select("source_id", F.col("pos").alias("first_pos"), F.lit(None).cast("bigint").alias("last_pos"),
                             F.lit(None).cast("bigint").alias("rank"), "text", F.lit(0).alias("_kind"))
    asked = windows.select("source_id", "first_pos", "last_pos", "rank", F.lit(None).cast("string").alias("text"), F.lit(1).alias("_kind"))

    def rule(r: Rows) -> Rows | None:
        cut = int(np.searchsorted(r["_kind"], 1))
        if cut == len(r["_kind"]):
            return None
        pos, text = r["first_pos"][:cut], r["text"][:cut]
        low = np.searchsorted(pos, r["first_pos"][cut:].astype(np.int64))
        high = np.searchsorted(pos, r["last_pos"][cut:].astype(np.int64), side="right")
        shown = np.array(["\n".join(text[a:b]) for a, b in zip(low, high)], dtype=object)
        return {"source_id": r["source_id"][cut:], "rank": r["rank"][cut:], "text": shown}

    return map_groups(lines.unionByName(asked), KEY, ["_kind", "first_pos", "rank"], rule, "source_id bigint, rank bigint, text string")
