"""Document rules and line labels: counts of whole texts, and the share of content by Viterbi decoding.

Words are runs of characters other than the six ASCII white-space characters. A linear-chain
CRF over line features marks every line as content or boilerplate; a document is kept if it
passes the counting rules and content lines hold at least ``MIN_CONTENT`` of its characters.

Null and blank texts have no words and fail the counting rules. Repeated rows are judged
each. Without labels of both kinds there is no line model and the counting rules decide alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, labelled
from .chars import Block, Sums, map_texts, repeated, text_portions
from .lines import Lines

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
MIN_CONTENT = 0.5
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counts(block: Block, lines: Lines) -> list[np.ndarray]:
    """The five counts of each text of a block."""
    at = block.word_at
    per_line = np.zeros(block.n, np.int64)
    np.add.at(per_line, lines.doc, lines.earlier)
    symbols = np.zeros(block.n, np.int64)
    np.add.at(symbols, lines.doc, lines.symbols)
    words, doc = block.words, block.word_doc
    n = len(words) - WINDOW_WORDS + 1
    covered = np.zeros(len(words) + 1, np.int64)
    if n > 0:
        start = np.arange(n)
        whole = doc[:n] == doc[WINDOW_WORDS - 1:]
        start = start[whole]
        twice, _ = repeated(doc[start], Sums(words).hash(start, start + WINDOW_WORDS))
        np.add.at(covered, start[twice], 1)
        np.add.at(covered, start[twice] + WINDOW_WORDS, -1)
    return [np.diff(at), block.per_doc(block.end - block.start, at), symbols, per_line, block.per_doc(np.cumsum(covered[:-1]) > 0, at)]


def line_samples(rows: DataFrame, neighbours: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, line counts, labels and line lengths of the texts of a bounded sample, on the driver."""
    def run(columns, texts):
        block = Block(texts)
        lines = Lines(block)
        x = lines.with_neighbours() if neighbours else lines.features
        cut = list(zip(lines.first, lines.first + lines.count))
        return columns["_label"], [x[a:b].tobytes() for a, b in cut], [lines.chars[a:b].astype(np.int64).tobytes() for a, b in cut]

    got = map_texts(rows.select("text", F.col("_label").cast("long").alias("_label")), run, "_label long, features binary, chars binary").collect()
    got.sort(key=lambda r: (r["_label"], bytes(r["features"])))
    chars = [np.frombuffer(r["chars"], np.int64) for r in got]
    width = len(Lines(Block([])).features[0:0].T) * (3 if neighbours else 1)
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in got), np.float32).reshape(-1, width)
    return x, np.array([len(c) for c in chars], np.int64), np.array([r["_label"] for r in got], np.int64), np.concatenate(chars) if chars else np.zeros(0, np.int64)


def line_model(docs: DataFrame, labels: DataFrame, limit: int = labelled.SAMPLE_TEXTS) -> crf.Crf | None:
    """Content model from a bounded sample of quality labels; None if they are all of one kind."""
    x, count, good, _ = line_samples(labelled.sample(docs, labels, "quality", limit), neighbours=False)
    return crf.fit_from_texts(x, count, good) if len(set(good.tolist())) == 2 else None


def verdicts(texts: list[str], model: crf.Crf | None, min_content: float) -> list[np.ndarray]:
    """Counts, ``base_failed``, ``content_share`` and ``kept`` of each text."""
    block = Block(texts)
    lines = Lines(block)
    base = counts(block, lines)
    n_words, repeats = base[0], base[4]
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    total, content = np.zeros(block.n), np.zeros(block.n)
    good = model.decode(lines.features, lines.count) if model else np.ones(len(lines.start))
    np.add.at(total, lines.doc, lines.chars)
    np.add.at(content, lines.doc, lines.chars * good)
    share = content / np.maximum(total, 1)
    return [*base, failed, share, ~failed & (share >= min_content)]


def judge(docs: DataFrame, model: crf.Crf | None, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts, ``base_failed``, ``content_share`` and ``kept`` of every document."""
    def run(columns, texts):
        return [columns["doc_id"], *verdicts(texts, model, min_content)]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(texts, run, f"doc_id long, {COUNTS}, base_failed boolean, content_share double, kept boolean")


def keep(docs: DataFrame, model: crf.Crf | None, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    def run(batches):
        for batch in batches:
            for part, texts in text_portions(batch):
                yield part.filter(pa.array(verdicts(texts, model, min_content)[-1].tolist(), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
