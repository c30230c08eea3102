"""Line features of whole texts, computed for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .chars import Block, repeated

SYMBOLS = "#*$%&|<>"
UPPER, LETTER, DIGIT, SYMBOL, SHOUT, STOP, OTHER, SPACE = range(8)
NAMES = ("log_chars", "log_words", "upper", "digits", "symbols", "shouts", "stops", "others", "letters_per_word", "short_words", "same_word", "earlier_line", "blank")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point; beyond the first planes' alphabets everything counts as a letter."""
    table = np.full(0x110000, LETTER, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = (SPACE if ch.isspace() else DIGIT if ch.isdigit() else SYMBOL if ch in SYMBOLS else SHOUT if ch in "!?" else
                    STOP if ch in ".,;:" else UPPER if ch.isupper() else LETTER if ch.isalpha() else OTHER)
    return table


class Lines:
    """Lines of a block: bounds, text number, and one feature row each."""

    def __init__(self, block: Block):
        self.start, self.end, self.doc = block.lines()
        self.count = np.bincount(self.doc, minlength=block.n) if len(self.doc) else np.zeros(block.n, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.chars = self.end - self.start
        kind = classes()[block.cp]

        def share(k):
            sums = np.zeros(len(kind) + 1, np.int64)
            np.cumsum(kind == k, out=sums[1:])
            return sums[self.end] - sums[self.start]

        counts = {k: share(k) for k in (UPPER, LETTER, DIGIT, SYMBOL, SHOUT, STOP, OTHER)}
        self.symbols = counts[SYMBOL]
        ink = np.maximum(sum(counts.values()), 1)
        w0, w1 = np.searchsorted(block.start, self.start), np.searchsorted(block.start, self.end)
        self.words = w1 - w0
        n = np.maximum(self.words, 1)
        sizes = block.end - block.start
        hashes = block.words
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        inside = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(same, out=inside[1:])
        short = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(sizes <= 3, out=short[1:])
        same_word = inside[w1] - inside[np.minimum(w0 + 1, w1)]
        full = np.flatnonzero(self.words > 0)
        self.earlier = np.zeros(len(self.start), bool)
        self.earlier[full] = repeated(self.doc[full], block.chars.hash(self.start[full], self.end[full]))[1]
        letters = counts[UPPER] + counts[LETTER]
        self.features = np.column_stack([
            np.log1p(self.chars) / 5, np.log1p(self.words) / 4, counts[UPPER] / np.maximum(letters, 1), counts[DIGIT] / ink, counts[SYMBOL] / ink,
            counts[SHOUT] / ink, counts[STOP] / ink, counts[OTHER] / ink, np.minimum(letters / n, 20) / 10, (short[w1] - short[w0]) / n,
            same_word / n, self.earlier, self.words == 0,
        ]).astype(np.float32)

    def with_neighbours(self) -> np.ndarray:
        """Own features, then those of the line before and after within the same text (zeros outside)."""
        f = self.features
        before, after = np.zeros_like(f), np.zeros_like(f)
        before[1:] = f[:-1]
        after[:-1] = f[1:]
        if len(f):
            before[self.first[self.count > 0]] = 0
            after[(self.first + self.count - 1)[self.count > 0]] = 0
        return np.hstack([f, before, after])
