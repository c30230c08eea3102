"""Token ids by a public tokenizer file, with a bounded cache of encoded words."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

CACHE_CHUNKS = 150_000
# White space that not every splitter treats alike; texts with it are encoded whole.
_UNUSUAL_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_BEYOND_LATIN1 = re.compile("[^\\x00-\\xff]")
_MARKS = "#$%&*|!.,?:;"
_PROBE = "One two, three### it's 4th déjà\nvu..."


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class _Words(dict):
    """Ids of the chunks between white space; unknown ones are encoded when first seen."""

    def __init__(self, owner: "Encoder"):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        if not word.isalpha() or _BEYOND_LATIN1.search(chunk) or not self.owner.by_words:
            ids = self.owner.whole(chunk)
        elif len(word) < len(chunk):
            ids = self[word] + self[chunk[len(word):]]
        else:
            letters = word.lower().encode().decode("latin-1").translate(self.owner.letters)
            ids = array("I", [t.id for t in self.owner.model.tokenize(letters)]).tobytes()
        self[chunk] = ids
        return ids


class Encoder:
    """Ids as little-endian 32-bit integers, without special tokens added.

    A tokenizer that drops white space never joins characters across it, so the ids of a
    text are those of its chunks; words recur, so most come from the cache. Texts with a
    special token's string or unusual white space go through the tokenizer whole. Within
    Latin-1 every library lowers case alike, so those texts are lowered before they are
    cut. A tokenizer for which a probe shows other habits encodes every text whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = self.whole(_PROBE) == self.whole(_PROBE.lower())
        self.by_words = True
        self.words = _Words(self)
        self.by_chunks = self.whole(_PROBE) == b"".join(map(self.whole, _PROBE.split()))
        self.by_words = self.by_chunks and self.lowers and self.whole(_PROBE) == b"".join(map(self.words.__getitem__, _PROBE.lower().split()))
        self.words.clear()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_CHUNKS:
            self.words.clear()
        get, out = self.words.__getitem__, []
        for text in texts:
            if not self.by_chunks or _UNUSUAL_SPACE.search(text) or any(s in text for s in self.special):
                out.append(self.whole(text))
                continue
            if self.lowers and not _BEYOND_LATIN1.search(text):
                text = text.lower()
            out.append(b"".join(map(get, text.split())))
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
