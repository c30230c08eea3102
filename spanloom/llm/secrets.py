"""Secrets: base patterns, and random strings by their poor token efficiency.

A tokenizer's vocabulary is made of what people write: ordinary words take few tokens,
random strings many. Runs of 20 or more key characters, of letters only too, are
encoded with a byte-level vocabulary; those with fewer than ``MAX_RATIO`` characters per
token are secrets, unless they are known digests, UUIDs, times or plain numbers. Of a run
that base spans touch, the stretches outside them are tested.

Null texts count as empty and have no spans. Repeated rows are scanned each.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import map_texts

KINDS = ("assign", "access", "hex")
RANDOM = "random"
MIN_CHARS = 20
MAX_RATIO = 2.2
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(?:%s)" % "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
                     + r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
_MARKS = "+/_=-"
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_KNOWN = re.compile(r"[0-9a-fA-F]+|[0-9+/_=-]+|\d{4}-\d\d-\d\dT?[0-9:Z+-]*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind as listed. The ``assign`` span is the whole match."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@lru_cache(2)
def encoding(path: str):
    """Byte-level encoding of a rank file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and times are no secrets."""
    if _UUID.fullmatch(run) or not _KNOWN.fullmatch(run):
        return _UUID.fullmatch(run) is not None
    return not re.fullmatch(r"[0-9a-fA-F]+", run) or len(run) in DIGEST_LENGTHS or run.isdigit() or not re.search("[0-9]", run)


def random_spans(text: str, path: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs, or stretches of them outside ``taken``, whose characters per token are below ``MAX_RATIO``."""
    out, taken, k = [], sorted(taken, key=lambda s: s[1:]), 0
    for m in _RUN.finditer(text):
        at, end = m.span()
        pieces = []
        while k < len(taken) and taken[k][2] <= at:
            k += 1
        for _, x, y in taken[k:]:
            if x >= end:
                break
            if y > at:
                pieces.append((at, x))
                at = y
        for a, b in [*pieces, (at, end)]:
            # Marks beside a base span divide it from the rest.
            while a < b and a > m.start() and text[a] in _MARKS:
                a += 1
            while a < b and b < end and text[b - 1] in _MARKS:
                b -= 1
            if b - a >= MIN_CHARS and not known(text[a:b]) and (b - a) / len(encoding(path).encode_ordinary(text[a:b])) < MAX_RATIO:
                out.append((RANDOM, a, b))
    return out


def find(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, base, spans)`` of every row: base spans, and these with the random ones, by start then kind."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(columns, texts):
        base, every = [], []
        for text in texts:
            own = base_spans(text)
            both = sorted(own + random_spans(text, path, own), key=lambda s: s[1]) if len(text) >= MIN_CHARS else own
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            every.append([{"kind": k, "start": a, "end": b} for k, a, b in both])
        return columns["doc_id"], pa.array(base, span), pa.array(every, span)

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id long, base {kind}, spans {kind}")
