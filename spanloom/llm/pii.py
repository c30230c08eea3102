"""Personal data: base patterns, and more identifiers by bootstrapped contexts.

Four patterns give base spans in every whole text. Base entities are the seeds of a graph:
an identifier-like word or run of digit groups with single spaces (a candidate, of at least ``MIN_CHARS``
characters with ``MIN_DIGITS`` digits or an @) is an instance, the two words before it, and the word
before with the word after, are its patterns, however long those words are. In rounds of joins, a pattern's confidence in
a kind is the confidence-weighted share of its distinct instances, and an instance's is that
at least one of its patterns is right. Candidates that reach ``CONFIDENT`` through patterns
with ``MIN_SEEDS`` distinct seeds, or instances accepted in an earlier round, become spans of
that kind; base spans are never changed.

Null texts count as empty and have no spans. Rows that repeat get the same spans each. Very
long runs of one character class cost linear time: patterns start only where a run starts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

from .chars import map_texts, text_portions

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5
CONFIDENT = 0.8
SMOOTHING = 1.0
ROUNDS = 3
# An identifier-like word is no candidate if it is shorter, or has fewer digits and no @.
MIN_CHARS, MIN_DIGITS = 5, 3
LONG_WORD = 40
SPAN = "struct<kind:string,start:bigint,end:bigint>"

_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_EMAIL_HERE, _EMAIL_NEXT = re.compile(_EMAIL), re.compile(rf"(?<![{_LOCAL}]){_EMAIL}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# A space joins two groups of digits; the first may follow a mark in its word, the last may be followed by marks.
_GROUP = r"[(\[]?\+?[0-9][0-9().\[\]-]*+"
_OPENS = re.compile(rf"(?:[^\x20\t\n\r\x0b\x0c]*[^0-9A-Za-z@.+-])?{_GROUP}(?<![.-])")
_GOES_ON, _LAST = re.compile(rf"{_GROUP}(?<![.-])"), re.compile(rf"{_GROUP}[^0-9A-Za-z@]*")
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[^0-9A-Za-z@+]+|[^0-9A-Za-z]+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    at = 0
    while m := _EMAIL_HERE.match(text, at) or _EMAIL_NEXT.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _plain(word: str) -> str:
    """A context word: lower case, without marks at its edges; digits count as one sign. Of a long word, its digest."""
    word = re.sub(r"[0-9]+", "0", word.lower().strip(".,;:!?()[]{}\"'<>#*$%&|"))
    return word if len(word) <= LONG_WORD else hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _words_before(text: str, at: int) -> list[str]:
    """The last two words of ``text[:at]``."""
    out = []
    while at and len(out) < 2:
        while at and text[at - 1].isspace():
            at -= 1
        end = at
        while at and not text[at - 1].isspace():
            at -= 1
        if at < end:
            out.append(text[at:end])
    return out[::-1]


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int, list[str]]]:
    """``(kind or "", value, start, end, patterns)`` of base entities and of identifier-like words."""
    taken, spots = [], []
    for kind, a, b in base:
        taken.append((a, b))
        spots.append((kind, a, b))
    if re.search(r"[0-9]|@", text):
        taken.sort()
        k = 0
        for m in re.finditer(r"[0-9@]", text):
            at = m.start()
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            if (k < len(taken) and taken[k][0] <= at) or (spots and spots[-1][0] == "" and spots[-1][2] > at):
                continue
            a, b = at, at + 1
            while a and text[a - 1] not in " \t\n\r\x0b\x0c":
                a -= 1
            while b < len(text) and text[b] not in " \t\n\r\x0b\x0c":
                b += 1
            limit = taken[k][0] if k < len(taken) else len(text)
            joins = b < len(text) and text[b] == " " and _OPENS.fullmatch(text, a, b)
            while joins:
                end = b + 1
                while end < len(text) and text[end] not in " \t\n\r\x0b\x0c":
                    end += 1
                if end > limit or not _LAST.fullmatch(text, b + 1, end):
                    break
                joins = end < len(text) and text[end] == " " and _GOES_ON.fullmatch(text, b + 1, end)
                b = end
            word = text[a:b]
            core = _EDGE.sub("", word)
            if not core:
                spots.append(("", a, b))
                continue
            a += word.index(core)
            b = a + len(core)
            # A bracket that opens before the first digits belongs to the identifier.
            if a and text[a - 1] + core.lstrip("0123456789")[:1] in ("()", "[]"):
                a -= 1
            spots.append(("", a, b))
    # The furthest end of the base spans that start before a place tells whether one reaches past it.
    starts, ends = [x for x, _ in taken], list(accumulate((y for _, y in taken), max))
    out = []
    for kind, a, b in spots:
        if not kind:
            before = bisect_left(starts, b)
            if b - a < MIN_CHARS or sum(c.isdigit() for c in text[a:b]) < MIN_DIGITS and "@" not in text[a:b] or before and ends[before - 1] > a:
                continue
        left = [_plain(w) for w in _words_before(text, a)]
        follows = _WORD.search(text, b)
        right = _plain(follows[0]) if follows else ""
        patterns = [f"{left[-2]} {left[-1]} _"] if len(left) == 2 and left[-1] else []
        if left and left[-1] and right:
            patterns.append(f"{left[-1]} _ {right}")
        out.append((kind, text[a:b].lower(), a, b, patterns))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and graph instances of every row: ``(doc_id, _text, base, found)``.

    ``_text`` is a hash of the text, so repeated ids with other texts stay apart.
    """
    def run(columns, texts):
        base, found = [], []
        for text in texts:
            spans = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            found.append([{"kind": k, "value": v, "start": a, "end": b, "patterns": p} for k, v, a, b, p in instances(text, spans)])
        span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
        return (columns["doc_id"], columns["_text"], pa.array(base, pa.list_(pa.struct(span))),
                pa.array(found, pa.list_(pa.struct([span[0], ("value", pa.string()), *span[1:], ("patterns", pa.list_(pa.string()))]))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("_text"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, f"doc_id long, _text long, base array<{SPAN}>, "
                     "found array<struct<kind:string,value:string,start:bigint,end:bigint,patterns:array<string>>>")


def confident(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, threshold: float = CONFIDENT) -> DataFrame:
    """``(value, kind, confidence)`` of non-seed instances from ``(pattern, value, kind)`` edges.

    ``kind`` is empty for non-seeds. Each round looks at the patterns with ``min_seeds`` distinct
    seeds or instances accepted in the round before, so an accepted one can support new patterns.
    Sums are grouped over distinct edges, with partial sums before the shuffle, so a pattern with
    very many instances is no hot group.
    """
    edges = cut(edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    seeds = cut(edges.filter("seed <> ''").select("value", F.col("seed").alias("kind")).distinct())
    out = None
    for _ in range(rounds):
        held = seeds if out is None else seeds.unionByName(out.filter(F.col("confidence") >= threshold).select("value", "kind")).distinct()
        support = cut(edges.select("pattern", "value").join(held, "value").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
                      .filter(F.col("seeds") >= min_seeds))
        graph = cut(edges.join(support.select("pattern").distinct(), "pattern"))
        sizes = graph.groupBy("pattern").agg(F.count("*").alias("_all"))
        trusted = graph.filter("seed <> ''").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence"))
        known = trusted if out is None else trusted.unionByName(out)
        scores = (graph.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("_sum"))
                  .join(sizes, "pattern").join(support, ["pattern", "kind"])
                  .select("pattern", "kind", (F.col("_sum") / (F.col("_all") + SMOOTHING)).alias("score")).filter("score >= 0.5"))
        wrong = F.sum(F.log1p(-F.least("score", F.lit(0.999))))
        fresh = graph.filter("seed = ''").select("pattern", "value")
        out = cut(fresh.join(scores, "pattern").groupBy("value", "kind").agg((1 - F.exp(wrong)).alias("confidence"))
                  .groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence")))
    return out.filter(F.col("confidence") >= threshold)


def find(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, _text, base, spans)`` of every row; ``spans`` are base and found ones by kind as listed, then start."""
    seen = cut(scan(docs))
    each = seen.select("doc_id", "_text", F.explode("found").alias("f")).select("doc_id", "_text", "f.*")
    values = confident(each.select(F.explode("patterns").alias("pattern"), "value", "kind"), **options)
    more = (each.filter("kind = ''").drop("kind").join(values, "value").groupBy("doc_id", "_text")
            .agg(F.collect_set(F.struct("kind", "start", "end")).alias("more")))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.concat(F.col("s.base"), F.coalesce(F.col("m.more"), F.array().cast(f"array<{SPAN}>")))
    by_kind = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(order[x["kind"]].alias("i"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))),
                          lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return (seen.alias("s").join(more.alias("m"), F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s._text") == F.col("m._text")), "left")
            .select("s.doc_id", "s._text", "s.base", by_kind.alias("spans")))


def joined(spans) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; other columns stay.

    Spans that overlap are replaced by the first one's kind. Null texts stay null.
    """
    spans = (find(docs, **options).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"), F.col("spans").alias("_spans"))
             .dropDuplicates(["_id", "_key"]))
    # The other columns travel in one struct, so their names cannot clash with those of the join.
    fields = docs.schema.fieldNames()
    others = [n for n in fields if n != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in others]).alias("_row"), "text", F.col("doc_id").cast("long").alias("_for"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("_hash"))
    found = rows.join(spans, F.col("_for").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left").select("_row", "text", "_spans")

    def run(batches):
        for batch in batches:
            for part, texts in text_portions(batch):
                old = part.column("text")
                new = [cover(t, [(x["kind"], x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, part.column("_spans").to_pylist())]
                columns = dict(zip(others, part.column("_row").flatten()), text=pa.array(new, old.type, mask=old.is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([columns[n] for n in fields], names=fields)

    return found.mapInArrow(run, docs.schema)


def cover(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace spans by their kinds."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
