"""The closed set of versioned candidate strategies.

A strategy is a name with all its options. Its digest is that of its canonical JSON form, and candidate ids are
content hashes over that digest, the digest of the source's units and the units of the candidate: other options,
another strategy or an edited source give other ids.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import div, frame_ceil, frame_floor
from ..session import cut
from . import continuity as ct, digests, discourse as dc, scan as sc, topics as tp, windows as wn

WINDOWS = "sentence-window-v1"
TOPICS = {"topic-valley-v1": 1, "topic-valley-v2": 2, "topic-valley-v3": 3, "topic-valley-v4": 4}
OPTIONS = {WINDOWS: wn.WindowOptions, **dict.fromkeys(TOPICS, tp.TopicOptions)}


@dataclass(frozen=True)
class Strategy:
    """A validated strategy; ``options`` is an object of the class that its name asks for."""

    version: str
    options: object

    def digest(self) -> str:
        text = json.dumps({"version": self.version, "options": asdict(self.options)}, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        return hashlib.sha256(text.encode()).hexdigest()


def strategy(settings: dict) -> Strategy:
    """The strategy that ``settings`` (``version`` and all ``options``) name; anything unknown or missing is refused."""
    if not isinstance(settings, dict) or set(settings) != {"version", "options"}:
        raise ValueError("settings need a version and options")
    kind = OPTIONS.get(settings["version"]) if isinstance(settings["version"], str) else None
    if kind is None:
        raise ValueError(f"unknown strategy: {settings['version']}")
    if not isinstance(settings["options"], dict) or set(settings["options"]) != set(asdict(kind())):
        raise ValueError("all options must be named, and no others")
    return Strategy(settings["version"], kind(**settings["options"]))


def default(version: str = WINDOWS) -> Strategy:
    if version not in OPTIONS:
        raise ValueError(f"unknown strategy: {version}")
    return Strategy(version, OPTIONS[version]())


def source_digests(units: DataFrame) -> DataFrame:
    """One ``digest`` of the units of each source."""
    content = F.concat_ws("|", F.col("pos").cast("string"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), "text")
    return digests.tree_digest(units, ["source_id"], [F.col("pos")], content, digests.by_position("pos"))


def with_ids(candidates: DataFrame, units: DataFrame, chosen: Strategy, first: str = "first_pos", last: str = "last_pos") -> DataFrame:
    """``candidates`` with a ``candidate_id``."""
    name = F.concat(F.lit(chosen.digest() + "/"), F.col("digest"), F.lit("/"), F.col(first).cast("string"), F.lit("-"), F.col(last).cast("string"))
    ident = F.concat(F.lit("c_" if chosen.version == WINDOWS else "t_"), F.sha2(name, 256))
    return candidates.join(source_digests(units), "source_id").withColumn("candidate_id", ident).drop("digest")


def event_evidence(units: DataFrame, *, continuous: bool, block: Column | str | None = sc.AUTO) -> tuple[DataFrame, DataFrame]:
    """Links that have to stay in one segment, and open edges, of all surface rules: ``source_id, first_unit, last_unit[, kind]``."""
    plain = dc.dependencies(units, block=block).select("source_id", "first_unit", "last_unit", "kind")
    every = plain.unionByName(dc.quotations(units))
    if continuous:
        more = ct.continuity(units, block=block).where(F.col("status") != ct.AMBIGUOUS)
        every = every.unionByName(more.select("source_id", "first_unit", "last_unit", "kind"))
    every = cut(every)
    whole = F.col("first_unit").isNotNull() & F.col("last_unit").isNotNull()
    return every.where(whole).select("source_id", "first_unit", "last_unit"), every.where(~whole)


def generate(chosen: Strategy, units: DataFrame, lexicon: tx.Lexicon, *, bounded: bool = False, blocking: DataFrame | None = None) -> DataFrame:
    """Candidates of a strategy: ``source_id, first_pos, last_pos, start_ms, end_ms, candidate_id``.

    ``units`` are sentences or turns with ``pos, start_ms, end_ms, text``; ``bounded`` sources are one input row each.
    """
    block = None if bounded else sc.AUTO
    if chosen.version == WINDOWS:
        features = wn.sentence_features(units, lexicon, chosen.options, block_rows=None if bounded else 1024)
        found = wn.sentence_windows(features, chosen.options, bounded=bounded)
    else:
        level = TOPICS[chosen.version]
        b = tp.boundary_similarity(units, lexicon, chosen.options, block=block)
        cuts, unresolved = tp.topic_cuts(b, chosen.options, guarded=level > 1, block=block), None
        if level > 2:
            links, edges = event_evidence(units, continuous=level > 3, block=block)
            cuts, unresolved = tp.drop_crossed(cuts, links), tp.unresolved_spans(links, edges, b, units, block=block)
        segments = tp.topic_segments(cuts, b, units, chosen.options, blocking=blocking, unresolved=unresolved, block=block)
        found = segments.where("eligible").withColumnsRenamed({"first_unit": "first_pos", "last_unit": "last_pos"})
    return with_ids(found.select("source_id", "first_pos", "last_pos", "start_ms", "end_ms"), units, chosen)


def window_warnings(sources: DataFrame, units: DataFrame, windows: DataFrame, options: wn.WindowOptions = wn.WindowOptions()) -> DataFrame:
    """``source_id, warning`` for sources without units, with a unit that no window can hold, or without windows."""
    held = units.groupBy("source_id").agg(F.max(F.col("end_ms") - F.col("start_ms") > options.max_ms).alias("_long"), F.lit(True).alias("_units"))
    some = windows.groupBy("source_id").agg(F.lit(True).alias("_windows"))
    rows = sources.select("source_id").distinct().join(held, "source_id", "left").join(some, "source_id", "left")
    codes = F.filter(F.array(F.when(F.col("_units").isNull(), "no_sentences"), F.when(F.col("_long"), "overlong_sentence_unit_skipped"),
                             F.when(F.col("_windows").isNull(), "no_eligible_window")), lambda c: c.isNotNull())
    return rows.select("source_id", F.explode(codes).alias("warning"))


def freeze(retained: DataFrame, chosen: Strategy, *, pass_share: int = 85) -> DataFrame:
    """The samples of an evaluation batch per source, in the order of their ids, with what has to pass and the batch id.

    ``retained`` has ``candidate_id, score, start_ms, end_ms``. The batch id is a digest tree over ranges of ids, so it
    names the whole batch without a task that holds it.
    """
    rows = cut(retained.select("source_id", "candidate_id", "score", frame_floor(F.col("start_ms")).alias("start_frame"), frame_ceil(F.col("end_ms")).alias("end_frame")))
    content = F.concat_ws("|", "candidate_id", F.col("start_frame").cast("string"), F.col("end_frame").cast("string"), F.rint(F.col("score") * 1e6).cast("bigint").cast("string"))
    tree = digests.tree_digest(rows, ["source_id"], [F.col("candidate_id")], content, digests.by_prefix("candidate_id", 3))
    size = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")).join(tree, "source_id")
    placed = sc.scan(rows, ["source_id"], ["candidate_id"], F.substring("candidate_id", 3, 2), sample=sc.running_sum(F.lit(1).cast("bigint")))
    return placed.join(size, "source_id").select(
        "source_id", "sample", "candidate_id", "score", "start_frame", "end_frame", div(F.col("_n") * pass_share + 99, 100).alias("required_passes"),
        F.sha2(F.concat(F.lit(chosen.digest() + "/"), "digest"), 256).alias("batch_id"))
