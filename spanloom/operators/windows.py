"""Sentences, candidate windows and their rule score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import clamp, div, round6
from . import scan as sc

KEY = ["source_id"]
# Speaking rates are kept as integers of one billionth of a letter per second:
# integer sums do not depend on the order in which partitions arrive.
RATE = 1_000_000_000_000


@dataclass(frozen=True)
class WindowOptions:
    min_ms: int = 15_000
    max_ms: int = 90_000
    max_gap_ms: int = 3_000

    def __post_init__(self):
        if not 15_000 <= self.min_ms <= self.max_ms <= 90_000:
            raise ValueError("windows need 15 s <= minimum <= maximum <= 90 s")
        if self.max_gap_ms < 0:
            raise ValueError("the largest gap must not be negative")


@dataclass(frozen=True)
class RuleConfig:
    """Fixed values of the rule score."""

    base: float = 20.0
    keyword_weight: float = 35.0
    pace_weight: float = 15.0
    volume_weight: float = 15.0
    qa_weight: float = 15.0
    duration_weight: float = 20.0
    density_target: float = 0.08
    pace_target: float = 0.5
    volume_db: float = 12.0
    target_ms: int = 30_000


def plain_sentences(words: DataFrame, *, gap_ms: int = 1_000, block_rows: int | None = sc.BLOCK_ROWS) -> DataFrame:
    """Sentences that end at a terminal mark or before a pause of ``gap_ms``."""
    return sentence_rows(sentence_words(words, gap_ms=gap_ms, block_rows=block_rows))


def sentence_words(words: DataFrame, *, gap_ms: int = 1_000, block_rows: int | None = sc.BLOCK_ROWS) -> DataFrame:
    """Words with the first word and the number of the sentence they are in."""
    block = sc.by_rows("pos", block_rows)
    seen = sc.scan(words, KEY, ["pos"], block,
                   _reach=sc.max_before(F.col("end_ms")),
                   _closed=sc.previous(tx.ends_terminal(F.col("text"))))
    opens = F.col("_reach").isNull() | F.col("_closed") | (F.col("start_ms") - F.col("_reach") >= gap_ms)
    return sc.scan(seen.withColumn("_open", F.when(opens, F.col("pos"))), KEY, ["pos"], block,
                   first_word=sc.latest(F.col("_open")),
                   sentence=sc.running_sum(F.col("_open").isNotNull().cast("bigint")))


def sentence_rows(marked: DataFrame, **more: Column) -> DataFrame:
    """One row per ``first_word`` group, words joined in order, with ``more`` aggregates behind."""
    word = F.struct("pos", "text")
    return marked.groupBy("source_id", "first_word").agg(
        F.max("pos").alias("last_word"), F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), " ").alias("text"), *[c.alias(n) for n, c in more.items()])


def numbered(df: DataFrame, key: list[str], order: list[str], block: Column, name: str = "pos") -> DataFrame:
    """Append 1, 2, 3 … along ``order`` in every key."""
    return sc.scan(df, key, order, block, **{name: sc.running_sum(F.lit(1).cast("bigint"))})


def sentence_features(sentences: DataFrame, lexicon: tx.Lexicon, options: WindowOptions = WindowOptions(), *,
                      block_rows: int | None = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prefix sums that let a window read its evidence from its two end rows.

    Needs ``pos`` 1, 2, 3 … per source. ``c_*`` columns are sums up to this row,
    ``qa_next`` is the earliest answered position of a question from here on and
    ``hard_block`` numbers the stretches between pauses above the gap limit. ``keep`` columns stay.
    """
    text = F.col("text")
    units = tx.text_units(text)
    hits = tx.keyword_hits(text, lexicon.keywords)
    local = sentences.select(
        "source_id", "pos", "start_ms", "end_ms", units.alias("units"),
        F.size(hits).cast("bigint").alias("hits"),
        tx.text_units(F.array_join(hits, "")).alias("covered"),
        div(units * RATE, F.col("end_ms") - F.col("start_ms")).alias("rate"),
        tx.is_answer(text, lexicon).alias("answers"),
        tx.is_question(text, lexicon).alias("asks"),
        (tx.is_question(text, lexicon) & tx.is_answer(tx.after_question(text, lexicon), lexicon)).alias("self_answer"), *keep)
    block = sc.by_rows("pos", block_rows)
    near = sc.scan(local, KEY, ["pos"], block,
                   _end=sc.max_before(F.col("end_ms")), _rate=sc.previous(F.col("rate")),
                   _a1=sc.following(F.struct(F.col("answers").alias("a"))),
                   _a2=_second(F.col("answers")))
    answered = (F.when(F.col("asks") & F.col("self_answer"), F.col("pos"))
                .when(F.col("asks") & F.col("_a1")["a"], F.col("pos") + 1)
                .when(F.col("asks") & F.col("_a2"), F.col("pos") + 2))
    flagged = (near.withColumn("_answered", answered)
               .withColumn("_break", (F.col("start_ms") - F.col("_end") > options.max_gap_ms).cast("bigint"))
               .withColumn("_step", F.abs(F.col("rate") - F.col("_rate"))))
    out = sc.scan(flagged, KEY, ["pos"], block,
                  hard_block=sc.running_sum(F.coalesce("_break", F.lit(0).cast("bigint"))),
                  c_units=sc.running_sum(F.col("units")), c_hits=sc.running_sum(F.col("hits")),
                  c_covered=sc.running_sum(F.col("covered")), c_rate=sc.running_sum(F.col("rate")),
                  c_step=sc.running_sum(F.col("_step")),
                  qa_next=sc.min_after(F.col("_answered"), inclusive=True))
    return out.drop("_end", "_rate", "_a1", "_a2", "_answered", "_break", "_step",
                    "answers", "asks", "self_answer")


def _second(value: Column) -> sc.Running:
    """The value two rows ahead."""
    box = F.struct(value.alias("v"))
    return sc.Running(
        lambda w, order: F.struct(F.lead(box, 1).over(w).alias("one"), F.lead(box, 2).over(w).alias("two")),
        lambda order: F.slice(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), box.alias("b")))),
                                          lambda r: r["b"]), 1, 2),
        lambda total, w: F.lead(total).over(w),
        lambda a, b: (a["two"] if b is None else F.coalesce(
            a["two"], F.when(a["one"].isNotNull(), F.get(b, F.lit(0))).otherwise(F.get(b, F.lit(1)))))["v"],
    )


def loudness(features: DataFrame, frames: DataFrame, baseline: DataFrame, *, frame_ms: int, options: WindowOptions = WindowOptions(),
             block_frames: int | None = sc.BLOCK_ROWS) -> DataFrame:
    """``features`` with what the loudest frame of any window can be read from at its two ends.

    ``frames`` has ``frame, rms_db``, ``baseline`` one ``baseline_db`` a source. A frame belongs to a window if its
    centre does. The maximum over a run of frames is that of two runs of a power of two, one from its first frame on
    (``loud_from_k``) and one up to its last (``loud_upto_k``): no row per window and frame, one look-up on each side.
    """
    half = frame_ms // 2
    first = F.ceil((F.col("start_ms") - half) / F.lit(frame_ms)).cast("bigint")
    last = F.ceil((F.col("end_ms") - half) / F.lit(frame_ms)).cast("bigint") - 1
    powers = range(max(options.min_ms // frame_ms, 1).bit_length() - 1, (options.max_ms // frame_ms + 1).bit_length())
    level = F.struct(F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("boolean").alias("opens"), F.col("rms_db").alias("db"))
    edge = lambda opens: F.struct(F.col("pos"), F.lit(opens).alias("opens"), F.lit(None).cast("double").alias("db"))
    asked = features.select("source_id", F.explode(F.array(F.struct(first.alias("at"), edge(True).alias("r")), F.struct(last.alias("at"), edge(False).alias("r")))).alias("e")).select("source_id", "e.*")
    heard = frames.select("source_id", F.col("frame").cast("bigint").alias("at"), level.alias("r"))
    key = ["source_id"]
    if block_frames is not None:
        # A block sees the frames of its neighbours that a run can reach.
        far, block = 1 << powers[-1], lambda at: F.floor(at / F.lit(block_frames))
        asked = asked.withColumn("_block", block(F.col("at")))
        heard = heard.withColumn("_block", F.explode(F.sequence(block(F.col("at") - far), block(F.col("at") + far))))
        key = ["source_id", "_block"]
    line, from_, upto = Window.partitionBy(*key).orderBy("at"), [], []
    for k in powers:
        from_.append(F.max("r.db").over(line.rangeBetween(0, (1 << k) - 1)).alias(f"loud_from_{k}"))
        upto.append(F.max("r.db").over(line.rangeBetween(1 - (1 << k), 0)).alias(f"loud_upto_{k}"))
    names = [f"loud_from_{k}" for k in powers], [f"loud_upto_{k}" for k in powers]
    runs = asked.unionByName(heard).select("source_id", "r.pos", "r.opens", *from_, *upto).where("pos IS NOT NULL")
    ends = runs.groupBy("source_id", "pos").agg(*[F.max(F.when(F.col("opens") == side, F.col(n))).alias(n) for side, ns in zip((True, False), names) for n in ns])
    return features.join(ends, ["source_id", "pos"]).join(baseline.select("source_id", "baseline_db"), "source_id", "left").withColumn("loud_frame_ms", F.lit(frame_ms))


def bounded_loudness(features: DataFrame, frames: DataFrame, *, frame_ms: int, options: WindowOptions = WindowOptions()) -> DataFrame:
    """``loudness`` with its own baseline for sources that are one input row each: nothing is dealt, and no join by row.

    The levels of a source are gathered once, a null for every silent frame, so its text bounds them. Runs of a power
    of two are doubled along that array, and the sentences read their runs and the median level from it.
    """
    from .evaluation import median_level
    half = frame_ms // 2
    powers = range(max(options.min_ms // frame_ms, 1).bit_length() - 1, (options.max_ms // frame_ms + 1).bit_length())
    pad = 1 << powers[-1]
    silent = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    tagged = features.select("source_id", F.struct(*[c for c in features.columns if c != "source_id"]).alias("_u")).unionByName(
        frames.select("source_id", F.struct(F.col("frame").cast("bigint").alias("at"), F.col("rms_db").alias("db")).alias("_l")), allowMissingColumns=True)
    held = tagged.groupBy("source_id").agg(F.collect_list("_u").alias("_us"), F.array_sort(F.collect_list("_l")).alias("_ls"))
    beside = lambda level, i: F.coalesce(F.get("_ls", i + 1)["at"], level["at"] + 1) - level["at"] - 1
    line = F.flatten(F.transform("_ls", lambda level, i: F.concat(F.array(level["db"]), silent(beside(level, i)))))
    runs = held.select("source_id", "_us", (F.get("_ls", F.lit(0))["at"] - pad).alias("_low"), median_level(F.transform("_ls", lambda level: level["db"])).alias("_base"),
                       F.concat(silent(F.lit(pad)), line).alias("_run_0"))
    for k in range(powers[-1]):
        runs = runs.withColumn(f"_run_{k + 1}", F.transform(f"_run_{k}", lambda v, i: F.greatest(v, F.get(f"_run_{k}", i + (1 << k)))))
    first = lambda u: F.ceil((u["start_ms"] - half) / F.lit(frame_ms)).cast("bigint")
    last = lambda u: F.ceil((u["end_ms"] - half) / F.lit(frame_ms)).cast("bigint") - 1
    level_at = lambda k, at: F.get(f"_run_{k}", (at - F.col("_low")).cast("int"))
    full = lambda u: F.struct(*[u[c].alias(c) for c in features.columns if c != "source_id"],
                              *[level_at(k, first(u)).alias(f"loud_from_{k}") for k in powers], *[level_at(k, last(u) - (1 << k) + 1).alias(f"loud_upto_{k}") for k in powers])
    each = runs.select("source_id", "_base", F.explode(F.transform("_us", full)).alias("_u"))
    return each.select("source_id", "_u.*", F.col("_base").alias("baseline_db"), F.lit(frame_ms).alias("loud_frame_ms"))


def prominence(peak_db: Column, baseline_db: Column, *, floor_db: float = -60.0) -> Column:
    """How far a peak stands out above the baseline, in dB; 0 where one of them is below the floor."""
    heard = (peak_db > floor_db) & (baseline_db > floor_db)
    return F.when(heard, F.greatest(F.lit(0.0), peak_db - baseline_db)).otherwise(F.lit(0.0))


def sentence_windows(units: DataFrame, options: WindowOptions = WindowOptions(), *,
                     carry: tuple[str, ...] = (), bounded: bool = False, first_only: tuple[str, ...] = (), last_only: tuple[str, ...] = (),
                     texts: bool = False) -> DataFrame:
    """Every run of consecutive units whose duration lies in the limits.

    ``units`` carries ``pos`` and ``hard_block``. A unit starts a run and looks up
    the units ending 15 to 90 s later, by bins of the largest duration, so one
    long source is spread over its bins. ``carry`` columns of both end rows come
    along as ``a_*`` and ``b_*``, those of ``first_only`` and ``last_only`` from one. With ``bounded`` sources (one input row each)
    a sliding frame of 90 s reads the same units without any shuffle; with ``texts`` it also joins their ``text``, unit by unit.
    """
    if texts and not bounded:
        raise ValueError("texts are read from the frame of bounded sources; see window_text")
    width, left, right = options.max_ms, (*carry, *first_only), (*carry, *last_only)
    if bounded:
        ahead = Window.partitionBy("source_id", "hard_block").orderBy("start_ms").rangeBetween(0, options.max_ms)
        last = F.struct(F.col("pos").alias("last_pos"), "end_ms", *[F.col(c).alias(f"b_{c}") for c in right], *["text"] * texts)
        seen = units.select("source_id", F.col("pos").alias("first_pos"), "start_ms",
                            *[F.col(c).alias(f"a_{c}") for c in left],
                            F.collect_list(last).over(ahead).alias("_ahead"))
        span = lambda r: r["end_ms"] - F.col("start_ms")
        fits = F.filter("_ahead", lambda r: (r["last_pos"] >= F.col("first_pos"))
                        & span(r).between(options.min_ms, options.max_ms))
        if texts:
            inside = lambda r: F.filter("_ahead", lambda u: u["last_pos"].between(F.col("first_pos"), r["last_pos"]))
            lines = lambda r: F.transform(F.array_sort(F.transform(inside(r), lambda u: F.struct(u["last_pos"], u["text"]))), lambda u: u["text"])
            fits = F.transform(fits, lambda r: r.withField("text", F.array_join(lines(r), "\n")))
        return (seen.withColumn("_r", F.explode(fits)).drop("_ahead")
                .select("*", "_r.*").drop("_r")
                .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")))
    first = units.select(
        "source_id", "hard_block", F.col("pos").alias("first_pos"), "start_ms",
        *[F.col(c).alias(f"a_{c}") for c in left],
        F.explode(F.sequence(div(F.col("start_ms") + options.min_ms, width),
                             div(F.col("start_ms") + options.max_ms, width))).alias("_bin"))
    last = units.select(
        "source_id", "hard_block", F.col("pos").alias("last_pos"), "end_ms",
        *[F.col(c).alias(f"b_{c}") for c in right], div(F.col("end_ms"), width).alias("_bin"))
    duration = F.col("end_ms") - F.col("start_ms")
    return (first.join(last, ["source_id", "hard_block", "_bin"])
            .where((F.col("last_pos") >= F.col("first_pos"))
                   & duration.between(options.min_ms, options.max_ms))
            .withColumn("duration_ms", duration)
            .drop("_bin", "hard_block"))


CARRY = ("units", "hits", "covered", "rate", "c_units", "c_hits", "c_covered", "c_rate", "c_step", "qa_next")


def _peak(from_: tuple[str, ...], upto: tuple[str, ...]) -> Column:
    """Level of the loudest frame of a window, from the two runs that cover its frames."""
    size, half = F.col("a_loud_frame_ms"), F.floor(F.col("a_loud_frame_ms") / 2)
    n = F.ceil((F.col("end_ms") - half) / size) - F.ceil((F.col("start_ms") - half) / size)
    power = F.floor(F.log2(n.cast("double")) + 1e-12)
    pick = lambda names, side: F.coalesce(*[F.when(power == int(c.rsplit("_", 1)[1]), F.col(f"{side}_{c}")) for c in names])
    # The greater of two levels; a run without any frame has none.
    return F.coalesce(F.greatest(pick(from_, "a"), pick(upto, "b")), F.lit(-120.0))


def score_rule(features: DataFrame, options: WindowOptions = WindowOptions(),
               config: RuleConfig = RuleConfig(), *, volume: Column | None = None,
               bounded: bool = False) -> DataFrame:
    """Candidate windows with the rule score and its contributions.

    The volume part is read from the columns of ``loudness``, where they are there, or is ``volume`` (0 to 1).
    """
    from_ = tuple(c for c in features.columns if c.startswith("loud_from_"))
    upto = tuple(c for c in features.columns if c.startswith("loud_upto_"))
    alone = ("baseline_db", "loud_frame_ms") if from_ else ()
    w = sentence_windows(features, options, carry=CARRY, bounded=bounded, first_only=(*from_, *alone), last_only=upto)
    if from_ and volume is None:
        volume = F.least(F.lit(1.0), prominence(_peak(from_, upto), F.col("a_baseline_db")) / config.volume_db)

    def total(name: str) -> Column:
        return F.col(f"b_c_{name}") - F.col(f"a_c_{name}") + F.col(f"a_{name}")

    n = F.col("last_pos") - F.col("first_pos") + 1
    w = w.select("source_id", "first_pos", "last_pos", "start_ms", "end_ms", "duration_ms",
                 n.alias("n_sentences"), total("hits").alias("keyword_hits"),
                 total("covered").alias("_cov"), total("units").alias("text_units"),
                 total("rate").alias("_rate"),
                 (F.col("b_c_step") - F.col("a_c_step")).alias("_step"), (F.lit(0.0) if volume is None else F.coalesce(volume, F.lit(0.0))).alias("_loud"),
                 F.coalesce(F.col("a_qa_next") <= F.col("last_pos"), F.lit(False)).alias("has_answer"))
    density = F.when(F.col("text_units") > 0, F.col("_cov") / F.col("text_units")).otherwise(F.lit(0.0))
    keyword = F.least(F.lit(1.0), density / config.density_target)
    mean = F.col("_rate") / F.col("n_sentences")
    change = F.when(F.col("n_sentences") > 1, F.col("_step") / (F.col("n_sentences") - 1)).otherwise(F.lit(0.0))
    pace = F.least(F.lit(1.0), F.when(mean > 0, change / mean).otherwise(F.lit(0.0)) / config.pace_target)
    penalty = F.least(F.lit(1.0), F.abs(F.col("duration_ms") - config.target_ms) / F.lit(float(config.target_ms)))
    parts = w.select(
        "*", round6(keyword * config.keyword_weight).alias("keyword_score"),
        round6(pace * config.pace_weight).alias("pace_score"),
        round6(F.col("_loud") * config.volume_weight).alias("volume_score"),
        F.when(F.col("has_answer"), F.lit(config.qa_weight)).otherwise(F.lit(0.0)).alias("qa_score"),
        round6(penalty * -config.duration_weight).alias("duration_score")).drop("_cov", "_rate", "_step", "_loud")
    score = (F.lit(config.base) + F.col("keyword_score") + F.col("pace_score") + F.col("volume_score")
             + F.col("qa_score") + F.col("duration_score"))
    return parts.withColumn("score", round6(clamp(score, 0.0, 100.0)))


def ranked(scored: DataFrame) -> DataFrame:
    """All windows with their rank within the source."""
    order = Window.partitionBy("source_id").orderBy(
        F.desc("score"), "start_ms", "end_ms", "first_pos")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint"))


def best_per_source(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best windows of each source; Spark limits groups before the shuffle."""
    order = Window.partitionBy("source_id").orderBy(
        F.desc("score"), "start_ms", "end_ms", "first_pos")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def window_text(windows: DataFrame, sentences: DataFrame) -> DataFrame:
    """Attach the text of few, already chosen windows, sentence by sentence."""
    ids = ["source_id", "first_pos", "last_pos"]
    asked = windows.select(*ids).distinct().select(
        "*", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    found = asked.join(sentences.select("source_id", "pos", "text"), ["source_id", "pos"])
    texts = found.groupBy(*ids).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return windows.join(texts, ids)
