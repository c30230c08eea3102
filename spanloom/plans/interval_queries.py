"""Queries of the interval, gap and span operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gaps as gp, islands as il, scan as sc, spans as sp, windows as wn
from ..operators import range_join as rj
from ..session import table
from . import tables as tb
from .catalog import query
from .oracle import cte, with_

U = ["source_id"]

cte("iv_reach", """SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ivals WHERE start_ms < end_ms""", "ivals")
cte("iv_touch", """SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, event_id) AS g FROM iv_reach""", "iv_reach")
cte("iv_union", """SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n
  FROM iv_touch GROUP BY source_id, g""", "iv_touch")


@query("interval_union", with_("iv_union", "SELECT * FROM iv_union"))
def interval_union(spark, sf):
    return il.interval_union(tb.intervals(spark, sf))


@query("overlap_units", with_("iv_reach", """SELECT source_id, min(event_id) AS first_pos, max(event_id) AS last_pos,
  min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, string_agg(event_type, chr(10) ORDER BY event_id) AS text
  FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms >= reach THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id ORDER BY start_ms, event_id) AS g FROM (SELECT *, max(end_ms) OVER (PARTITION BY source_id
  ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ivals)) GROUP BY source_id, g"""))
def overlap_units(spark, sf):
    i = tb.intervals(spark, sf)
    return il.overlap_units(i.select("source_id", F.col("event_id").alias("pos"), "start_ms", "end_ms",
                                     F.col("event_type").alias("text")))


@query("label_runs", with_("ev", """SELECT source_id, event_type, min(at_ms) AS start_ms, max(coalesce(nxt, at_ms)) AS end_ms,
  count(*) AS n FROM (SELECT *, sum(CASE WHEN lab IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER
  (PARTITION BY source_id ORDER BY at_ms, event_id) AS g FROM (SELECT *, lag(event_type) OVER w AS lab, lead(at_ms) OVER w AS nxt
  FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY at_ms, event_id))) GROUP BY source_id, event_type, g"""))
def label_runs(spark, sf):
    return il.label_runs(tb.events(spark, sf), U, ["at_ms", "event_id"], "event_type", "at_ms", sc.by_time("at_ms", 86_400_000))


def gap_words(spark, sf):
    shift = (F.col("source_id") % 2) * 4000
    return tb.words(spark, sf).select("source_id", "pos", "text", (F.col("start_ms") + shift).alias("start_ms"),
                                      (F.col("end_ms") + shift).alias("end_ms"))


def gap_media(spark, sf):
    ends = gap_words(spark, sf).groupBy("source_id").agg(F.max("end_ms").alias("e"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"))
    return docs.join(ends, "source_id", "left").select(
        "source_id", F.coalesce(F.col("e") + (F.col("source_id") % 3) * 2000, F.lit(10000)).cast("bigint").alias("duration_ms"))


cte("gap_words", """SELECT source_id, pos, text, (start_ms + (source_id % 2) * 4000)::BIGINT AS start_ms,
  (end_ms + (source_id % 2) * 4000)::BIGINT AS end_ms FROM words""", "words")
cte("gap_media", """SELECT doc_id AS source_id, coalesce(e + (doc_id % 3) * 2000, 10000)::BIGINT AS duration_ms FROM documents
  LEFT JOIN (SELECT source_id, max(end_ms) AS e FROM gap_words GROUP BY 1) ON source_id = doc_id""", "gap_words")
cte("gaps", """SELECT source_id, coalesce(prev_end, 0)::BIGINT AS gap_start, start_ms AS gap_end, prev_pos AS left_pos, pos AS right_pos,
  CASE WHEN prev_end IS NULL THEN 'prefix' ELSE 'internal' END AS position FROM (SELECT *, lag(end_ms) OVER w AS prev_end,
  lag(pos) OVER w AS prev_pos FROM gap_words WINDOW w AS (PARTITION BY source_id ORDER BY pos)) WHERE start_ms - coalesce(prev_end, 0) > 3000
  UNION ALL SELECT m.source_id, coalesce(e, 0)::BIGINT, duration_ms, p, NULL, CASE WHEN e IS NULL THEN 'whole_media' ELSE 'suffix' END
  FROM gap_media m LEFT JOIN (SELECT source_id, max(end_ms) AS e, max(pos) AS p FROM gap_words GROUP BY 1) x ON x.source_id = m.source_id
  WHERE duration_ms - coalesce(e, 0) > 3000""", "gap_words", "gap_media")
cte("dets", """SELECT source_id, 'vad' AS detector, end_ms - 300 AS start_ms, end_ms + (pos % 5) * 1000 AS end_ms FROM gap_words
  WHERE right(text, 1) IN ('.', '!', '?') OR pos % 241 = 0
  UNION ALL SELECT source_id, 'gate', end_ms, end_ms + (pos % 7) * 600 FROM gap_words
  WHERE (right(text, 1) IN ('.', '!', '?') OR pos % 241 = 0) AND source_id % 4 > 0""", "gap_words")
cte("det_union", """SELECT source_id, detector, min(start_ms) AS s, max(end_ms) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR start_ms > r THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id, detector ORDER BY start_ms, end_ms) AS g FROM (SELECT *, max(end_ms) OVER (PARTITION BY source_id, detector
  ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM dets WHERE start_ms < end_ms)) GROUP BY source_id, detector, g""", "dets")
cte("audit", """SELECT g.*, coalesce(v, 0)::BIGINT AS vad_ms, coalesce(t, 0)::BIGINT AS gate_ms, greatest(coalesce(v, 0), coalesce(t, 0))::BIGINT AS speech_ms,
  greatest(coalesce(v, 0), coalesce(t, 0)) >= 3000 AS suspect FROM gaps g LEFT JOIN (SELECT g.source_id, g.gap_start,
  sum(least(e, gap_end) - greatest(s, gap_start)) FILTER (detector = 'vad') AS v,
  sum(least(e, gap_end) - greatest(s, gap_start)) FILTER (detector = 'gate') AS t
  FROM gaps g JOIN det_union d ON d.source_id = g.source_id AND d.s < g.gap_end AND d.e > g.gap_start GROUP BY 1, 2) x
  ON x.source_id = g.source_id AND x.gap_start = g.gap_start""", "gaps", "det_union")


def gaps(spark, sf):
    return gp.word_gaps(gap_words(spark, sf), gap_media(spark, sf), block=None)


def detectors(spark, sf):
    w = gap_words(spark, sf).where(F.substring("text", -1, 1).isin(".", "!", "?") | (F.col("pos") % 241 == 0))
    vad = w.select("source_id", F.lit("vad").alias("detector"), (F.col("end_ms") - 300).alias("start_ms"),
                   (F.col("end_ms") + (F.col("pos") % 5) * 1000).alias("end_ms"))
    gate = w.where("source_id % 4 > 0").select("source_id", F.lit("gate").alias("detector"), F.col("end_ms").alias("start_ms"),
                                               (F.col("end_ms") + (F.col("pos") % 7) * 600).alias("end_ms"))
    return vad.unionByName(gate)


def audit(spark, sf):
    return gp.coverage_audit(gaps(spark, sf), detectors(spark, sf), ("vad", "gate"), block_ms=None)


@query("word_gaps", with_("gaps", "SELECT * FROM gaps"))
def word_gaps(spark, sf):
    return gaps(spark, sf)


@query("coverage_audit", with_("audit", "SELECT * FROM audit"))
def coverage_audit(spark, sf):
    return audit(spark, sf)


@query("coverage_status", with_("audit gap_media", """SELECT m.source_id, count(a.gap_start) AS gaps, count(*) FILTER (a.suspect) AS suspects,
  CASE WHEN count(*) FILTER (a.suspect) > 0 THEN 'suspect_coverage' WHEN m.source_id IN (SELECT source_id FROM dets) THEN 'clear' ELSE 'unobserved' END AS status
  FROM gap_media m LEFT JOIN audit a ON a.source_id = m.source_id GROUP BY m.source_id"""))
def coverage_status(spark, sf):
    return gp.coverage_status(gap_media(spark, sf), audit(spark, sf), detectors(spark, sf))


cte("blocking", """SELECT source_id, gap_start, gap_end FROM audit WHERE suspect AND CASE WHEN source_id IN
  (SELECT source_id FROM dets WHERE detector = 'gate') THEN gate_ms ELSE vad_ms END >= 3000""", "audit")
cte("gap_sentences", """SELECT source_id, pos, (start_ms + (source_id % 2) * 4000)::BIGINT AS start_ms,
  (end_ms + (source_id % 2) * 4000)::BIGINT AS end_ms FROM sentences""", "sentences")


@query("blocking_gaps", with_("blocking gap_sentences", """SELECT source_id, pos, start_ms, end_ms, EXISTS (SELECT 1 FROM blocking b
  WHERE b.source_id = s.source_id AND s.start_ms <= b.gap_end AND s.end_ms >= b.gap_start) AS touched FROM gap_sentences s"""))
def blocking_gaps(spark, sf):
    stop = gp.blocking_gaps(audit(spark, sf), detectors(spark, sf), "gate", "vad")
    shift = (F.col("source_id") % 2) * 4000
    s = tb.sentences(spark, sf).select("source_id", "pos", (F.col("start_ms") + shift).alias("start_ms"),
                                       (F.col("end_ms") + shift).alias("end_ms"))
    return gp.touched_by(s, stop, ["pos"], bounded=True)


cte("late", """SELECT source_id, pos AS late_id, end_ms + 50 AS start_ms, end_ms + 50 + 900 * (pos % 5) AS end_ms FROM gap_words
  WHERE pos % 5 > 0 AND (right(text, 1) IN ('.', '!', '?') OR pos % 241 = 0)""", "gap_words")


def late(spark, sf):
    w = gap_words(spark, sf).where("pos % 5 > 0").where(F.substring("text", -1, 1).isin(".", "!", "?") | (F.col("pos") % 241 == 0))
    return w.select("source_id", F.col("pos").alias("late_id"), (F.col("end_ms") + 50).alias("start_ms"),
                    (F.col("end_ms") + 50 + (F.col("pos") % 5) * 900).alias("end_ms"))


cte("backfill", """SELECT l.*, CASE WHEN NOT EXISTS (SELECT 1 FROM gaps g WHERE g.source_id = l.source_id AND g.gap_start <= l.start_ms AND l.end_ms <= g.gap_end)
  THEN 'not_wholly_inside_original_gap' WHEN EXISTS (SELECT 1 FROM gap_words b WHERE b.source_id = l.source_id AND l.start_ms < b.end_ms AND l.end_ms > b.start_ms)
  THEN 'overlaps_original_word' END AS reason FROM late l""", "late", "gaps")


@query("gap_backfill", with_("backfill", "SELECT * FROM backfill"))
def gap_backfill(spark, sf):
    return gp.gap_backfill(gap_words(spark, sf), late(spark, sf), gaps(spark, sf), bounded=True)


@query("backfilled_words", with_("backfill", """SELECT source_id, start_ms, end_ms, late_id, row_number() OVER (PARTITION BY source_id
  ORDER BY start_ms, end_ms, late_id) AS pos FROM (SELECT source_id, start_ms, end_ms, 0 AS late_id FROM gap_words
  UNION ALL SELECT source_id, start_ms, end_ms, late_id FROM backfill WHERE reason IS NULL)"""))
def backfilled_words(spark, sf):
    rows = gp.gap_backfill(gap_words(spark, sf), late(spark, sf), gaps(spark, sf), bounded=True)
    base = gap_words(spark, sf).select("source_id", "start_ms", "end_ms", F.lit(0).cast("bigint").alias("late_id"))
    both = base.unionByName(rows.where("reason IS NULL").select("source_id", "start_ms", "end_ms", "late_id"))
    return sc.scan(both, U, ["start_ms", "end_ms", "late_id"], None,
                   pos=sc.running_sum(F.lit(1).cast("bigint")))


@query("zero_length_words", with_("words", """SELECT source_id, target AS pos, min(start_ms) FILTER (pos = target) AS start_ms,
  max(e) FILTER (pos = target) AS end_ms, string_agg(text, '' ORDER BY pos) AS text, count(*) > 1 AS merged FROM (
  SELECT *, CASE WHEN e > start_ms THEN pos WHEN start_ms <= le + 50 THEN lp ELSE np END AS target FROM (
  SELECT *, max(CASE WHEN e > start_ms THEN e END) OVER b AS le, max(CASE WHEN e > start_ms THEN pos END) OVER b AS lp,
  min(CASE WHEN e > start_ms THEN pos END) OVER a AS np FROM (SELECT *, CASE WHEN length(text) <= 2 THEN start_ms ELSE end_ms END AS e FROM words)
  WINDOW b AS (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  a AS (PARTITION BY source_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))) GROUP BY source_id, target"""))
def zero_length_words(spark, sf):
    w = tb.words(spark, sf).withColumn("end_ms", F.when(F.length("text") <= 2, F.col("start_ms")).otherwise(F.col("end_ms")))
    return gp.coalesce_zero_length(w, block=None)


@query("tail_overhang", with_("dets gap_media", """SELECT l.source_id, l.e AS gap_start, duration_ms AS gap_end,
  (arg_min(d.end_ms, d.start_ms) - l.e)::BIGINT AS uncovered_ms
  FROM (SELECT source_id, max(end_ms) AS e FROM gap_words GROUP BY 1) l JOIN dets d ON d.source_id = l.source_id AND d.detector = 'vad'
  AND d.start_ms < l.e AND l.e < d.end_ms AND d.end_ms - l.e > 200 JOIN gap_media m ON m.source_id = l.source_id GROUP BY l.source_id, l.e, duration_ms"""))
def tail_overhang(spark, sf):
    return gp.tail_overhang(gap_words(spark, sf), detectors(spark, sf).where("detector = 'vad'"), gap_media(spark, sf))


# Relations over document words: every 37th word opens one that spans as many words as three times its length.
cte("sizes", "SELECT source_id, max(pos) AS n_words FROM words GROUP BY 1", "words")
cte("relations", """SELECT w.source_id, pos AS relation, pos AS first_word, least(pos + 3 * length(text), n_words)::BIGINT AS last_word
  FROM words w JOIN sizes s ON s.source_id = w.source_id WHERE pos % 37 = 0""", "words", "sizes")
cte("envelopes", """SELECT source_id, min(first_word) AS first_word, max(last_word) AS last_word, count(*) AS members FROM (
  SELECT *, sum(CASE WHEN r IS NULL OR first_word > r THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY first_word) AS g FROM (
  SELECT *, max(last_word) OVER (PARTITION BY source_id ORDER BY first_word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM relations))
  GROUP BY source_id, g""", "relations")
cte("cuts", """SELECT source_id, after_word, bool_or(required) AS required FROM (
  SELECT s.source_id, s.last_word AS after_word, false AS required FROM sentences s JOIN sizes z ON z.source_id = s.source_id WHERE s.last_word < z.n_words
  UNION ALL SELECT w.source_id, pos, true FROM words w JOIN sizes z ON z.source_id = w.source_id WHERE pos % 241 = 0 AND pos < n_words) GROUP BY 1, 2""",
    "sentences", "sizes")
cte("cut_audit", """SELECT c.*, CASE WHEN NOT EXISTS (SELECT 1 FROM envelopes e WHERE e.source_id = c.source_id AND e.first_word <= c.after_word
  AND c.after_word < e.last_word) THEN 'selected' WHEN required THEN 'relation_conflicts_with_required_boundary' ELSE 'inside_relation_group' END AS outcome
  FROM cuts c""", "cuts", "envelopes")
cte("rel_events", """SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY last_word) AS event,
  (coalesce(lag(last_word) OVER (PARTITION BY source_id ORDER BY last_word), 0) + 1)::BIGINT AS first_word, last_word, n_words FROM (
  SELECT source_id, after_word AS last_word FROM cut_audit WHERE outcome = 'selected' UNION SELECT source_id, n_words FROM sizes) JOIN sizes USING (source_id)""",
    "cut_audit", "sizes")


def sizes(spark, sf):
    return tb.words(spark, sf).groupBy("source_id").agg(F.max("pos").alias("n_words"))


def relations(spark, sf):
    w = tb.words(spark, sf).where("pos % 37 = 0").join(sizes(spark, sf), "source_id")
    return w.select("source_id", F.col("pos").alias("relation"), F.col("pos").alias("first_word"),
                    F.least(F.col("pos") + F.length("text") * 3, F.col("n_words")).alias("last_word"))


def cuts(spark, sf):
    n = sizes(spark, sf)
    s = tb.sentences(spark, sf).select("source_id", F.col("last_word").alias("after_word"), F.lit(False).alias("required"))
    r = tb.words(spark, sf).where("pos % 241 = 0").select("source_id", F.col("pos").alias("after_word"), F.lit(True).alias("required"))
    return s.unionByName(r).join(n, "source_id").where("after_word < n_words").drop("n_words")


def envelopes(spark, sf):
    return il.inclusive_union(relations(spark, sf), U, "first_word", "last_word", None)


def rel_events(spark, sf):
    picked = sp.cut_audit(cuts(spark, sf), envelopes(spark, sf)).where("outcome = 'selected'")
    return sp.events_between(picked, sizes(spark, sf), block=None)


@query("relation_envelopes", with_("envelopes", "SELECT * FROM envelopes"))
def relation_envelopes(spark, sf):
    return envelopes(spark, sf)


@query("cut_audit", with_("cut_audit", "SELECT * FROM cut_audit"))
def cut_audit(spark, sf):
    return sp.cut_audit(cuts(spark, sf), envelopes(spark, sf))


@query("relation_events", with_("rel_events", """SELECT source_id, event, first_word, last_word, first_word = 1 OR last_word = n_words AS source_edge
  FROM rel_events"""))
def relation_events(spark, sf):
    return rel_events(spark, sf)


@query("relation_owners", with_("rel_events relations", """SELECT r.source_id, relation, event FROM relations r JOIN rel_events e
  ON e.source_id = r.source_id AND e.first_word <= r.first_word AND r.last_word <= e.last_word"""))
def relation_owners(spark, sf):
    return sp.span_owner(relations(spark, sf), rel_events(spark, sf))


@query("active_counts", with_("cuts relations", """SELECT c.source_id, c.after_word, required, count(r.relation) AS active FROM cuts c LEFT JOIN relations r
  ON r.source_id = c.source_id AND r.first_word <= c.after_word AND c.after_word < r.last_word GROUP BY ALL"""))
def active_counts(spark, sf):
    c = cuts(spark, sf).groupBy("source_id", "after_word").agg(F.max("required").alias("required"))
    return il.active_counts(c, relations(spark, sf), U, "after_word", "first_word", "last_word")


@query("fixed_chunks", """SELECT doc_id AS source_id, n_chars, chunk, chunk * 900 AS first, least(chunk * 900 + 900, n_chars)::BIGINT AS stop
  FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars + 899) // 900)) AS chunk FROM documents WHERE n_chars > 0)""")
def fixed_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "n_chars")
    return il.fixed_chunks(d, "n_chars", 900)


@query("integer_runs", with_("windows", """SELECT source_id, first_pos, min(last_pos) AS first, max(last_pos) AS last FROM (SELECT *, last_pos - row_number()
  OVER (PARTITION BY source_id, first_pos ORDER BY last_pos) AS g FROM windows) GROUP BY source_id, first_pos, g"""))
def integer_runs(spark, sf):
    return il.integer_runs(wn.sentence_windows(tb.plain_features(spark, sf), bounded=True), U, "first_pos", "last_pos", block=None)


def sentence_spans(spark, sf):
    return tb.sentences(spark, sf).select("source_id", F.col("pos").alias("span"), "first_word", "last_word", "start_ms", "end_ms")


@query("compiled_spans", with_("word_sent", """SELECT source_id, sent AS span, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words,
  string_agg(text, '' ORDER BY pos) AS text FROM word_sent GROUP BY ALL"""))
def compiled_spans(spark, sf):
    return sp.compile_bounded_spans(sentence_spans(spark, sf), tb.words(spark, sf))


@query("uncovered_sources", with_("rel_events relations", """SELECT source_id FROM sizes LEFT JOIN (SELECT source_id, count(*) AS w, max(k) AS k FROM (
  SELECT source_id, p, count(*) AS k FROM (SELECT source_id, unnest(range(first_word, last_word + 1)) AS p FROM relations) GROUP BY 1, 2) GROUP BY 1)
  USING (source_id) WHERE coalesce(w, 0) <> n_words OR k > 1"""))
def uncovered_sources(spark, sf):
    spans = relations(spark, sf).withColumnRenamed("relation", "span")
    return sp.compile_spans(spans, tb.words(spark, sf), sizes(spark, sf))[1]


cte("safe", """SELECT source_id, span, start_ms, end_ms, (p * 30 + 999) // 1000 AS start_min, (start_ms * 30) // 1000 AS start_max,
  (end_ms * 30 + 999) // 1000 AS end_min, (n * 30) // 1000 AS end_max FROM (SELECT source_id, pos AS span, start_ms, end_ms,
  coalesce(lag(end_ms) OVER w, 0) AS p, coalesce(lead(start_ms) OVER w, end_ms + 1000) AS n FROM sentences WINDOW w AS (PARTITION BY source_id ORDER BY pos))""",
    "sentences")
cte("safe_frames", """SELECT *, CASE WHEN refusal IS NULL THEN start_max END AS source_in, CASE WHEN refusal IS NULL THEN end_min END AS source_out FROM (
  SELECT *, CASE WHEN start_min > start_max OR end_min > end_max THEN 'no_legal_frame' WHEN start_max >= end_min THEN 'outside_media' END AS refusal FROM safe)""", "safe")


def safe_frames(spark, sf):
    # A sentence takes what its outer words see with it, as it is gathered from them.
    words = wn.sentence_words(sp.word_reach(tb.words(spark, sf), block=None), block_rows=None)
    rows = wn.sentence_rows(words, prev_end=F.min_by("prev_end", "pos"), next_start=F.max_by("next_start", "pos"))
    limit = F.max("end_ms").over(Window.partitionBy("source_id")) + 1000
    spans = wn.numbered(rows, U, ["first_word"], None, "span").withColumn("end_limit_ms", limit)
    return sp.safe_frames(spans)


@query("safe_frames", with_("safe_frames", "SELECT * FROM safe_frames"))
def safe_frames_query(spark, sf):
    return safe_frames(spark, sf)


cte("plain_gaps", """SELECT source_id, end_ms AS gap_start, nxt AS gap_end FROM (SELECT *, lead(start_ms) OVER (PARTITION BY source_id ORDER BY pos) AS nxt
  FROM words) WHERE nxt - end_ms > 3000""", "words")


@query("reviewed_extension", with_("safe_frames plain_gaps", """SELECT s.source_id, span, source_in, source_out AS old_out, (g.gap_end * 30) // 1000 AS source_out
  FROM safe_frames s JOIN plain_gaps g ON g.source_id = s.source_id AND g.gap_start = s.end_ms WHERE refusal IS NULL AND (g.gap_end * 30) // 1000 > source_out"""))
def reviewed_extension(spark, sf):
    w = tb.words(spark, sf)
    found = gp.word_gaps(w, w.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")), block=None)
    return sp.reviewed_extension(safe_frames(spark, sf), found.select("source_id", "gap_start", "gap_end"), found)


# A word meets a clip that starts in it, or that it starts in; clips are sentences moved by 150 ms, so few lie at one time.
cte("clips", "SELECT source_id, pos AS range_id, start_ms + 150 AS s, end_ms + 150 AS e FROM sentences", "sentences")
cte("clip_bins", "SELECT *, unnest(range(s // 5000, e // 5000 + 1)) AS bin FROM clips", "clips")
cte("clip_pairs", """SELECT w.source_id, range_id, w.pos, w.start_ms, w.end_ms, s, e FROM (SELECT *, start_ms // 5000 AS bin FROM words) w JOIN clip_bins c ON c.source_id = w.source_id AND c.bin = w.bin AND s <= w.start_ms AND w.start_ms < e
  UNION ALL SELECT w.source_id, range_id, w.pos, w.start_ms, w.end_ms, s, e FROM (SELECT *, unnest(range(start_ms // 5000, end_ms // 5000 + 1)) AS bin FROM words) w JOIN (SELECT *, s // 5000 AS bin FROM clips) c ON c.source_id = w.source_id AND c.bin = w.bin AND w.start_ms < s AND s < w.end_ms""", "words", "clip_bins")


@query("clipped_words", with_("clip_pairs", """SELECT source_id, range_id, pos, greatest(start_ms, s) AS start_ms, least(end_ms, e) AS end_ms, greatest(start_ms, s) - start_ms AS cut_head, end_ms - least(end_ms, e) AS cut_tail FROM clip_pairs"""))
def clipped_words(spark, sf):
    r = tb.sentences(spark, sf).select("source_id", F.col("pos").alias("range_id"), (F.col("start_ms") + 150).alias("r_start"),
                                       (F.col("end_ms") + 150).alias("r_end"))
    return sp.clip_to_range(tb.words(spark, sf), r)


cte("options", """SELECT a.source_id, a.pos AS option, a.first_word, b.last_word FROM sentences a JOIN sentences b
  ON b.source_id = a.source_id AND b.pos = a.pos + a.pos % 3""", "sentences")
cte("eblocks", """SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY first_word) AS block, first_word,
  coalesce(lead(first_word) OVER (PARTITION BY source_id ORDER BY first_word) - 1, n_words)::BIGINT AS last_word FROM (
  SELECT source_id, first_word FROM options UNION SELECT source_id, last_word + 1 FROM options UNION SELECT source_id, 1 FROM sizes) JOIN sizes USING (source_id)
  WHERE first_word <= n_words""", "options", "sizes")


def options(spark, sf):
    # An option ends at most two sentences on, so its end is read from the rows that follow.
    line = Window.partitionBy("source_id").orderBy("pos")
    ends = [F.lead("last_word", n).over(line) for n in range(3)]
    last = F.when(F.col("pos") % 3 == 0, ends[0]).when(F.col("pos") % 3 == 1, ends[1]).otherwise(ends[2])
    rows = tb.sentences(spark, sf).select("source_id", F.col("pos").alias("option"), "first_word", last.alias("last_word"))
    return rows.where("last_word IS NOT NULL")


@query("elementary_blocks", with_("eblocks", "SELECT * FROM eblocks"))
def elementary_blocks(spark, sf):
    return sp.elementary_blocks(options(spark, sf), sizes(spark, sf), block=None)[0]


@query("option_blocks", with_("eblocks", """SELECT o.source_id, option, a.block AS first_block, b.block AS last_block FROM options o
  JOIN eblocks a ON a.source_id = o.source_id AND a.first_word = o.first_word JOIN eblocks b ON b.source_id = o.source_id AND b.last_word = o.last_word"""))
def option_blocks(spark, sf):
    return sp.elementary_blocks(options(spark, sf), sizes(spark, sf), block=None)[1]


cte("ex_words", "SELECT w.source_id, block, w.pos, w.text, w.start_ms, w.end_ms, row_number() OVER (PARTITION BY w.source_id, block ORDER BY w.pos) AS rk FROM eblocks e JOIN words w ON w.source_id = e.source_id AND w.pos BETWEEN e.first_word AND e.last_word", "eblocks", "words")
cte("ex_walk", """SELECT source_id, block, rk, 0::BIGINT AS part, length(text) AS used FROM ex_words WHERE rk = 1
  UNION ALL SELECT w.source_id, w.block, w.rk, e.part + (e.used + length(text) > 40)::BIGINT, CASE WHEN e.used + length(text) > 40 THEN 0 ELSE e.used END + length(text) FROM ex_walk e JOIN ex_words w ON w.source_id = e.source_id AND w.block = e.block AND w.rk = e.rk + 1""", "ex_words", recursive=True)


@query("excerpts", with_("ex_walk", """SELECT w.source_id, w.block, part, min(pos) AS first_word, max(pos) AS last_word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, '' ORDER BY pos) AS text
  FROM ex_walk e JOIN ex_words w ON w.source_id = e.source_id AND w.block = e.block AND w.rk = e.rk GROUP BY 1, 2, 3"""))
def excerpts(spark, sf):
    blocks, _ = sp.elementary_blocks(options(spark, sf), sizes(spark, sf), block=None)
    return sp.bounded_excerpts(blocks, tb.words(spark, sf))


# Join kinds on user timelines.
@query("overlap_join", with_("ivals", """SELECT a.source_id, a.event_id, b.event_id AS other_id FROM ivals a JOIN ivals b ON a.source_id = b.source_id
  AND a.event_type = 'purchase' AND b.event_type = 'error' AND a.start_ms < b.end_ms AND a.end_ms > b.start_ms"""))
def overlap_join(spark, sf):
    i = tb.intervals(spark, sf)
    a = i.where("event_type = 'purchase'").select("source_id", "event_id", "start_ms", "end_ms")
    b = i.where("event_type = 'error'").select("source_id", F.col("event_id").alias("other_id"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return rj.overlap_join(a, b, U, ("start_ms", "end_ms"), ("s", "e"), bin_ms=3_600_000).select("source_id", "event_id", "other_id")


@query("point_join", with_("ivals", """SELECT a.source_id, a.event_id, b.event_id AS other_id FROM ivals a JOIN ivals b ON a.source_id = b.source_id
  AND b.event_type = 'error' AND b.start_ms <= a.end_ms AND a.end_ms < b.end_ms"""))
def point_join(spark, sf):
    i = tb.intervals(spark, sf)
    a = i.select("source_id", "event_id", F.col("end_ms").alias("at"))
    b = i.where("event_type = 'error'").select("source_id", F.col("event_id").alias("other_id"), "start_ms", "end_ms")
    return rj.point_join(a, b, U, "at", ("start_ms", "end_ms"), bin_ms=3_600_000).select("source_id", "event_id", "other_id")


@query("shortest_parent", with_("ivals", """SELECT source_id, event_id, parent_id FROM (SELECT a.source_id, a.event_id, b.event_id AS parent_id, row_number() OVER
  (PARTITION BY a.event_id ORDER BY b.end_ms - b.start_ms, b.event_id) AS r FROM ivals a JOIN ivals b ON a.source_id = b.source_id AND a.event_id <> b.event_id
  AND b.start_ms <= a.start_ms AND a.end_ms <= b.end_ms) WHERE r = 1"""))
def shortest_parent(spark, sf):
    i = tb.intervals(spark, sf)
    a = i.select("source_id", "event_id", "start_ms", "end_ms")
    b = i.select("source_id", F.col("event_id").alias("parent_id"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    p = rj.containment_join(a, b, U, ("start_ms", "end_ms"), ("s", "e"), bin_ms=3_600_000).where("event_id <> parent_id")
    return p.groupBy("source_id", "event_id").agg(F.min_by("parent_id", F.struct(F.col("e") - F.col("s"), "parent_id")).alias("parent_id"))
