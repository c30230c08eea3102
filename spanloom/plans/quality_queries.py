"""Queries of contract checks, choices, external scores and budgets."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import choices as ch, greedy as gr, quality as ql, scan as sc, windows as wn
from ..session import cut, table
from . import tables as tb
from .catalog import query
from .oracle import cte, with_

KEY = ["source_id"]

cte("odd_ivals", """SELECT source_id, event_id, event_id // (CASE WHEN event_id % 50 = 1 THEN 2 ELSE 1 END) * (CASE WHEN event_id % 50 = 1 THEN 2 ELSE 1 END) AS ident,
  CASE WHEN event_id % 29 = 0 THEN end_ms ELSE start_ms END AS start_ms, CASE WHEN event_id % 29 = 0 THEN start_ms ELSE end_ms END AS end_ms FROM ivals""", "ivals")


def odd_intervals(spark, sf):
    e = F.col("event_id")
    swap = e % 29 == 0
    return tb.intervals(spark, sf).select("source_id", "event_id", F.when(e % 50 == 1, e - e % 2).otherwise(e).alias("ident"),
                                          F.when(swap, F.col("end_ms")).otherwise(F.col("start_ms")).alias("start_ms"),
                                          F.when(swap, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"))


@query("interval_violations", with_("odd_ivals", """SELECT source_id, event_id, unnest(list_filter([CASE WHEN NOT (start_ms >= 0 AND start_ms < end_ms AND end_ms <= 2500000000) THEN 'range' END,
  CASE WHEN start_ms < p THEN 'order' END, CASE WHEN n > 1 THEN 'duplicate_id' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, lag(start_ms) OVER (PARTITION BY source_id ORDER BY event_id) AS p,
  count(*) OVER (PARTITION BY source_id, ident) AS n FROM odd_ivals)"""))
def interval_violations(spark, sf):
    rows = odd_intervals(spark, sf)
    media = rows.select("source_id").distinct().withColumn("duration_ms", F.lit(2_500_000_000))
    return ql.check_intervals(rows, media, "ident", order="event_id", block=sc.by_rows("event_id"))


@query("tiling_violations", with_("ev", """SELECT source_id, breaks, abs(e - d) > 0 AS not_covered FROM (SELECT source_id, count(*) FILTER (start_ms <> coalesce(p, 0)) AS breaks, max(end_ms) AS e, max(end_ms) + (source_id % 7 = 0)::INT AS d FROM (
  SELECT *, lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms) AS p FROM (SELECT source_id, at_ms + (source_id % 3 = 0 AND event_id % 5 = 0)::INT AS start_ms, nxt AS end_ms
  FROM (SELECT *, lead(at_ms) OVER (PARTITION BY source_id ORDER BY at_ms, event_id) AS nxt FROM ev) WHERE nxt > at_ms)) GROUP BY source_id) WHERE breaks > 0 OR abs(e - d) > 0"""))
def tiling_violations(spark, sf):
    e = tb.events(spark, sf)
    near = sc.scan(e, KEY, ["at_ms", "event_id"], sc.by_time("at_ms", 86_400_000), end_ms=sc.following(F.col("at_ms")))
    rows = near.where("end_ms > at_ms").select("source_id", (F.col("at_ms") + ((F.col("source_id") % 3 == 0) & (F.col("event_id") % 5 == 0)).cast("int")).alias("start_ms"), "end_ms")
    media = rows.groupBy("source_id").agg((F.max("end_ms") + (F.col("source_id") % 7 == 0).cast("int")).alias("duration_ms"))
    return ql.check_tiling(rows, media, block=sc.by_time("start_ms", 86_400_000))


cte("odd_owner", """SELECT source_id, pos, start_ms, end_ms, CASE WHEN pos % 41 = 0 THEN range(first_word, last_word) WHEN pos % 43 = 0 THEN range(first_word - 1, last_word + 1) ELSE range(first_word, last_word + 1) END AS ids FROM sentences""", "sentences")


@query("ownership_violations", with_("odd_owner words", """SELECT source_id, p AS pos, CASE WHEN w IS NULL THEN 'unknown_word' WHEN n IS NULL THEN 'unowned_word' WHEN n > 1 THEN 'word_owned_twice' END AS rule FROM (
  SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.pos, b.p) AS p, a.pos AS w, n FROM words a FULL JOIN (SELECT source_id, p, count(*) AS n FROM (SELECT source_id, unnest(ids) AS p FROM odd_owner) GROUP BY 1, 2) b
  ON a.source_id = b.source_id AND a.pos = b.p) WHERE w IS NULL OR n IS NULL OR n > 1
  UNION ALL SELECT source_id, pos, 'sentence_bounds' FROM (SELECT o.source_id, o.pos, o.start_ms, o.end_ms, min(w.start_ms) AS a, max(w.end_ms) AS b FROM (SELECT *, unnest(ids) AS p FROM odd_owner) o
  JOIN words w ON w.source_id = o.source_id AND w.pos = p GROUP BY ALL) WHERE a <> start_ms OR b <> end_ms"""))
def ownership_violations(spark, sf):
    f, l = F.col("first_word"), F.col("last_word")
    ids = (F.when((F.col("pos") % 41 == 0) & (l > f), F.sequence(f, l - 1)).when(F.col("pos") % 41 == 0, F.array().cast("array<bigint>"))
           .when(F.col("pos") % 43 == 0, F.sequence(f - 1, l)).otherwise(F.sequence(f, l)))
    return ql.check_bounded_ownership(tb.sentences(spark, sf).withColumn("word_ids", ids), tb.words(spark, sf))


cte("odd_cands", """SELECT source_id, first_pos * 4294967296 + last_pos AS candidate, start_ms, CASE WHEN first_pos % 31 = 0 THEN end_ms + 1 WHEN first_pos % 47 = 0 THEN start_ms + 95000 ELSE end_ms END AS end_ms,
  CASE WHEN last_pos % 37 = 0 AND last_pos - first_pos > 1 THEN list_filter(range(first_pos, last_pos + 1), lambda x: x <> first_pos + 1) ELSE range(first_pos, last_pos + 1) END AS refs FROM windows""", "windows")


@query("candidate_violations", with_("odd_cands blocks", """SELECT source_id, candidate, rules FROM (SELECT c.source_id, c.candidate, array_to_string(list_filter([CASE WHEN l - f + 1 <> n THEN 'not_contiguous' END,
  CASE WHEN s <> start_ms OR e <> end_ms THEN 'bounds' END, CASE WHEN end_ms - start_ms NOT BETWEEN 15000 AND 90000 THEN 'duration' END,
  CASE WHEN EXISTS (SELECT 1 FROM sentences o WHERE o.source_id = c.source_id AND o.start_ms < c.end_ms AND o.end_ms > c.start_ms AND NOT list_contains(refs, o.pos)) THEN 'foreign_sentence' END,
  CASE WHEN same > 1 THEN 'duplicate_range' END], lambda x: x IS NOT NULL), ',') AS rules FROM (SELECT *, count(*) OVER (PARTITION BY source_id, start_ms, end_ms) AS same FROM odd_cands) c
  JOIN (SELECT o.source_id, o.candidate, count(*) AS n, min(p) AS f, max(p) AS l, min(b.start_ms) AS s, max(b.end_ms) AS e FROM (SELECT source_id, candidate, unnest(refs) AS p FROM odd_cands) o
  JOIN blocks b ON b.source_id = o.source_id AND b.pos = p GROUP BY 1, 2) x ON x.source_id = c.source_id AND x.candidate = c.candidate) WHERE rules <> ''"""))
def candidate_violations(spark, sf):
    w = wn.sentence_windows(tb.plain_features(spark, sf), bounded=True)
    f, l = F.col("first_pos"), F.col("last_pos")
    refs = F.sequence(f, l)
    rows = w.select("source_id", (f * 4_294_967_296 + l).alias("candidate"), "start_ms",
                    F.when(f % 31 == 0, F.col("end_ms") + 1).when(f % 47 == 0, F.col("start_ms") + 95000).otherwise(F.col("end_ms")).alias("end_ms"),
                    F.when((l % 37 == 0) & (l - f > 1), F.filter(refs, lambda x: x != f + 1)).otherwise(refs).alias("refs"))
    return ql.check_bounded_candidates(rows, tb.sentences(spark, sf))


def every(spark, sf):
    """All scored windows with their rank; a candidate's id packs its first and last sentence."""
    rows = wn.ranked(wn.score_rule(tb.features(spark, sf), bounded=True))
    return rows.withColumn("candidate", F.col("first_pos") * 4_294_967_296 + F.col("last_pos"))


def top(spark, sf):
    """The five best windows of each source, those that a reviewer is shown."""
    best = wn.best_per_source(wn.score_rule(tb.features(spark, sf), bounded=True), 5)
    return best.withColumn("candidate", F.col("first_pos") * 4_294_967_296 + F.col("last_pos"))


def survivors(spark, sf):
    """The scored windows that survive the overlap suppression, with their rank among them."""
    return wn.ranked(kept_windows(every(spark, sf).drop("rank")))


def kept_windows(rows):
    """``rows`` that survive the overlap suppression; the windows of a document lie together and are walked there."""
    order = [-F.col("score"), F.col("start_ms"), F.col("end_ms"), F.col("candidate")]
    more = [c for c in rows.columns if c not in ("source_id", "candidate")]
    kept = gr.greedy_bounded(rows, KEY, order, "candidate", iou_limit=0.5, carry=more, retained_only=True)
    return kept.select("source_id", "candidate", *more)


@query("score_violations", with_("every", """SELECT source_id, first_pos, last_pos, rules FROM (SELECT source_id, first_pos, last_pos, array_to_string(list_filter([CASE WHEN abs(s2 - score) > 2e-6 THEN 'score_parts' END,
  CASE WHEN rank <> row_number() OVER (PARTITION BY source_id ORDER BY s2 DESC, start_ms, end_ms, first_pos) THEN 'rank_order' END], lambda x: x IS NOT NULL), ',') AS rules
  FROM (SELECT *, CASE WHEN first_pos % 13 = 0 THEN score - 0.5 ELSE score END AS s2 FROM every)) WHERE rules <> ''"""))
def score_violations(spark, sf):
    return ql.check_scores(every(spark, sf).withColumn("score", F.when(F.col("first_pos") % 13 == 0, F.col("score") - 0.5).otherwise(F.col("score"))))


SCORES = {"completeness": "length(text) % 44", "clarity": "length(text) % 31", "engagement": "pos % 21", "conciseness": "pos % 11"}
FINDINGS = {"completeness": ("clear", "incomplete", "vague"), "clarity": ("clear", "uncertain", "uncertain"), "engagement": ("question", "limited", "limited"), "conciseness": ("concise", "filler", "filler")}


def finding_sql(name: str) -> str:
    a, b, c = FINDINGS[name]
    return f"CASE WHEN pos % 5 < 3 THEN '{a}' WHEN pos % 5 = 3 THEN '{b}' ELSE '{c}' END"


QUOTE = "CASE WHEN pos % 9 = 4 THEN 'no such words' ELSE substr(text, 1, 12) END"
FAULT = {n: f"CASE WHEN NOT ({SCORES[n]} <= {m} AND {finding_sql(n)} IN ({', '.join(repr(x) for x in f)}) AND trim({QUOTE}) <> '' AND length({QUOTE}) <= 40 AND contains(text, {QUOTE})) THEN '{n}' END" for n, m, f in ql.DIMENSIONS}
cte("assessed", "SELECT source_id, pos, array_to_string(list_filter([" + ", ".join(FAULT.values()) + "], lambda x: x IS NOT NULL), ',') AS faults, (" + " + ".join(SCORES.values()) + ")::BIGINT AS t, " +
    " || '; ' || ".join(f"'{n} ' || ({SCORES[n]}) || '/{m}: ' || {finding_sql(n)}" for n, m, _ in ql.DIMENSIONS) + " AS r FROM turns", "turns")


def assessed(spark, sf):
    t = tb.turns(spark, sf)
    for name, _, _ in ql.DIMENSIONS:
        t = t.withColumn(name, F.struct(F.expr(SCORES[name]).cast("int").alias("score"), F.expr(finding_sql(name)).alias("finding"), F.expr(QUOTE).alias("quote")))
    return ql.assess(t)


@query("assessments", with_("assessed", "SELECT source_id, pos, faults, CASE WHEN faults = '' THEN t END AS total, CASE WHEN faults = '' THEN r END AS reason FROM assessed"))
def assessments(spark, sf):
    return assessed(spark, sf).select("source_id", "pos", "faults", "total", "reason")


@query("citation_faults", with_("options", """SELECT source_id, option, array_to_string(list_filter([CASE WHEN len(refs) NOT BETWEEN 1 AND 4 THEN 'count' END, CASE WHEN len(refs) <> len(list_distinct(refs)) THEN 'repeated' END,
  CASE WHEN len(list_filter(refs, lambda x: x < 1 OR x > k)) > 0 THEN 'unknown' END, CASE WHEN len(list_filter(refs, lambda x: x BETWEEN option AND option + option % 3 AND x <= k)) = 0 THEN 'outside_option' END], lambda x: x IS NOT NULL), ',') AS faults
  FROM (SELECT o.*, k, CASE WHEN option % 8 = 0 THEN [option, option] WHEN option % 10 = 2 THEN range(option, option + 6) WHEN option % 14 = 4 THEN [option + 7] ELSE [option, option + 1] END AS refs FROM options o
  JOIN (SELECT source_id, max(pos) AS k FROM sentences GROUP BY 1) USING (source_id))"""))
def citation_faults(spark, sf):
    from .interval_queries import options
    o = options(spark, sf).select("source_id", "option")
    n = F.col("option")
    refs = F.when(n % 8 == 0, F.array(n, n)).when(n % 10 == 2, F.sequence(n, n + 5)).when(n % 14 == 4, F.array(n + 7)).otherwise(F.array(n, n + 1))
    spans = o.select("source_id", "option", n.alias("first_at"), (n + n % 3).alias("last_at"))
    e = tb.sentences(spark, sf).select("source_id", F.col("pos").alias("excerpt"), F.col("pos").alias("at"))
    return ql.check_citations(o.withColumn("refs", refs), e, spans)


@query("quote_ranges", with_("sentences", """SELECT r.source_id, r.g AS "group", CASE WHEN n = 1 THEN o END AS option, CASE WHEN n IS NULL THEN 'no_range' WHEN n > 1 THEN 'ambiguous_range' END AS fault FROM (
  SELECT source_id, pos // 8 AS g, substr(text, 1, 3) AS op, CASE WHEN pos % 24 = 8 THEN 'zzz' ELSE right(text, 2) END AS en FROM sentences WHERE pos % 8 = 0) r LEFT JOIN (
  SELECT a.source_id, a.g, count(*) AS n, min(b.pos) AS o FROM (SELECT source_id, pos // 8 AS g, substr(text, 1, 3) AS op, CASE WHEN pos % 24 = 8 THEN 'zzz' ELSE right(text, 2) END AS en FROM sentences WHERE pos % 8 = 0) a
  JOIN sentences b ON b.source_id = a.source_id AND b.pos // 8 = a.g AND starts_with(b.text, op) AND ends_with(b.text, en) GROUP BY 1, 2) x ON x.source_id = r.source_id AND x.g = r.g"""))
def quote_ranges(spark, sf):
    s = tb.sentences(spark, sf).withColumn("group", F.floor(F.col("pos") / 8))
    asked = s.where("pos % 8 = 0").select("source_id", "group", F.substring("text", 1, 3).alias("opening"), F.when(F.col("pos") % 24 == 8, "zzz").otherwise(F.right("text", F.lit(2))).alias("ending"))
    return ql.resolve_quotes(asked, s.select("source_id", "group", F.col("pos").alias("option"), "text"))


@query("import_checks", """SELECT d.doc_id AS item, CASE WHEN quality IS NULL THEN 'unknown_item' WHEN d.doc_id % 6 = 1 THEN 'evidence_changed' WHEN NOT (quality = 1 AND toxic = 0) THEN 'not_all_yes' END AS reason,
  NOT (quality IS NULL OR d.doc_id % 6 = 1 OR NOT (quality = 1 AND toxic = 0)) AS accepted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def import_checks(spark, sf):
    l = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.sha2("text", 256).alias("hash"))
    texts = d.withColumn("h", F.when(F.col("item") % 6 == 1, F.lit("changed")).otherwise(F.col("hash"))).select("item", F.col("h").alias("held_hash"))
    held = texts.join(l.select(F.col("doc_id").alias("item")), "item")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    answers = l.select(F.col("doc_id").alias("item"), F.array(yes(F.col("quality") == 1), yes(F.col("toxic") == 0)).alias("answers"))
    return ql.check_import(d.join(answers, "item", "left"), held)


@query("cohort_violations", with_("top", """SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.candidate, b.candidate) AS candidate, array_to_string(list_filter([CASE WHEN b.candidate IS NULL THEN 'missing' END,
  CASE WHEN a.candidate IS NULL THEN 'added' END, CASE WHEN b.e - b.s NOT BETWEEN 15000 AND 90000 THEN 'duration' END, CASE WHEN b.sc IS NOT NULL THEN 'reused_score' END], lambda x: x IS NOT NULL), ',') AS rules
  FROM top a FULL JOIN (SELECT source_id, candidate + (rank = 4 AND first_pos % 2 = 0)::BIGINT AS candidate, start_ms AS s, end_ms - CASE WHEN first_pos % 3 = 0 THEN 4000 ELSE 0 END AS e, CASE WHEN rank = 2 THEN score END AS sc FROM top WHERE NOT (rank = 5 AND source_id % 2 = 0)) b
  ON b.source_id = a.source_id AND b.candidate = a.candidate WHERE b.candidate IS NULL OR a.candidate IS NULL OR b.e - b.s NOT BETWEEN 15000 AND 90000 OR b.sc IS NOT NULL"""))
def cohort_violations(spark, sf):
    a = top(spark, sf)
    b = a.where("NOT (rank = 5 AND source_id % 2 = 0)").select(
        "source_id", (F.col("candidate") + ((F.col("rank") == 4) & (F.col("first_pos") % 2 == 0)).cast("bigint")).alias("candidate"), "start_ms",
        (F.col("end_ms") - F.when(F.col("first_pos") % 3 == 0, 4000).otherwise(0)).alias("end_ms"), F.when(F.col("rank") == 2, F.col("score")).alias("score"))
    return ql.check_cohort(a, b)


@query("duration_policy", """SELECT doc_id AS source_id, d AS duration_ms, CASE WHEN d IS NULL OR d <= 0 THEN 'SOURCE_DURATION_UNKNOWN' WHEN d > 2000 THEN 'SOURCE_DURATION_LIMIT' END AS code
  FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 0 ELSE n_chars END AS d FROM documents)""")
def duration_policy(spark, sf):
    d = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).when(F.col("doc_id") % 19 == 0, 0).otherwise(F.col("n_chars"))
    return ql.duration_policy(table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), d.cast("bigint").alias("duration_ms")), 2000)


@query("over_limit_sources", with_("windows", "SELECT source_id, count(*) AS n FROM windows GROUP BY 1 HAVING count(*) > 500"))
def over_limit_sources(spark, sf):
    return ql.over_limit(wn.sentence_windows(tb.plain_features(spark, sf), bounded=True), KEY, 500)


@query("blind_batch", with_("every", "SELECT source_id, candidate, start_ms, end_ms FROM every"))
def blind_batch(spark, sf):
    hidden = [c for c in every(spark, sf).columns if c not in ("source_id", "candidate", "start_ms", "end_ms")]
    return every(spark, sf).drop(*hidden)


cte("punits", """SELECT *, sum(CASE WHEN start_ms - prev_end > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY pos) AS pauses, CASE WHEN prev_end IS NULL THEN 3 WHEN regexp_matches(pt, '[.!?]$') THEN 2 WHEN start_ms - prev_end >= 150 THEN 1 ELSE 0 END AS sh,
  CASE WHEN nxt IS NULL THEN 3 WHEN regexp_matches(text, '[.!?]$') THEN 2 WHEN nxt - end_ms >= 150 THEN 1 ELSE 0 END AS eh FROM (SELECT *, lag(text) OVER w AS pt, lead(start_ms) OVER w AS nxt FROM blocks WINDOW w AS (PARTITION BY source_id ORDER BY pos))""", "blocks")
cte("opt_base", """SELECT c.source_id, c.candidate, a.pos AS first_unit, b.pos AS last_unit, a.start_ms AS a, b.end_ms AS b, c.start_ms AS cs, c.end_ms AS ce, a.start_ms * 30 // 1000 AS f1, (b.end_ms * 30 + 999) // 1000 AS f2 FROM {c} c
  JOIN punits a ON a.source_id = c.source_id AND abs(a.start_ms - c.start_ms) <= {r} JOIN punits b ON b.source_id = c.source_id AND abs(b.end_ms - c.end_ms) <= {r} AND a.pauses = b.pauses AND a.pos <= b.pos""".format(c="survivors", r=30000), "survivors", "punits")
cte("opt_ok", """SELECT source_id, candidate, f1 AS start_frame, f2 AS end_frame, count(*) AS k FROM opt_base WHERE f2 - f1 BETWEEN 450 AND 2700 AND NOT (f1 = cs * 30 // 1000 AND f2 = (ce * 30 + 999) // 1000)
  AND b - a <= ce - cs + 30000 AND greatest(least(b, ce) - greatest(a, cs), 0) >= least(b - a, ce - cs) * 0.35::DOUBLE GROUP BY ALL""", "opt_base")


def hinted_units(spark, sf):
    s = tb.sentences(spark, sf)
    u = ch.paced_units(s.select("source_id", "pos", "start_ms", "end_ms", "text"), block=None)
    near = sc.scan(u, KEY, ["pos"], None, _pt=sc.previous(F.col("text")), _nx=sc.following(F.col("start_ms")))
    end = r"[.!?]$"
    sh = F.when(F.col("gap_before").isNull(), 3).when(F.col("_pt").rlike(end), 2).when(F.col("gap_before") >= 150, 1).otherwise(0)
    eh = F.when(F.col("_nx").isNull(), 3).when(F.col("text").rlike(end), 2).when(F.col("_nx") - F.col("end_ms") >= 150, 1).otherwise(0)
    return near.withColumn("start_hint", sh).withColumn("end_hint", eh).drop("_pt", "_nx", "text")


@query("repair_options", with_("opt_ok", "SELECT source_id, candidate, count(*) AS options, min(start_frame) AS first_frame, max(end_frame) AS last_frame FROM opt_ok GROUP BY 1, 2"))
def repair_options(spark, sf):
    return ch.bounded_repair_counts(survivors(spark, sf), hinted_units(spark, sf))


def side_sql(edge: str, hint: str) -> str:
    return f"""SELECT source_id, candidate, pos, ms, pauses FROM (SELECT *, row_number() OVER (PARTITION BY source_id, candidate ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, h DESC, dist, pos) AS k FROM (
  SELECT c.source_id, c.candidate, u.pos, u.{edge} AS ms, u.pauses, u.{hint} AS h, abs(u.{edge} - c.{edge}) AS dist, row_number() OVER (PARTITION BY c.source_id, c.candidate ORDER BY abs(u.{edge} - c.{edge}), u.pos) AS r
  FROM survivors c JOIN punits u ON u.source_id = c.source_id AND abs(u.{edge} - c.{edge}) <= 6000)) WHERE k <= 4"""


cte("side_a", side_sql("start_ms", "sh"), "survivors", "punits")
cte("side_b", side_sql("end_ms", "eh"), "survivors", "punits")
cte("choice", """SELECT source_id, candidate, first_unit, last_unit, a AS start_ms, b AS end_ms, f1 AS start_frame, f2 AS end_frame FROM (SELECT a.source_id, a.candidate, a.pos AS first_unit, b.pos AS last_unit, a.ms AS a, b.ms AS b, a.ms * 30 // 1000 AS f1, (b.ms * 30 + 999) // 1000 AS f2,
  c.start_ms AS cs, c.end_ms AS ce FROM side_a a JOIN side_b b ON b.source_id = a.source_id AND b.candidate = a.candidate AND a.pauses = b.pauses AND a.pos <= b.pos JOIN survivors c ON c.source_id = a.source_id AND c.candidate = a.candidate)
  WHERE f2 - f1 BETWEEN 450 AND 2700 AND NOT (f1 = cs * 30 // 1000 AND f2 = (ce * 30 + 999) // 1000) AND b - a <= least(ce - cs + 6000, greatest(45000, ce - cs))""", "side_a", "side_b")


def choices(spark, sf, t):
    return ch.bounded_choice_list(t, hinted_units(spark, sf))


@query("choice_list", with_("choice", "SELECT * FROM choice"))
def choice_list(spark, sf):
    return choices(spark, sf, survivors(spark, sf))


cte("decide", """SELECT t.source_id, t.candidate, CASE WHEN o.f IS NULL OR rank % 5 = 3 THEN 'keep' WHEN rank % 5 = 4 THEN 'uncertain' ELSE 'adjust' END AS action, o.f AS first_unit, o.l AS last_unit FROM survivors t LEFT JOIN (
  SELECT source_id, candidate, arg_min(first_unit, first_unit * 4294967296 + last_unit) AS f, arg_min(last_unit, first_unit * 4294967296 + last_unit) AS l FROM choice GROUP BY 1, 2) o ON o.source_id = t.source_id AND o.candidate = t.candidate""", "survivors", "choice")
cte("resolved", """SELECT t.source_id, t.candidate, action, CASE WHEN action = 'adjust' THEN c.start_frame ELSE t.start_ms * 30 // 1000 END AS start_frame, CASE WHEN action = 'adjust' THEN c.end_frame ELSE (t.end_ms * 30 + 999) // 1000 END AS end_frame
  FROM survivors t JOIN decide d ON d.source_id = t.source_id AND d.candidate = t.candidate LEFT JOIN choice c ON c.source_id = t.source_id AND c.candidate = t.candidate AND c.first_unit = d.first_unit AND c.last_unit = d.last_unit""", "decide")


@query("resolved_choices", with_("resolved", "SELECT *, CASE WHEN count(*) OVER (PARTITION BY source_id, start_frame, end_frame) > 1 THEN 'unresolved_duplicate_range' ELSE 'unverified' END AS status FROM resolved"))
def resolved_choices(spark, sf):
    t = cut(survivors(spark, sf))
    o = choices(spark, sf, t)
    first = o.groupBy("source_id", "candidate").agg(F.min(F.struct("first_unit", "last_unit")).alias("o"))
    r = F.col("rank")
    action = F.when(F.col("o").isNull() | (r % 5 == 3), "keep").when(r % 5 == 4, "uncertain").otherwise("adjust")
    d = t.select("source_id", "candidate", "rank").join(first, ["source_id", "candidate"], "left").select(
        "source_id", "candidate", action.alias("action"), F.col("o.first_unit"), F.col("o.last_unit"))
    return ch.resolve_choices(t.select("source_id", "candidate", "start_ms", "end_ms"), o, d)


cte("edits", """SELECT t.source_id, rank AS edit, candidate, a.first_word + rank % 3 AS first_word, b.last_word - (rank % 2) * 3 + (rank % 5 = 0)::INT * 4 AS last_word, t.start_ms AS ps, t.end_ms AS pe FROM survivors t
  JOIN sentences a ON a.source_id = t.source_id AND a.pos = t.first_pos JOIN sentences b ON b.source_id = t.source_id AND b.pos = t.last_pos""", "survivors", "sentences")
cte("edit_rows", """SELECT e.*, a.start_ms, b.end_ms, a.start_ms * 30 // 1000 AS start_frame, (b.end_ms * 30 + 999) // 1000 AS end_frame FROM edits e LEFT JOIN words a ON a.source_id = e.source_id AND a.pos = e.first_word
  LEFT JOIN words b ON b.source_id = e.source_id AND b.pos = e.last_word""", "edits")


@query("word_followups", with_("edit_rows", """SELECT source_id, edit, candidate, start_frame, end_frame, fault, CASE WHEN fault IS NULL THEN sha256(source_id || '/' || candidate || '/' || first_word || '/' || last_word) END AS followup_id FROM (
  SELECT *, CASE WHEN start_ms IS NULL OR end_ms IS NULL OR first_word > last_word THEN 'word_order' WHEN NOT (ps <= start_ms AND end_ms <= pe) THEN 'outside_parent' WHEN end_frame - start_frame NOT BETWEEN 450 AND 2700 THEN 'duration_limit'
  WHEN min(edit) OVER (PARTITION BY source_id, start_frame, end_frame) <> edit THEN 'repeated_range' END AS fault FROM edit_rows)"""))
def word_followups(spark, sf):
    t = cut(survivors(spark, sf))
    s = tb.sentences(spark, sf)
    r = F.col("rank")
    edits = (t.select("source_id", "candidate", "rank", "first_pos", "last_pos")
             .join(s.select("source_id", F.col("pos").alias("first_pos"), "first_word"), ["source_id", "first_pos"])
             .join(s.select("source_id", F.col("pos").alias("last_pos"), "last_word"), ["source_id", "last_pos"])
             .select("source_id", r.alias("edit"), F.floor((r - 1) / 12).alias("batch"), "candidate", (F.col("first_word") + r % 3).alias("first_word"),
                     (F.col("last_word") - (r % 2) * 3 + (r % 5 == 0).cast("int") * 4).alias("last_word")))
    return ch.word_followups(edits, tb.words(spark, sf), t, batch=["source_id", "batch"], block=None)


@query("external_scores", with_("every", """SELECT source_id, candidate, score AS rule_score, rank AS rule_rank, s AS score, row_number() OVER (PARTITION BY source_id ORDER BY s DESC, start_ms, end_ms, candidate) AS rank,
  CASE WHEN ok THEN 'external' ELSE 'rule' END AS effective_scorer, CASE WHEN NOT ok THEN 'invalid_assessment' END AS fallback_reason FROM (SELECT *, CASE WHEN ok THEN (first_pos * 7 + last_pos) % 101 ELSE score END::DOUBLE AS s FROM (
  SELECT *, bool_and(NOT (source_id % 7 = 3 AND rank = 2)) OVER (PARTITION BY source_id) AS ok FROM every))"""))
def external_scores(spark, sf):
    t = every(spark, sf).select("source_id", "candidate", "start_ms", "end_ms", "score", "rank", "first_pos", "last_pos")
    given = t.where("NOT (source_id % 7 = 3 AND rank = 2)").select("source_id", "candidate", ((F.col("first_pos") * 7 + F.col("last_pos")) % 101).alias("total"))
    return ch.apply_external(t.drop("first_pos", "last_pos"), given, bounded=True)


@query("budget_admission", """SELECT user_id AS source_id, event_id, floor(value)::BIGINT + 512 AS cost, sum(floor(value)::BIGINT + 512) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS reserved,
  sum(floor(value)::BIGINT + 512) OVER (PARTITION BY user_id ORDER BY event_id) <= 20000 AS admitted FROM events""")
def budget_admission(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("source_id"), "event_id", (F.floor("value") + 512).alias("cost"))
    return ch.admit_budget(e, ["event_id"], "cost", 20_000, sc.by_rows("event_id"))
