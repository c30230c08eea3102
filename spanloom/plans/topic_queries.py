"""Queries of topics, repeated texts and discourse links."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import continuity as ct, discourse as dc, islands as il, text_groups as tg, topic_walk as tw, topics as tp
from . import tables as tb
from .catalog import query
from .oracle import cte, with_

TERMS = r"""regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[一-鿿]+|[a-z]+|\d+(?:\.\d+)?')""".replace(r"一-鿿", "一-鿿")
cte("unit_terms", f"""SELECT source_id, pos, term, count(*) AS n FROM (SELECT source_id, pos, unnest({TERMS}) AS term FROM sentences)
  WHERE term NOT IN ('the', 'and', 'of', 'to', 'a', 'is') GROUP BY ALL""", "sentences")
cte("unit_idf", """SELECT t.source_id, term, 1 + ln((1 + k) / (1 + count(*))::DOUBLE) AS idf FROM unit_terms t
  JOIN (SELECT source_id, count(*) AS k FROM sentences GROUP BY 1) s ON s.source_id = t.source_id GROUP BY t.source_id, term, k""", "unit_terms")
cte("unit_block", """SELECT *, min(pos) OVER (PARTITION BY source_id, hard_block) AS bf, max(pos) OVER (PARTITION BY source_id, hard_block) AS bl,
  lead(start_ms) OVER (PARTITION BY source_id ORDER BY pos) - end_ms AS gap_ms FROM blocks""", "blocks")
cte("edges", "SELECT source_id, pos AS after_unit, bf, bl, gap_ms, pos = bl AS hard FROM unit_block WHERE gap_ms IS NOT NULL", "unit_block")
cte("side", """SELECT e.source_id, e.after_unit, t.term, max(idf) AS idf, sum(n) FILTER (t.pos <= e.after_unit) AS l, sum(n) FILTER (t.pos > e.after_unit) AS r
  FROM edges e JOIN unit_terms t ON t.source_id = e.source_id AND t.pos BETWEEN greatest(e.after_unit - 2, bf) AND least(e.after_unit + 3, bl) AND NOT hard
  JOIN unit_idf i ON i.source_id = t.source_id AND i.term = t.term GROUP BY ALL""", "edges", "unit_terms", "unit_idf")
cte("sims", """SELECT e.*, CASE WHEN na > 0 AND nb > 0 THEN round_even(least(1.0::DOUBLE, coalesce(dot, 0) / (sqrt(na) * sqrt(nb))) * 1e9::DOUBLE, 0) / 1e9::DOUBLE END AS similarity FROM edges e LEFT JOIN (
  SELECT source_id, after_unit, sum(round_even((1 + ln(l)) * idf * ((1 + ln(r)) * idf) * 1e10::DOUBLE, 0)::BIGINT)::BIGINT AS dot,
  sum(round_even((1 + ln(l)) * idf * ((1 + ln(l)) * idf) * 1e10::DOUBLE, 0)::BIGINT)::BIGINT AS na, sum(round_even((1 + ln(r)) * idf * ((1 + ln(r)) * idf) * 1e10::DOUBLE, 0)::BIGINT)::BIGINT AS nb
  FROM side GROUP BY 1, 2) x ON x.source_id = e.source_id AND x.after_unit = e.after_unit""", "side")
cte("curve", """SELECT *, CASE WHEN lag(after_unit) OVER w = after_unit - 1 THEN lag(similarity) OVER w END AS ps,
  CASE WHEN lead(after_unit) OVER w = after_unit + 1 THEN lead(similarity) OVER w END AS ns FROM sims WHERE similarity IS NOT NULL
  WINDOW w AS (PARTITION BY source_id ORDER BY after_unit)""", "sims")
cte("flat", """SELECT source_id, pl, bf, bl, max(after_unit) AS stop, min(similarity) AS similarity, arg_min(coalesce(ps, -1), after_unit) AS ps, arg_max(coalesce(ns, -1), after_unit) AS ns,
  arg_min(coalesce(lp, -1), after_unit) AS lp, arg_max(coalesce(rp, -1), after_unit) AS rp FROM (
  SELECT *, max(CASE WHEN ps IS NULL OR ps <> similarity THEN after_unit END) OVER (PARTITION BY source_id ORDER BY after_unit) AS pl,
  last_value(CASE WHEN ps IS NULL OR ps < similarity THEN similarity END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY after_unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp,
  first_value(CASE WHEN ns IS NULL OR ns < similarity THEN similarity END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY after_unit ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rp
  FROM curve) GROUP BY ALL""", "curve")
cte("vals", """SELECT source_id, pl + (stop - pl) // 2 AS after_unit, bf, bl, similarity, lp AS left_peak, rp AS right_peak,
  round_even(((lp - similarity) + (rp - similarity)) / (lp + rp) * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS depth FROM flat WHERE ps > similarity AND ns > similarity""", "flat")
CUT_WALK = """pool AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY depth DESC, similarity, after_unit) AS rk FROM vals
  WHERE depth >= 0.15 AND after_unit - bf + 1 >= 2 AND bl - after_unit >= 2),
cut_walk AS (SELECT source_id, rk, after_unit, true AS ok, [after_unit] AS kept FROM pool WHERE rk = 1
  UNION ALL SELECT p.source_id, p.rk, p.after_unit, fine, CASE WHEN fine THEN list_append(kept, p.after_unit) ELSE kept END FROM cut_walk c
  JOIN pool p ON p.source_id = c.source_id AND p.rk = c.rk + 1, LATERAL (SELECT len(list_filter(c.kept, lambda k: abs(k - p.after_unit) < 2)) = 0 AS fine)),
tcuts AS (SELECT v.source_id, v.after_unit, similarity, left_peak, right_peak, depth, CASE WHEN depth < 0.15 THEN 'below_min_depth'
  WHEN NOT coalesce(w.ok, false) THEN 'min_segment_units_conflict' END AS reason FROM vals v LEFT JOIN cut_walk w ON w.source_id = v.source_id AND w.after_unit = v.after_unit)"""


def rec(names: str, extra: str, body: str) -> str:
    return with_(names, "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + extra + "\n" + body


@query("topic_similarity", with_("sims", "SELECT source_id, after_unit, gap_ms, hard, similarity FROM sims"))
def topic_similarity(spark, sf):
    return tw.boundary_similarity(tb.sentences(spark, sf), tx.LATIN, placed=True)


@query("topic_cuts", rec("vals", CUT_WALK, "SELECT * FROM tcuts"))
def topic_cuts(spark, sf):
    return tw.topic_cuts(tb.sentences(spark, sf), tx.LATIN, placed=True)


@query("topic_segments", rec("vals", CUT_WALK, """SELECT source_id, min(pos) AS first_unit, max(pos) AS last_unit, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
  CASE WHEN max(end_ms) - min(start_ms) < 15000 THEN 'below_min_seconds' WHEN max(end_ms) - min(start_ms) > 90000 THEN 'above_max_seconds' ELSE '' END AS reasons,
  max(end_ms) - min(start_ms) BETWEEN 15000 AND 90000 AS eligible FROM (
  SELECT s.*, (SELECT count(*) FROM (SELECT source_id, after_unit FROM tcuts WHERE reason IS NULL UNION SELECT source_id, after_unit FROM edges WHERE hard) c
  WHERE c.source_id = s.source_id AND c.after_unit < s.pos) AS seg FROM sentences s) GROUP BY source_id, seg"""))
def topic_segments(spark, sf):
    return tp.judged_segments(tw.topic_spans(tb.sentences(spark, sf), tx.LATIN, placed=True))


@query("guarded_topic_segments")
def guarded_topic_segments(spark, sf):
    from . import interval_queries as iq
    from ..operators import gaps as gp, sentences as sn
    units = dc.linked_units(sn.rule_sentences(spark, sf), block=None)
    spans = tw.topic_spans(units, tx.LATIN, guarded=True, linked="linked", placed=True)
    words = tb.words(spark, sf)
    found = gp.word_gaps(words, words.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")), block=None)
    speech = iq.detectors(spark, sf)
    audit = gp.coverage_audit(found, speech, ("vad", "gate"), block_ms=None)
    stop = gp.blocking_gaps(audit, speech, "gate", "vad")
    return tp.judged_segments(spans, blocking=stop, bounded=True)


def reps(spark, sf):
    c = tp.copies(tb.sentences(spark, sf), "pos", F.col("pos"), tx.LATIN, bounded=True)
    return c.where("pos = copy_of").select("source_id", "pos", "text")


SAFE = r"list_sort(regexp_extract_all(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\x00-\x7F]', 'x', 'g'), '\d+(?:\.\d+)?|\b(?:not|no|never|cannot)\b'))"
cte("forms", rf"SELECT source_id, pos, text, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^一-鿿a-z0-9]', '', 'g') AS form, {SAFE} AS guard FROM sentences", "sentences")


@query("text_copies", with_("forms", """SELECT source_id, pos, min(pos) OVER (PARTITION BY source_id, form, guard) AS copy_of,
  count(*) OVER (PARTITION BY source_id, form, guard) AS copies FROM forms"""))
def text_copies(spark, sf):
    return tp.copies(tb.sentences(spark, sf), "pos", F.col("pos"), tx.LATIN, bounded=True).select("source_id", "pos", "copy_of", "copies")


cte("rep", "SELECT source_id, min(pos) AS pos, arg_min(text, pos) AS text, form, guard FROM forms GROUP BY source_id, form, guard", "forms")
cte("rep_terms", f"""SELECT source_id, pos, term, count(*) AS n FROM (SELECT source_id, pos, unnest({TERMS}) AS term FROM rep)
  WHERE term NOT IN ('the', 'and', 'of', 'to', 'a', 'is') GROUP BY ALL""", "rep")
cte("rep_w", """SELECT t.source_id, pos, t.term, (1 + ln(n)) * idf AS w FROM rep_terms t JOIN (SELECT t.source_id, term, 1 + ln((1 + k) / (1 + count(*))::DOUBLE) AS idf FROM rep_terms t
  JOIN (SELECT source_id, count(*) AS k FROM rep GROUP BY 1) s ON s.source_id = t.source_id GROUP BY t.source_id, term, k) i ON i.source_id = t.source_id AND i.term = t.term""", "rep_terms")
cte("rep_n", "SELECT source_id, pos, sum(round_even(w * w * 1e10::DOUBLE, 0)::BIGINT)::BIGINT AS nn FROM rep_w GROUP BY 1, 2", "rep_w")
cte("rep_pairs", """SELECT d.source_id, a, b, round_even(least(1.0::DOUBLE, dot / (sqrt(x.nn) * sqrt(y.nn))) * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS similarity FROM (
  SELECT p.source_id, p.pos AS a, q.pos AS b, sum(round_even(p.w * q.w * 1e10::DOUBLE, 0)::BIGINT)::BIGINT AS dot FROM rep_w p JOIN rep_w q ON q.source_id = p.source_id AND q.term = p.term AND p.pos < q.pos
  GROUP BY ALL) d JOIN rep_n x ON x.source_id = d.source_id AND x.pos = a JOIN rep_n y ON y.source_id = d.source_id AND y.pos = b""", "rep_w", "rep_n")


@query("similar_pairs", with_("rep_pairs", "SELECT * FROM rep_pairs WHERE similarity >= 0.5"))
def similar_pairs(spark, sf):
    return tg.similar_pairs(reps(spark, sf), "pos", tx.LATIN, 0.5)


def topic_items(spark, sf):
    """All windows of every document that survive the overlap suppression, with their texts, in rank order."""
    from .quality_queries import every, kept_windows
    rows = every(spark, sf).select("source_id", "candidate", "rank", "score", "start_ms", "end_ms", "first_pos", "last_pos")
    chosen = kept_windows(rows).select("source_id", "rank", "first_pos", "last_pos")
    return tg.window_items(chosen, tb.sentences(spark, sf))


@query("near_duplicates")
def near_duplicates(spark, sf):
    return tg.near_duplicates(topic_items(spark, sf), "rank", tx.LATIN, placed=True)


@query("lexical_topics")
def lexical_topics(spark, sf):
    return tg.group_topics(topic_items(spark, sf), tx.LATIN, placed=True)


@query("topic_labels")
def topic_labels(spark, sf):
    return tg.topic_labels(topic_items(spark, sf), tx.LATIN, placed=True)


Q_TAIL = r"""rtrim(regexp_replace(trim(text), '[”’"''）)】\]」』]+$', ''))"""
Q_CLAUSE = rf"trim(regexp_replace(t, '(?s)^.*[。！？!?；;\n]', ''))"
cte("turn_q", rf"""SELECT *, CASE WHEN regexp_matches(t, '[?？]$') THEN 'question_mark'
  WHEN t = '' OR regexp_matches(t, '[。！？!?；;.]$') OR {Q_CLAUSE} = '' OR regexp_matches({Q_CLAUSE}, '(?i)(?:因为|答案是|原因是|所以答案|because\b|the answer is\b)') THEN NULL
  WHEN regexp_matches({Q_CLAUSE}, '(?i)^(?:why|how|what|when|where|who)\s+(?:is|are|was|were|do|does|did|can|could|would|will|should)\b') THEN 'unpunctuated_question_shape' END AS q,
  lead(pos) OVER (PARTITION BY source_id ORDER BY pos) AS nxt FROM (SELECT *, {Q_TAIL} AS t FROM marked_turns)""", "marked_turns")
cte("deps", r"""SELECT source_id, pos AS first_unit, nxt AS last_unit, 'question_response' AS kind, q AS rule FROM turn_q WHERE q IS NOT NULL
  UNION ALL SELECT source_id, pos, nxt, 'introduction_continuation', 'trailing_colon' FROM turn_q WHERE regexp_matches(t, '[:：]$')""", "turn_q")


@query("dependencies", with_("deps", "SELECT * FROM deps"))
def dependencies(spark, sf):
    return dc.dependencies(tb.marked_turns(spark, sf))


@query("sentence_units", with_("words", r"""SELECT source_id, unit, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(pos) AS last_word, string_agg(text, '' ORDER BY pos) AS text FROM (
  SELECT *, max(CASE WHEN reach IS NULL OR NOT (regexp_matches(trim(text), '^[”’"''）)】\]]+$') AND start_ms - reach <= 3000) THEN pos END) OVER (PARTITION BY source_id ORDER BY pos) AS unit FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words)) GROUP BY source_id, unit"""))
def sentence_units(spark, sf):
    from ..operators import sentences as sn
    return sn.token_units(tb.words(spark, sf), block=None)


@query("rule_sentences")
def rule_sentences(spark, sf):
    from ..operators import sentences as sn
    return sn.rule_sentences(spark, sf)


@query("split_audit")
def split_audit(spark, sf):
    """Every window of rule sentences with the forced splits at its edges, which its two end rows bring along."""
    from ..operators import selection as sl, sentences as sn, windows as wn
    s = sl.split_flags(sn.rule_sentences(spark, sf), block=None)
    units = wn.sentence_features(s, tx.LATIN, block_rows=None, keep=("bad_start", "bad_end"))
    w = wn.sentence_windows(units, bounded=True, first_only=("bad_start",), last_only=("bad_end",))
    return w.select("source_id", "first_pos", "last_pos", F.col("a_bad_start").alias("bad_start"), F.col("b_bad_end").alias("bad_end"))


cte("quote_marks", r"""SELECT *, CASE WHEN single AND blank OR mark IN ('”', '’', '」', '』') THEN NULL ELSE mark END AS opens, CASE mark WHEN '”' THEN '“' WHEN '’' THEN '‘' WHEN '」' THEN '「' WHEN '』' THEN '『' WHEN '"' THEN '"' WHEN '''' THEN '''' END AS mate,
  row_number() OVER (PARTITION BY source_id ORDER BY pos, i) AS rk FROM (SELECT source_id, pos, i, text[i] AS mark, text[i] IN ('''', '‘', '’') AND i > 1 AND regexp_matches(text[i - 1], '[A-Za-z0-9]') AS single,
    i = length(text) OR regexp_matches(text[i + 1], '\s') AS blank, i < length(text) AND regexp_matches(text[i + 1], '[A-Za-z0-9]') AS inner_ FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM marked_turns WHERE regexp_matches(text, '[“”‘’「」『』"'']'))
    WHERE text[i] IN ('“', '”', '‘', '’', '「', '」', '『', '』', '"', '''')) WHERE NOT (single AND inner_)""", "marked_turns")


cte("quote_steps", """SELECT source_id, 0::BIGINT AS rk, []::STRUCT(s VARCHAR, u BIGINT)[] AS stack, NULL::BIGINT AS first_unit, NULL::BIGINT AS last_unit, NULL::VARCHAR AS kind FROM (SELECT DISTINCT source_id FROM quote_marks)
  UNION ALL SELECT q.source_id, q.rk, CASE WHEN stack[-1].s = q.mate THEN stack[:-2] WHEN q.opens IS NOT NULL THEN list_append(stack, {'s': q.opens, 'u': q.pos}) ELSE stack END,
    CASE WHEN stack[-1].s = q.mate THEN stack[-1].u END, q.pos,
    CASE WHEN stack[-1].s = q.mate THEN CASE WHEN stack[-1].u <> q.pos THEN 'paired_quotation' END WHEN q.opens IS NULL AND NOT (single AND blank) THEN 'quotation_missing_opener' END
  FROM quote_steps t JOIN quote_marks q ON q.source_id = t.source_id AND q.rk = t.rk + 1""", "quote_marks", recursive=True)
cte("quoted", """SELECT source_id, first_unit, last_unit, kind FROM quote_steps WHERE kind IS NOT NULL
  UNION ALL SELECT source_id, x.u, NULL, 'quotation_missing_closer' FROM (SELECT source_id, unnest(stack) AS x FROM (SELECT *, max(rk) OVER (PARTITION BY source_id) AS top FROM quote_steps) WHERE rk = top)""", "quote_steps")


@query("quotations", with_("quoted", "SELECT * FROM quoted"))
def quotations(spark, sf):
    return dc.quotations(tb.marked_turns(spark, sf))


E_ = r"[。！？!?；;.,， \t\r\n]+"


def _bare(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{E_}', ''), '{E_}$', '')"


def _solid(x: str, single: bool = False) -> str:
    c = rf"regexp_replace({_bare(x)}, '[^\p{{L}}\p{{N}}_]', '', 'g')"
    one = rf" OR (regexp_matches({c}, '^[\x{{3400}}-\x{{9fff}}]$') AND NOT regexp_matches({c}, '[{ct.PARTICLES}]'))" if single else ""
    return f"((length({c}) >= 2{one}) AND NOT regexp_matches({_bare(x)}, '{ct.FILLER}') AND NOT regexp_matches({_bare(x)}, '{ct.META}'))"


def _goes(p: str, body: bool = False, also: str = "") -> str:
    group = f"regexp_extract(head, '{p}', 1)"
    rest = f" AND {_solid(group, True)}" if body else ""
    return f"(regexp_matches(head, '{p}'){also} AND {_solid('head')} AND NOT regexp_matches(head, '{ct.META}') AND NOT regexp_matches(head, '{ct.AGREEING_HEAD}'){rest})"


cte("du", f"""SELECT source_id, pos, k, p || CASE b WHEN 'short' THEN regexp_extract(text, '^[A-Za-z]+(?: [A-Za-z]+)?') WHEN 'text' THEN text WHEN 'x300' THEN repeat('x', 300) ELSE '' END || q AS text
  FROM (SELECT *, (source_id * 7 + pos) % {len(tb.DISCOURSE)} AS k FROM turns) JOIN (VALUES {', '.join(f"({i}, '{p}', '{b}', '{q}')" for i, (p, b, q) in enumerate(tb.DISCOURSE))}) v(i, p, b, q) ON i = k""", "turns")
cte("du_mask", r"""SELECT *, CASE WHEN k = 21 OR (k = 22 AND lag(k) OVER w = 21) THEN regexp_replace(text, '[^\n]', ' ', 'g') WHEN k = 22 THEN replace(text, '”', ' ') ELSE text END AS m
  FROM du WINDOW w AS (PARTITION BY source_id ORDER BY pos)""", "du")
cte("du_cut", rf"""SELECT *, regexp_extract(body, '(?s)^(.*[。！？!?；;\n])', 1) AS prefix FROM (SELECT *, regexp_replace(m, '{E_}$', '') AS body,
  left(regexp_replace(lead(m) OVER w, '^\s+', ''), 256) AS head, lead(pos) OVER w AS nxt, lag(regexp_matches(text, '[?？]$')) OVER w AS asked, lag(regexp_matches(m, '哪(?:个|一)?(?:方面|领域|范围|方向|部分)')) OVER w AS ranged
  FROM du_mask WINDOW w AS (PARTITION BY source_id ORDER BY pos))""", "du_mask")
cte("du_clause", r"""SELECT *, regexp_replace(substr(body, length(prefix) + 1), '^\s+', '') AS clause, nxt IS NOT NULL AND NOT regexp_matches(head, '(?i)^(?:(?:好(?:的)?|那么|那|接着|所以|因此|因而|于是)[，,\s]*)?(?:(?:我们|你们|他们|她们|大家|我|你|您|他|她)(?:(?:就|先|现在|会|想|要|准备|打算)){0,3}[，,\s]*)?(?:下面|接下来|另一个话题|至于)') AS onward FROM du_cut""", "du_cut")
cte("du_read", rf"""SELECT *, length(clause) > 256 AS clipped, clause <> '' AND length(clause) <= 256 AS parsed, regexp_extract(clause, '{ct.INTENT}', 1) AS target, regexp_extract(clause, '(?s)^(.*?)(?:{ct.INTENT})', 1) AS led,
  regexp_extract(clause, '{ct.CAUSE}', 1) AS because, regexp_matches(clause, '^(?:下面|接下来)') AS topic FROM du_clause""", "du_clause")
cte("du_flag", rf"""SELECT *, parsed AND regexp_matches(clause, '{ct.INTENT}') AND NOT regexp_matches(target, '(?:但|不过|后来|而)[^。！？!?；;\n]{{0,24}}(?:已经|早已|都|也)?(?:查清|知道|明白|弄清|了解|解决)|答案是|原因是|因为') AND NOT regexp_matches(led, '{ct.NEGATED_INTENT}') AND {_solid('target', True)} AS intent,
  coalesce(onward AND {_goes(ct.REASON, True)}, false) AS reasoned, parsed AND regexp_matches(clause, '{ct.CAUSE}') AND regexp_matches(prefix, '[?？]$') AS explained,
  regexp_matches(head, '{ct.CONTRAST_REASON}') AS contrast, coalesce(parsed AND onward AND NOT regexp_matches(head, '[?？]') AND ({_goes(ct.CONTRAST_REASON, True)} OR {_goes(ct.ENUMERATED_REASON, True)}), false) AS more,
  parsed AND because <> '' AND {_solid('because', True)} AND NOT regexp_matches(because, '{ct.INLINE_RESULT}') AND NOT regexp_matches(m, '[。！？!?；;.]\s*$') AND NOT regexp_matches(because, '{ct.META}') AS pending,
  coalesce(onward AND {_goes(ct.RESULT, True)}, false) AS resulting, CASE WHEN NOT parsed THEN NULL WHEN regexp_matches(clause, '{ct.ASPECT}') THEN 'predicate_complement'
  WHEN regexp_matches(clause, '{ct.DEFINITION}') AND NOT regexp_matches(regexp_extract(clause, '{ct.DEFINITION}', 1), '{ct.FINITE_HEAD}') THEN 'definition_continuation'
  WHEN regexp_matches(clause, '就是$') AND {_solid("regexp_replace(clause, '就是$', '')")} THEN 'copular_continuation' WHEN regexp_matches(clause, '反而$') AND {_solid("regexp_replace(clause, '反而$', '')")} THEN 'contrast_continuation' END AS slot
  FROM du_read""", "du_read")
NO_DEFINITION = " AND NOT regexp_matches(head, '^是(?:的|啊|呀|吧|吗|新话题|另一个话题)(?:[。！？!?；;，,]|$)')"
cte("du_fill", rf"""SELECT *, coalesce(onward AND CASE slot WHEN 'predicate_complement' THEN {_goes(ct.PREDICATE)} WHEN 'definition_continuation' THEN {_goes('^是(.+)$', True, NO_DEFINITION)}
  WHEN 'copular_continuation' THEN {_goes('^')} WHEN 'contrast_continuation' THEN {_goes(ct.CONTRAST_HEAD)} END, false) AS filled,
  slot = 'definition_continuation' OR (slot = 'predicate_complement' AND coalesce(asked AND ranged, false) AND regexp_matches(m, '[。！？!?；;.]\s*$')) AS alone,
  coalesce(asked, false) OR coalesce(lag(intent AND reasoned) OVER w, false) AS seed, row_number() OVER w AS rk FROM du_flag WINDOW w AS (PARTITION BY source_id ORDER BY pos)""", "du_flag")


@query("continuity", with_("du_fill", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
run AS (SELECT source_id, rk, explained OR (seed AND NOT topic) AS on_ FROM du_fill WHERE rk = 1
  UNION ALL SELECT f.source_id, f.rk, f.explained OR ((f.seed OR coalesce(CASE WHEN r.on_ THEN p.more OR p.filled ELSE p.pending AND p.resulting END, false)) AND NOT f.topic)
  FROM run r JOIN du_fill p ON p.source_id = r.source_id AND p.rk = r.rk JOIN du_fill f ON f.source_id = r.source_id AND f.rk = r.rk + 1),
fits AS (SELECT f.*, r.on_ FROM du_fill f JOIN run r ON r.source_id = f.source_id AND r.rk = f.rk)
SELECT source_id, pos AS first_unit, CASE WHEN status = 'link' THEN nxt END AS last_unit, kind, status FROM (
  SELECT source_id, pos, nxt, 'long_clause_not_parsed' AS kind, 'ambiguity' AS status FROM fits WHERE clipped
  UNION ALL SELECT source_id, pos, nxt, 'implicit_question_reason', CASE WHEN reasoned THEN 'link' WHEN nxt IS NULL THEN 'open_edge' ELSE 'ambiguity' END FROM fits WHERE intent
  UNION ALL SELECT source_id, pos, nxt, CASE WHEN contrast THEN 'contrast_cause_continuation' ELSE 'reason_enumeration' END, 'link' FROM fits WHERE on_ AND more
  UNION ALL SELECT source_id, pos, nxt, 'cause_result', CASE WHEN resulting THEN 'link' ELSE 'ambiguity' END FROM fits WHERE NOT on_ AND pending
  UNION ALL SELECT source_id, pos, nxt, slot, CASE WHEN filled THEN 'link' WHEN alone THEN 'ambiguity' ELSE 'open_edge' END FROM fits WHERE slot IS NOT NULL)""")
def continuity(spark, sf):
    return ct.continuity(tb.discourse_turns(spark, sf))


# Cuts behind every third turn, without those inside a dependency or quotation; pauses behind every seventh.
cte("event_links", """SELECT source_id, first_unit, last_unit, kind FROM deps UNION ALL SELECT source_id, first_unit, last_unit, kind FROM quoted""", "deps", "quoted")
cte("event_cuts", """SELECT source_id, pos AS after_unit, pos % 7 = 6 AS hard FROM turns t WHERE (pos % 3 = 2 OR pos % 7 = 6) AND pos < (SELECT max(pos) FROM turns e WHERE e.source_id = t.source_id)
  AND (pos % 7 = 6 OR NOT EXISTS (SELECT 1 FROM event_links l WHERE l.source_id = t.source_id AND l.first_unit <= pos AND pos < l.last_unit))""", "turns", "event_links")
cte("event_loose", """SELECT l.source_id, l.first_unit AS f, l.last_unit AS l FROM event_links l WHERE first_unit IS NOT NULL AND last_unit IS NOT NULL AND EXISTS (SELECT 1 FROM event_cuts c WHERE c.source_id = l.source_id AND hard AND l.first_unit <= after_unit AND after_unit < l.last_unit)
  UNION ALL SELECT l.source_id, CASE WHEN kind = 'quotation_missing_opener' THEN low ELSE coalesce(first_unit, last_unit) END, CASE WHEN kind = 'quotation_missing_closer' THEN high ELSE coalesce(first_unit, last_unit) END
  FROM event_links l JOIN (SELECT source_id, min(pos) AS low, max(pos) AS high FROM turns GROUP BY 1) e ON e.source_id = l.source_id WHERE first_unit IS NULL OR last_unit IS NULL""", "event_cuts")


@query("event_segments", with_("event_loose", """SELECT *, reasons = '' AS eligible FROM (SELECT source_id, first_unit, last_unit, start_ms, end_ms, array_to_string(list_filter([CASE WHEN end_ms - start_ms < 15000 THEN 'below_min_seconds' END, CASE WHEN end_ms - start_ms > 90000 THEN 'above_max_seconds' END,
  CASE WHEN EXISTS (SELECT 1 FROM event_loose o WHERE o.source_id = g.source_id AND f <= last_unit AND first_unit <= l) THEN 'unresolved_event_dependency' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM (SELECT source_id, min(pos) AS first_unit, max(pos) AS last_unit, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT t.*, (SELECT count(*) FROM event_cuts c WHERE c.source_id = t.source_id AND c.after_unit < t.pos) AS seg FROM turns t) GROUP BY source_id, seg) g)"""))
def event_segments(spark, sf):
    from ..operators import scan as sc, strategies as st
    u = tb.marked_turns(spark, sf)
    links, edges = st.event_evidence(u, continuous=False)
    edge = sc.scan(u.select("source_id", "pos"), ["source_id"], ["pos"], sc.by_rows("pos"), _next=sc.following(F.col("pos"))).where("_next IS NOT NULL")
    b = edge.select("source_id", F.col("pos").alias("after_unit"), (F.col("pos") % 7 == 6).alias("hard"), F.lit(3500).alias("gap_ms"))
    cuts = tp.drop_crossed(b.where("after_unit % 3 = 2").select("source_id", "after_unit", F.lit(None).cast("string").alias("reason")), links)
    return tp.topic_segments(cuts, b, u, unresolved=tp.unresolved_spans(links, edges, b, u))


cte("chain", """SELECT source_id, min(f) AS first_unit, max(l) AS last_unit, sum(n)::BIGINT AS members, CASE WHEN bool_or(o) THEN 'unresolved_surface_dependency'
  ELSE 'no_further_surface_dependency_detected' END AS closure FROM (SELECT *, sum(CASE WHEN r IS NULL OR f > r THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY f, l) AS g FROM (
  SELECT *, max(l) OVER (PARTITION BY source_id ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (
  SELECT source_id, first_unit AS f, coalesce(last_unit, first_unit) AS l, count(*) AS n, bool_or(last_unit IS NULL) AS o FROM deps GROUP BY 1, 2, 3))) GROUP BY source_id, g""", "deps")


@query("obligation_chains", with_("chain", "SELECT * FROM chain"))
def obligation_chains(spark, sf):
    return dc.obligation_chains(dc.dependencies(tb.marked_turns(spark, sf)))


# Response relations: every user turn asks, the next turn replies.
cte("resp_rel", """SELECT source_id, pos AS relation, pos AS ask_unit, pos + 1 AS reply_unit, pos + 1 AS reply_end FROM turns t WHERE role = 'user'
  AND EXISTS (SELECT 1 FROM turns n WHERE n.source_id = t.source_id AND n.pos = t.pos + 1)""", "turns")
cte("barriers", """SELECT source_id, pos, bool_or(must) AS must FROM (SELECT source_id, ask_unit AS pos, false AS must FROM resp_rel
  UNION ALL SELECT source_id, pos + 1, true FROM turns WHERE pos % 7 = 6
  UNION ALL SELECT source_id, pos, false FROM turns WHERE regexp_matches(trim(text), '(?i)^(?:(?:so\\b|therefore\\b)[，,\\s]*)?(?:next\\s+(?:topic|subject)\\b|moving\\s+on\\b)')) GROUP BY 1, 2""", "resp_rel")
cte("responses", """SELECT r.source_id, relation, ask_unit AS first_unit, reply_unit, coalesce(b.pos - 1, e.e) AS last_unit,
  CASE WHEN b.pos IS NULL THEN 'unresolved_source_end' WHEN b.must THEN 'interrupted_by_required_boundary' ELSE 'next_structural_turn_cue' END AS endpoint,
  b.pos <= reply_end AS crosses_barrier FROM resp_rel r JOIN (SELECT source_id, max(pos) AS e FROM turns GROUP BY 1) e ON e.source_id = r.source_id
  LEFT JOIN LATERAL (SELECT pos, must FROM barriers b WHERE b.source_id = r.source_id AND b.pos > r.ask_unit AND b.pos <= (SELECT max(pos) FROM turns t WHERE t.source_id = b.source_id)
  ORDER BY pos LIMIT 1) b ON true""", "barriers")


def response_relations(spark, sf):
    from ..operators import scan as sc
    t = sc.scan(tb.turns(spark, sf), ["source_id"], ["pos"], sc.by_rows("pos"), nxt=sc.following(F.col("pos")))
    return t.where("role = 'user' AND nxt = pos + 1").select(
        "source_id", F.col("pos").alias("relation"), F.col("pos").alias("ask_unit"), (F.col("pos") + 1).alias("reply_unit"), (F.col("pos") + 1).alias("reply_end"))


def responses(spark, sf):
    t = tb.turns(spark, sf)
    required = t.where("pos % 7 = 6").select("source_id", F.col("pos").alias("after_unit"))
    return dc.response_ranges(t, response_relations(spark, sf), required)


@query("response_ranges", with_("responses", "SELECT * FROM responses"))
def response_ranges(spark, sf):
    return responses(spark, sf)


cte("turn_events", "SELECT source_id, pos // 4 AS event, min(pos) AS first_unit, max(pos) AS last_unit FROM turns GROUP BY 1, 2", "turns")


@query("response_candidates", with_("responses turn_events", """SELECT e.source_id, e.event, e.first_unit, e.last_unit, a.start_ms, b.end_ms, array_to_string(list_filter([
  CASE WHEN n IS NULL THEN 'event_has_no_declared_relation_support' END, CASE WHEN c > 0 THEN 'response_interrupted_by_required_boundary' END,
  CASE WHEN b.end_ms - a.start_ms < 15000 THEN 'whole_event_below_minimum_duration' END, CASE WHEN b.end_ms - a.start_ms > 90000 THEN 'whole_event_exceeds_maximum_duration' END,
  CASE WHEN gapped THEN 'whole_event_gap_exceeds_candidate_contract' END], lambda x: x IS NOT NULL), ',') AS reasons,
  n IS NOT NULL AND coalesce(c, 0) = 0 AND b.end_ms - a.start_ms BETWEEN 15000 AND 90000 AND NOT gapped AS eligible
  FROM turn_events e JOIN turns a ON a.source_id = e.source_id AND a.pos = first_unit JOIN turns b ON b.source_id = e.source_id AND b.pos = last_unit
  JOIN (SELECT e.source_id, e.event, coalesce(bool_or(t.pos % 7 = 6 AND t.pos < e.last_unit), false) AS gapped FROM turn_events e JOIN turns t ON t.source_id = e.source_id AND t.pos BETWEEN e.first_unit AND e.last_unit GROUP BY 1, 2) g
  ON g.source_id = e.source_id AND g.event = e.event LEFT JOIN (SELECT e.source_id, e.event, count(*) AS n, count(*) FILTER (endpoint = 'interrupted_by_required_boundary') AS c FROM turn_events e JOIN responses r
  ON r.source_id = e.source_id AND e.first_unit <= r.first_unit AND r.last_unit <= e.last_unit GROUP BY 1, 2) s ON s.source_id = e.source_id AND s.event = e.event"""))
def response_candidates(spark, sf):
    t = tb.turns(spark, sf)
    events = t.groupBy("source_id", F.floor(F.col("pos") / 4).alias("event")).agg(F.min("pos").alias("first_unit"), F.max("pos").alias("last_unit"))
    return dc.response_candidates(events, responses(spark, sf), t)
