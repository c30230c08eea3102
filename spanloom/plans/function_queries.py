"""Queries of scalar functions, sources, paging, set operations and review events."""

from pyspark.sql import functions as F

from ..functions import anchors as an, text as tx, times as tm
from ..operators import choices as ch, discourse as dc, editing as ed, evaluation as ev, quality as ql, scan as sc, windows as wn
from ..sources import documents as sd, outputs as so
from ..streaming import reviews as rv
from ..session import table
from . import tables as tb
from .catalog import query
from .oracle import cte, with_

KEY = ["source_id"]


@query("text_measures", with_("sentences", r"""SELECT source_id, pos, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS units, len(regexp_extract_all(lower(text), 'and|for|the')) AS hits,
  regexp_matches(text, '(?i)\?|^(?:why|how|what|when|where|who)\s') AS asks, regexp_matches(text, '(?i)because|so|the|and') AS answers,
  regexp_replace(replace(lower(text), 'ß', 'ss'), '[^一-鿿a-z0-9]', '', 'g') AS compact, length(text) AS columns, regexp_matches(rtrim(text), '[。！？!?；;.][”’"''）)】\]]*$') AS terminal FROM sentences"""))
def text_measures(spark, sf):
    t = F.col("text")
    return tb.sentences(spark, sf).select(
        "source_id", "pos", tx.text_units(t).alias("units"), F.size(tx.keyword_hits(t, tx.LATIN.keywords)).cast("bigint").alias("hits"),
        tx.is_question(t, tx.LATIN).alias("asks"), tx.is_answer(t, tx.LATIN).alias("answers"), tx.compact(t).alias("compact"),
        tx.display_columns(t).alias("columns"), tx.ends_terminal(t).alias("terminal"))


# Openings in compatibility forms, and what folding makes of them.
FOLDED = (("ＡＢＣ１２ Ｎｏｔ ", "abc12 not "), ("ﬁne oﬀ ", "fine off "), ("İstanbul ℌ ", "i\u0307stanbul h "), ("Straße ² ", "strasse 2 "), ("", ""))


@query("folded_texts", f"""SELECT doc_id, regexp_replace(f, '[^一-鿿a-z0-9]', '', 'g') AS compact, array_to_string(regexp_extract_all(f, '[一-鿿]+|[a-z]+|\\d+(?:\\.\\d+)?')[:3], ' ') AS terms FROM (
  SELECT doc_id, p || replace(lower(text), 'ß', 'ss') AS f FROM documents JOIN (VALUES {', '.join(f"({i}, '{x}')" for i, (_, x) in enumerate(FOLDED))}) v(i, p) ON i = doc_id % {len(FOLDED)})""")
def folded_texts(spark, sf):
    opening = F.get(F.array(*[F.lit(x) for x, _ in FOLDED]), F.pmod("doc_id", F.lit(len(FOLDED))).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.concat(opening, "text").alias("text"))
    whole = tx.Lexicon(**{**tx.LATIN.__dict__, "stop": ("",)})
    return d.select("doc_id", tx.compact(F.col("text")).alias("compact"), F.array_join(F.slice(tx.terms(F.col("text"), whole), 1, 3), " ").alias("terms"))


@query("text_terms", with_("sentences", r"""SELECT source_id, pos, array_to_string(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[一-鿿]+|[a-z]+|\d+(?:\.\d+)?'), lambda t: t NOT IN ('the', 'and', 'of', 'to', 'a', 'is')), ' ') AS terms,
  array_to_string(list_sort(regexp_extract_all(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\x00-\x7F]', 'x', 'g'), '\d+(?:\.\d+)?|\b(?:not|no|never|cannot)\b')), ' ') AS guards FROM sentences"""))
def text_terms(spark, sf):
    t = F.col("text")
    return tb.sentences(spark, sf).select("source_id", "pos", F.array_join(tx.terms(t, tx.LATIN), " ").alias("terms"),
                                          F.array_join(tx.safeguards(t, tx.LATIN), " ").alias("guards"))


@query("keyword_density", with_("sentences", r"""SELECT source_id, pos, CASE WHEN u > 0 THEN 3 * h / u::DOUBLE ELSE 0.0::DOUBLE END AS density, least(1.0::DOUBLE, abs(end_ms - start_ms - 30000) / 30000.0::DOUBLE) AS duration_penalty FROM (SELECT *,
  length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS u, len(regexp_extract_all(lower(text), 'and|for|the')) AS h FROM sentences)"""))
def keyword_density(spark, sf):
    t = F.col("text")
    u = tx.text_units(t)
    covered = tx.text_units(F.array_join(tx.keyword_hits(t, tx.LATIN.keywords), ""))
    d = F.col("end_ms") - F.col("start_ms")
    return tb.sentences(spark, sf).select("source_id", "pos", F.when(u > 0, covered / u).otherwise(F.lit(0.0)).alias("density"),
                                          F.least(F.lit(1.0), F.abs(d - 30000) / F.lit(30000.0)).alias("duration_penalty"))


@query("frame_times", with_("words", """SELECT source_id, pos, (2 * start_ms * 30000 + 1001000) // 2002000 AS half_up, start_ms * 30 // 1000 AS outward_in, (end_ms * 30 + 999) // 1000 AS outward_out,
  printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS srt,
  printf('%d:%02d:%02d.%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms // 10 % 100) AS ass,
  printf('%02d:%02d:%02d:%02d', f // 108000, f // 1800 % 60, f // 30 % 60, f % 30) AS code, f AS back FROM (SELECT *, start_ms * 30 // 1000 AS f FROM words)"""))
def frame_times(spark, sf):
    s, e = F.col("start_ms"), F.col("end_ms")
    # The code is a column first, or each of its parts would be read from a code made anew.
    words = tb.words(spark, sf).withColumn("code", tm.timecode(tm.frame_floor(s)))
    return words.select("source_id", "pos", tm.frame_half_up(s, 30000, 1001).alias("half_up"), tm.frame_floor(s).alias("outward_in"),
                                      tm.frame_ceil(e).alias("outward_out"), tm.clock(s, 1000).alias("srt"), tm.clock(tm.div(s, 10), 100).alias("ass"),
                                      "code", tm.timecode_frame(F.col("code")).alias("back"))


@query("content_hashes", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS hash FROM documents""")
def content_hashes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", so.fingerprint(F.col("doc_id"), F.col("lang"), F.col("n_chars")).alias("hash"))


@query("number_parsing", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 0 THEN value END AS number, CASE WHEN event_id % 4 < 2 AND event_id > 0 THEN event_id END AS num,
  (CASE WHEN event_id % 4 = 0 AND event_id > 0 THEN 1001 WHEN event_id % 4 = 1 THEN 1 END)::BIGINT AS den FROM events""")
def number_parsing(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    raw = F.when(i % 7 == 0, "N/A").otherwise(F.col("value").cast("string"))
    frac = F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit("/1001"))).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, F.concat(i.cast("string"), F.lit("/0"))).otherwise("x/y")
    num, den = sd.rational(frac)
    return e.select("event_id", sd.positive(raw).alias("number"), num.alias("num"), den.alias("den"))


@query("clean_notes", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE event_type END AS note FROM events""")
def clean_notes(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "   ").when(i % 5 == 1, F.concat("event_type", F.lit("\u0007"))).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return table(spark, sf, "events").select("event_id", tx.clean_note(raw, 40).alias("note"))


@query("literal_escapes", r"""SELECT page_id, replace(replace(html, '<', '＜'), '>', '＞') AS srt, replace(replace(replace(replace(html, '\', '＼'), '{', '｛'), '}', '｝'), chr(10), '\N') AS ass FROM pages""")
def literal_escapes(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", tx.escape_srt(h).alias("srt"), tx.escape_ass(h).alias("ass"))


@query("topic_transitions", with_("marked_turns", r"""SELECT source_id, pos, regexp_matches(trim(text), '(?i)^(?:(?:so\b|therefore\b)[，,\s]*)?(?:next\s+(?:topic|subject)\b|moving\s+on\b)') AS switch,
  regexp_matches(regexp_replace(text, '\s', '', 'g'), '^(?:So|Because|So)') AS dependent FROM marked_turns"""))
def topic_transitions(spark, sf):
    return tb.marked_turns(spark, sf).select("source_id", "pos", dc.topic_transition(F.col("text")).alias("switch"),
                                             an.opens_dependent(F.col("text"), "^(?:So|Because|So)").alias("dependent"))


# Cue phrases for Latin-script text.
PHRASES = (("question_prompt", "what"), ("question_prompt", "how"), ("turn", "the and"), ("turn", "and the"), ("turn", "for the and"), ("turn", "and the for"))
cte("plain_words", r"SELECT source_id, pos, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS w FROM words", "words")
cte("cue_hits", """SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS rk FROM (SELECT source_id, pos, CASE WHEN w1 IN ('what', 'how') THEN 'question_prompt' ELSE 'turn' END AS kind,
  CASE WHEN w1 = 'for' THEN 'for the and' WHEN w1 = 'and' AND w3 = 'for' THEN 'and the for' WHEN w1 IN ('what', 'how') THEN w1 ELSE w1 || ' ' || w2 END AS quote, pos + CASE WHEN w1 IN ('what', 'how') THEN 0 WHEN w1 = 'for' OR (w1 = 'and' AND w3 = 'for') THEN 2 ELSE 1 END AS last FROM (
  SELECT source_id, pos, w AS w1, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM plain_words WINDOW x AS (PARTITION BY source_id ORDER BY pos))
  WHERE w1 IN ('what', 'how') OR (w1 = 'the' AND w2 = 'and') OR (w1 = 'and' AND w2 = 'the') OR (w1 = 'for' AND w2 = 'the' AND w3 = 'and'))""", "plain_words")


@query("discourse_anchors", with_("cue_hits", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
walk AS (SELECT source_id, rk, pos, kind, quote, last, last AS until, true AS ok FROM cue_hits WHERE rk = 1 UNION ALL SELECT h.source_id, h.rk, h.pos, h.kind, h.quote, h.last,
  CASE WHEN h.pos > w.until THEN h.last ELSE w.until END, h.pos > w.until FROM walk w JOIN cue_hits h ON h.source_id = w.source_id AND h.rk = w.rk + 1)
SELECT source_id, pos, kind, quote, last FROM walk WHERE ok""")
def discourse_anchors(spark, sf):
    return an.discourse_anchors(tb.words(spark, sf), PHRASES)


# Sources.
@query("strict_json", """SELECT event_id, raw, reject, CASE WHEN reject IS NULL THEN k END AS k FROM (SELECT event_id, CASE event_id % 6 WHEN 1 THEN '{"k": 1, "k": 2}' WHEN 2 THEN '{"k": NaN}' WHEN 3 THEN '{"k": ' WHEN 4 THEN '[1]' ELSE props END AS raw,
  CASE event_id % 6 WHEN 1 THEN 'duplicate_keys' WHEN 2 THEN 'non_finite_number' WHEN 3 THEN 'malformed' WHEN 4 THEN 'not_an_object' END AS reject, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def strict_json(spark, sf):
    i = F.col("event_id") % 6
    raw = F.when(i == 1, '{"k": 1, "k": 2}').when(i == 2, '{"k": NaN}').when(i == 3, '{"k": ').when(i == 4, "[1]").otherwise(F.col("props"))
    return sd.strict_json(table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw", "k bigint")


@query("page_rejects", "SELECT page_id, 'not_an_object' AS reject FROM pages")
def page_rejects(spark, sf):
    return sd.strict_json(table(spark, sf, "pages").select("page_id", "html"), "html", "k bigint").select("page_id", "reject")


@query("analysis_tables", with_("words", """SELECT source_id, pos, text, start_ms, end_ms FROM words"""))
def analysis_tables(spark, sf):
    w = F.struct(F.format_string("w%06d", F.col("pos")).alias("id"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"),
                 F.col("text").alias("text"), F.lit(None).cast("double").alias("probability"))
    # One document is one analysis object, as it is one row of the input.
    packed = tb.words(spark, sf).groupBy("source_id").agg(F.array_sort(F.collect_list(w)).alias("words"))
    raw = packed.select(F.to_json(F.struct(F.lit("0.1.0").alias("schema_version"), F.struct(F.col("source_id").cast("string").alias("normalized_sha256")).alias("media"), "words")).alias("j"))
    docs = raw.select(F.from_json("j", sd.ANALYSIS_SCHEMA).alias("d")).select("d.*")
    return sd.explode_analysis(docs)["words"].select(F.col("source_id").cast("bigint").alias("source_id"), "pos", "text", "start_ms", "end_ms")


@query("combined_analysers", """SELECT sha256(user_id::VARCHAR) AS normalized_sha256, CASE WHEN user_id % 5 = 0 THEN 'missing_speech' WHEN user_id % 4 = 0 THEN 'duration_ms' WHEN user_id % 3 = 0 THEN 'fps' ELSE '' END AS mismatch FROM (SELECT DISTINCT user_id FROM events)""")
def combined_analysers(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    i = F.col("user_id")
    base = u.select(F.sha2(i.cast("string"), 256).alias("normalized_sha256"), "user_id", F.to_json(F.struct("n")).alias("payload"), F.lit("normalized_video").alias("time_reference"),
                    (F.col("n") * 1000).alias("duration_ms"), (F.col("n") * 30).alias("total_frames"), F.lit(30).alias("fps"))
    speech = base.where("user_id % 5 > 0")
    words = base.withColumn("duration_ms", F.col("duration_ms") + (i % 4 == 0).cast("int")).withColumn("fps", F.when((i % 3 == 0) & (i % 4 > 0), 25).otherwise(30))
    return sd.combine_analysers(base, speech, words).select("normalized_sha256", "mismatch")


@query("probe_metadata", """SELECT * REPLACE (video_index::BIGINT AS video_index, width::BIGINT AS width, height::BIGINT AS height, fps_num::BIGINT AS fps_num, fps_den::BIGINT AS fps_den, audio_index::BIGINT AS audio_index, sample_rate::BIGINT AS sample_rate) FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 AND value > 0 THEN value END AS duration_seconds, 'mp4' AS container_format, CASE WHEN event_id % 9 > 0 THEN 1 END AS video_index, CASE WHEN event_id % 9 > 0 THEN 'h264' END AS video_codec,
  CASE WHEN event_id % 9 > 0 AND event_id % 2 = 0 THEN 1920 END AS width, CASE WHEN event_id % 9 > 0 THEN 1080 END AS height, CASE WHEN event_id % 9 > 0 AND event_id % 5 > 0 THEN 30000 END AS fps_num, CASE WHEN event_id % 9 > 0 AND event_id % 5 > 0 THEN 1001 END AS fps_den,
  2 AS audio_index, CASE WHEN event_id % 4 > 0 THEN 48000 END AS sample_rate, CASE WHEN event_id % 9 = 0 THEN 'no_video_stream' END AS reject FROM events)""")
def probe_metadata(spark, sf):
    i = F.col("event_id")
    pick = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    raw = F.concat(
        F.lit('{"streams": [{"index": 0, "codec_type": "video", "codec_name": "mjpeg", "disposition": {"attached_pic": 1}},'),
        F.when(i % 9 > 0, F.concat(F.lit('{"index": 1, "codec_type": "video", "codec_name": "h264", "width": "'), pick(i % 2 == 0, "1920", "N/A"),
                                   F.lit('", "height": "1080", "avg_frame_rate": "'), pick(i % 5 > 0, "30000/1001", "0/0"), F.lit('"},'))).otherwise(F.lit("")),
        F.lit('{"index": 2, "codec_type": "audio", "codec_name": "aac", "sample_rate": "'), pick(i % 4 > 0, "48000", "-1"),
        F.lit('"}], "format": {"format_name": "mp4", "duration": "'), F.when(i % 3 > 0, F.col("value").cast("string")).otherwise("N/A"), F.lit('"}}'))
    return sd.normalize_probe(table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw")


@query("reuse_by_fingerprint", """SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'reused' ELSE 'to_process' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def reuse_by_fingerprint(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", so.fingerprint(F.col("doc_id"), F.col("n_chars"), F.lit("v1")).alias("fingerprint"))
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    done = l.select(so.fingerprint(F.col("doc_id"), F.col("n_chars"), F.lit("v1")).alias("fingerprint"), F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"), F.col("toxic").alias("result"))
    new, old = so.split_by_reuse(d, done)
    return new.select("doc_id", F.lit("to_process").alias("state")).unionByName(old.select("doc_id", F.lit("reused").alias("state")))


@query("history_page", """SELECT event_id AS id, user_id AS task, (SELECT count(*) FROM events WHERE event_type = 'error') AS unavailable_count,
  (SELECT count(*) > 60 FROM events WHERE event_type <> 'error') AS more, (row_number() OVER (ORDER BY ts DESC, event_id DESC) - 40)::INTEGER AS place FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40""")
def history_page(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task"), F.col("ts").alias("instant"), (F.col("event_type") != "error").alias("readable"))
    return so.history_page(e, limit=20, offset=40).select("id", "task", "unavailable_count", "more", "place")


@query("longest_gaps", with_("plain_gaps", """SELECT source_id, gap_start, gap_end FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY gap_end - gap_start DESC, gap_start) AS r FROM plain_gaps) WHERE r <= 2"""))
def longest_gaps(spark, sf):
    from pyspark.sql import Window
    from ..operators import gaps as gp
    w = tb.words(spark, sf)
    g = gp.word_gaps(w, w.groupBy("source_id").agg(F.max("end_ms").alias("duration_ms")), block=None)
    order = Window.partitionBy("source_id").orderBy(F.desc(F.col("gap_end") - F.col("gap_start")), "gap_start")
    return g.withColumn("r", F.row_number().over(order)).where("r <= 2").select("source_id", "gap_start", "gap_end")


@query("unknown_ids", """SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents WHERE n_chars > 500""")
def unknown_ids(spark, sf):
    return table(spark, sf, "labels").select("doc_id").exceptAll(table(spark, sf, "documents").where("n_chars > 500").select("doc_id"))


@query("unlabelled_documents", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("candidate_members", with_("survivors sentences", """SELECT t.source_id, candidate, s.pos, s.n_words FROM survivors t JOIN sentences s ON s.source_id = t.source_id AND s.pos BETWEEN first_pos AND last_pos"""))
def candidate_members(spark, sf):
    from .quality_queries import survivors
    refs = survivors(spark, sf).select("source_id", "candidate", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    return refs.join(tb.sentences(spark, sf).select("source_id", "pos", "n_words"), ["source_id", "pos"])


@query("candidate_texts", with_("every sentences", """SELECT t.source_id, candidate, string_agg(s.text, chr(10) ORDER BY s.pos) AS text FROM every t JOIN sentences s ON s.source_id = t.source_id AND s.pos BETWEEN first_pos AND last_pos GROUP BY 1, 2"""))
def candidate_texts(spark, sf):
    units = wn.sentence_features(tb.sentences(spark, sf), tx.LATIN, block_rows=None, keep=("text",))
    found = wn.sentence_windows(units, bounded=True, texts=True)
    return found.select("source_id", (F.col("first_pos") * 4_294_967_296 + F.col("last_pos")).alias("candidate"), "text")


cte("shot_base", """SELECT hour, v0, v1, v2, lag(v0, 1) OVER w AS a1, lag(v0, 2) OVER w AS a2, lead(v0, 1) OVER w AS b1, lead(v0, 2) OVER w AS b2 FROM (SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, count(*) AS v0,
  round(avg(value), 6) AS v1, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS v2 FROM events GROUP BY 1) WINDOW w AS (ORDER BY hour)""")
SHOT_SCORE = "(coalesce(a1, 0) + coalesce(a2, 0) + coalesce(b1, 0) + coalesce(b2, 0)) / greatest((a1 IS NOT NULL)::INT + (a2 IS NOT NULL)::INT + (b1 IS NOT NULL)::INT + (b2 IS NOT NULL)::INT, 1)::DOUBLE"
cte("shot_hits", f"""SELECT * FROM (SELECT hour, v0, v1 >= 30 AND v2 >= 0.3 AS masked FROM shot_base WHERE v0 >= 8 AND v0 >= 1.2::DOUBLE * greatest({SHOT_SCORE}, 0.01::DOUBLE))""", "shot_base")


@query("change_points", with_("shot_hits", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
pool AS (SELECT *, row_number() OVER (ORDER BY v0 DESC, hour) AS rk FROM shot_hits WHERE NOT masked),
walk AS (SELECT rk, hour, true AS ok, [hour] AS kept FROM pool WHERE rk = 1 UNION ALL SELECT p.rk, p.hour, fine, CASE WHEN fine THEN list_append(kept, p.hour) ELSE kept END FROM walk w JOIN pool p ON p.rk = w.rk + 1,
  LATERAL (SELECT len(list_filter(w.kept, lambda k: abs(k - p.hour) < 4)) = 0 AS fine))
SELECT hour AS frame, 'suppressed' AS outcome FROM shot_hits WHERE masked UNION ALL SELECT hour, CASE WHEN ok THEN 'cut' ELSE 'too_close' END FROM walk""")
def change_points(spark, sf):
    from ..operators import shots as sh
    e = table(spark, sf, "events").select(tm.div(tm.wall_millis(F.col("ts")), 3_600_000).alias("frame"), "value", "event_type")
    signal = e.groupBy("frame").agg(F.count(F.lit(1)).alias("v0"), F.round(F.avg("value"), 6).alias("v1"),
                                    F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6).alias("v2")).withColumn("source_id", F.lit(0).cast("bigint"))
    return sh.change_points(signal, sh.ShotOptions(min_change=8, relative=1.2, outside_mean=30, outside_share=0.3, spacing=4)).drop("source_id")


# Review and job events.
DECISION = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'undecided' END"
cte("reviews", f"""SELECT event_id AS sequence, user_id % 10 AS task_id, CASE WHEN event_id % 9 = 4 THEN event_id - 1 ELSE event_id END AS request_id, user_id AS candidate_id, 's1' AS snapshot, {DECISION} AS decision FROM events""")


def reviews(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        i.alias("sequence"), F.lit(1).cast("bigint").alias("task_id"), F.when(i % 9 == 4, i - 1).otherwise(i).alias("request_id"), (u % 2).alias("candidate_id"),
        F.lit("s1").alias("snapshot"), F.expr(DECISION).alias("decision"), F.lit("a").alias("actor"), F.lit("r").alias("reason"), F.col("ts").cast("timestamp").alias("created_at"))


cte("rev", f"""SELECT event_id AS sequence, CASE WHEN event_id % 9 = 4 THEN event_id - 1 ELSE event_id END AS request_id, user_id % 2 AS candidate_id, {DECISION} AS decision FROM events""")


@query("review_requests", with_("rev", """SELECT sequence, request_id, candidate_id, decision, CASE WHEN sequence = f THEN 'accepted' WHEN candidate_id = fc AND decision = fd THEN 'repeated' ELSE 'conflict' END AS outcome FROM (SELECT *, min(sequence) OVER p AS f,
  arg_min(candidate_id, sequence) OVER p AS fc, arg_min(decision, sequence) OVER p AS fd FROM rev WINDOW p AS (PARTITION BY request_id))"""))
def review_requests(spark, sf):
    return rv.accept_requests(reviews(spark, sf)).select("sequence", "request_id", "candidate_id", "decision", "outcome")


@query("review_state", with_("rev", """SELECT sequence, candidate_id, decision, coalesce(lag(decision) OVER (PARTITION BY candidate_id ORDER BY sequence), 'undecided') AS before, lead(sequence) OVER (PARTITION BY candidate_id ORDER BY sequence) IS NULL AS latest FROM rev"""))
def review_state(spark, sf):
    return rv.review_state(reviews(spark, sf)).select("sequence", "candidate_id", "decision", "before", "latest")


@query("latest_decisions", """SELECT user_id AS candidate_id, max(event_id) AS sequence, arg_max(CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'undecided' END, event_id) AS decision, count(*) AS events FROM events GROUP BY 1""")
def latest_decisions(spark, sf):
    r = reviews(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("sequence"), "user_id"), "sequence").drop("candidate_id").withColumnRenamed("user_id", "candidate_id")
    return rv.latest_decisions(r).select("candidate_id", "sequence", "decision", "events")


STATUS = "CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'QUEUED' END"
cte("jobs", f"SELECT user_id AS task_id, event_id AS sequence, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk FROM events")


def job_events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("sequence"), F.expr(STATUS).alias("status"))


@query("job_states", with_("jobs", "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
walk AS (SELECT task_id, rk, sequence, status, NULL::VARCHAR AS before, status = 'QUEUED' AS accepted, CASE WHEN status = 'QUEUED' THEN status END AS now FROM jobs WHERE rk = 1
  UNION ALL SELECT j.task_id, j.rk, j.sequence, j.status, w.now, legal, CASE WHEN legal THEN j.status ELSE w.now END FROM walk w JOIN jobs j ON j.task_id = w.task_id AND j.rk = w.rk + 1,
  LATERAL (SELECT coalesce(CASE j.status WHEN 'QUEUED' THEN w.now IS NULL WHEN 'RUNNING' THEN w.now = 'QUEUED' ELSE w.now = 'RUNNING' END, false) AS legal))
SELECT task_id, sequence, status, before, accepted FROM walk""")
def job_states(spark, sf):
    return rv.job_states(job_events(spark, sf))


@query("audit_trail", """SELECT event_id AS sequence, user_id AS task_id, CASE WHEN event_type = 'purchase' THEN 'edl_adoption' WHEN event_type = 'click' THEN 'manual_edit' ELSE 'candidate_review' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events""")
def audit_trail(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("task_id"), "event_type", F.col("ts").cast("timestamp").alias("instant"), tm.wall_millis(F.col("ts")).alias("ms"))
    part = lambda cond, kind: e.where(cond).drop("event_type").withColumn("kind", F.lit(kind))
    rows = rv.audit_trail(part("event_type = 'purchase'", "edl_adoption"), part("event_type = 'click'", "manual_edit"), part("event_type NOT IN ('purchase', 'click')", "candidate_review"))
    return sc.scan(rows, ["task_id"], ["instant", "sequence"], sc.by_time("ms", 86_400_000), place=sc.running_sum(F.lit(1).cast("bigint"))).select("sequence", "task_id", "kind", "place")


@query("candidate_views", with_("every", """SELECT source_id, candidate, rank, CASE WHEN rank = 1 THEN 'retained' WHEN has_answer THEN 'review' ELSE 'all' END AS view FROM every"""))
def candidate_views(spark, sf):
    from .quality_queries import every
    view = F.when(F.col("rank") == 1, "retained").when(F.col("has_answer"), "review").otherwise("all")
    return every(spark, sf).select("source_id", "candidate", "rank", view.alias("view"))


@query("array_prefixes", with_("survivors", """SELECT a.source_id, a.candidate, b.candidate AS longer FROM survivors a JOIN survivors b ON b.source_id = a.source_id AND b.start_ms = a.start_ms AND b.last_pos > a.last_pos AND b.first_pos = a.first_pos"""))
def array_prefixes(spark, sf):
    from ..session import cut
    from .quality_queries import survivors
    t = cut(survivors(spark, sf)).withColumn("refs", F.sequence("first_pos", "last_pos"))
    a = t.select("source_id", "start_ms", "candidate", F.col("refs").alias("r1"))
    b = t.select("source_id", "start_ms", F.col("candidate").alias("longer"), F.col("refs").alias("r2"))
    n = F.size("r1")
    return a.join(b, ["source_id", "start_ms"]).where((F.size("r2") > n) & (F.slice(F.col("r2"), F.lit(1), n) == F.col("r1"))).select("source_id", "candidate", "longer")
