"""Common table expressions that the check queries share."""

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
RECURSIVE: set[str] = set()


def cte(name: str, body: str, *needs: str, recursive: bool = False) -> None:
    CTES[name] = (needs, body)
    if recursive:
        RECURSIVE.add(name)


def with_(names: str, body: str) -> str:
    """``body`` with the named expressions, and those they need, in front."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in CTES[name][0]:
            add(need)
        done.append(name)

    for name in names.split():
        add(name)
    return ("WITH RECURSIVE " if RECURSIVE & set(done) else "WITH ") + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + body


cte("tokens", r"""SELECT doc_id AS source_id,
  list_filter(regexp_split_to_array(text, '[ \t\r\n\f]+'), lambda t: t <> '') AS l FROM documents""")
cte("word_raw", "SELECT source_id, unnest(l) AS text, generate_subscripts(l, 1)::BIGINT AS pos FROM tokens", "tokens")
cte("word_dur", """SELECT *, 60 * length(text) + 40 AS dur,
  CASE WHEN pos % 241 = 0 THEN 3600 WHEN right(text, 1) IN ('.', '!', '?') THEN 450 ELSE 20 END AS gap
  FROM word_raw""", "word_raw")
cte("word_start", """SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY source_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM word_dur""", "word_dur")
cte("words", """SELECT source_id, pos, text, start_ms, (start_ms + dur)::BIGINT AS end_ms FROM word_start""",
    "word_start")
cte("word_bins", "SELECT *, unnest(range(start_ms // 15000, end_ms // 15000 + 1)) AS bin FROM words", "words")
TERMINAL = r"""[。！？!?；;.][”’"''）)】\]]*$"""
cte("word_flags", rf"""SELECT *, CASE WHEN reach IS NULL OR closed OR start_ms - reach >= 1000 THEN 1 ELSE 0 END AS o FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  lag(regexp_matches(rtrim(text), '{TERMINAL}')) OVER (PARTITION BY source_id ORDER BY pos) AS closed FROM words)""", "words")
cte("word_sent", "SELECT *, sum(o) OVER (PARTITION BY source_id ORDER BY pos)::BIGINT AS sent FROM word_flags", "word_flags")
cte("sentences", """SELECT source_id, sent AS pos, min(pos) AS first_word, max(pos) AS last_word,
  min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(text, ' ' ORDER BY pos) AS text
  FROM word_sent GROUP BY ALL""", "word_sent")
cte("blocks", """SELECT *, sum(CASE WHEN start_ms - prev_end > 3000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_id ORDER BY pos)::BIGINT AS hard_block FROM (
  SELECT *, lag(end_ms) OVER (PARTITION BY source_id ORDER BY pos) AS prev_end FROM sentences)""", "sentences")
cte("windows", """SELECT a.source_id, a.pos AS first_pos, b.pos AS last_pos, a.start_ms, b.end_ms,
  b.end_ms - a.start_ms AS duration_ms FROM blocks a JOIN blocks b
  ON a.source_id = b.source_id AND a.hard_block = b.hard_block AND b.pos >= a.pos
  AND b.end_ms - a.start_ms BETWEEN 15000 AND 90000""", "blocks")
cte("window_bins", "SELECT *, unnest(range(start_ms // 15000, end_ms // 15000 + 1)) AS bin FROM windows", "windows")
QUESTION = r"\?|^(?:why|how|what|when|where|who)\s"
cte("sent_feat", rf"""SELECT *, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS units,
  len(regexp_extract_all(lower(text), 'and|for|the')) AS hits,
  (length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'))::BIGINT * 1000000000000) // (end_ms - start_ms) AS rate,
  regexp_matches(text, '(?i)because|so|the|and') AS answers,
  regexp_matches(text, '(?i){QUESTION}') AS asks,
  regexp_matches(regexp_extract(text, '(?is)^.*?(?:{QUESTION})(.*)$', 1), '(?i)because|so|the|and') AS self_answer
  FROM blocks""", "blocks")
cte("sent_qa", """SELECT *, CASE WHEN asks AND self_answer THEN pos
  WHEN asks AND lead(answers, 1) OVER w THEN pos + 1 WHEN asks AND lead(answers, 2) OVER w THEN pos + 2 END AS answered,
  abs(rate - lag(rate) OVER w) AS step FROM sent_feat WINDOW w AS (PARTITION BY source_id ORDER BY pos)""", "sent_feat")
cte("window_sums", """SELECT w.source_id, w.first_pos, w.last_pos, w.start_ms, w.end_ms, w.duration_ms,
  count(*) AS n_sentences, sum(s.hits)::BIGINT AS keyword_hits, sum(3 * s.hits)::BIGINT AS cov, sum(s.units)::BIGINT AS text_units,
  sum(s.rate)::BIGINT AS rate, coalesce(sum(CASE WHEN s.pos > w.first_pos THEN s.step END), 0)::BIGINT AS step,
  coalesce(bool_or(s.answered <= w.last_pos), false) AS has_answer
  FROM windows w JOIN sent_qa s ON s.source_id = w.source_id AND s.pos BETWEEN w.first_pos AND w.last_pos
  GROUP BY ALL""", "windows", "sent_qa")
cte("word_levels", """SELECT source_id, start_ms // 1000 AS frame, max(CASE WHEN source_id % 11 = 0 THEN -70.0::DOUBLE ELSE -30.0::DOUBLE + (pos // 40 * 17 % 40) * 0.5::DOUBLE - ((length(text) * 7 + pos) % 10) * 0.5::DOUBLE END) AS db
  FROM words GROUP BY 1, 2""", "words")
cte("level_base", "SELECT source_id, coalesce(round_even(median(db) FILTER (db > -60) * 1e6::DOUBLE, 0) / 1e6::DOUBLE, -120.0::DOUBLE) AS base FROM word_levels GROUP BY 1", "word_levels")
cte("window_peaks", """SELECT w.source_id, w.first_pos, w.last_pos, max(db) AS peak FROM (SELECT *, unnest(range(start_ms // 10000, end_ms // 10000 + 1)) AS bin FROM windows) w
  JOIN word_levels f ON f.source_id = w.source_id AND f.frame // 10 = w.bin AND f.frame * 1000 + 500 >= w.start_ms AND f.frame * 1000 + 500 < w.end_ms GROUP BY ALL""", "windows", "word_levels")
cte("window_loud", """SELECT s.*, CASE WHEN coalesce(peak, -120) > -60 AND base > -60 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, peak - base) / 12.0::DOUBLE) ELSE 0.0::DOUBLE END AS loud
  FROM window_sums s JOIN level_base b ON b.source_id = s.source_id LEFT JOIN window_peaks p ON p.source_id = s.source_id AND p.first_pos = s.first_pos AND p.last_pos = s.last_pos""", "window_sums", "level_base", "window_peaks")
cte("window_parts", """SELECT * EXCLUDE (cov, rate, step, loud),
  round_even(least(1.0::DOUBLE, CASE WHEN text_units > 0 THEN cov::DOUBLE / text_units ELSE 0.0 END / 0.08::DOUBLE) * 35.0::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS keyword_score,
  round_even(least(1.0::DOUBLE, CASE WHEN rate > 0 THEN (CASE WHEN n_sentences > 1 THEN step::DOUBLE / (n_sentences - 1) ELSE 0.0 END) / (rate::DOUBLE / n_sentences) ELSE 0.0 END / 0.5::DOUBLE) * 15.0::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS pace_score,
  round_even(loud * 15.0::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS volume_score, CASE WHEN has_answer THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END AS qa_score,
  round_even(least(1.0::DOUBLE, abs(duration_ms - 30000)::DOUBLE / 30000.0::DOUBLE) * -20.0::DOUBLE * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS duration_score
  FROM window_loud""", "window_loud")
cte("scored", """SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 20.0::DOUBLE + keyword_score + pace_score
  + volume_score + qa_score + duration_score)) * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS score FROM window_parts""", "window_parts")
cte("turns", """SELECT source_id, pos, role, text, start_ms, (start_ms + dur)::BIGINT AS end_ms FROM (
  SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
  FROM (SELECT conv_id AS source_id, turn AS pos, role, text, greatest(length(text), 1) * 50 AS dur,
    CASE WHEN turn % 7 = 6 THEN 3500 ELSE 800 END AS gap FROM conversations))""")
cte("ev", """SELECT user_id AS source_id, event_id, event_type, value, props, epoch_us(ts) // 1000 AS ms,
  epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS at_ms FROM events""")
cte("ivals", """SELECT source_id, event_id, event_type, value, at_ms AS start_ms,
  (at_ms + ceil(value)::BIGINT * 60000)::BIGINT AS end_ms FROM ev""", "ev")
cte("marked_turns", r"""SELECT * REPLACE (CASE pos % 12 WHEN 0 THEN bare || '?' WHEN 2 THEN 'Because ' || bare WHEN 3 THEN 'So ' || text WHEN 5 THEN bare || ':'
  WHEN 6 THEN '"' || text WHEN 8 THEN text || '"' WHEN 9 THEN 'what is ' || bare WHEN 11 THEN text || '“' ELSE text END AS text) FROM (
  SELECT *, regexp_replace(text, '[.!?]+\s*$', '') AS bare FROM turns)""", "turns")
cte("every", """SELECT * FROM (SELECT *, first_pos * 4294967296 + last_pos AS candidate, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, start_ms, end_ms, first_pos) AS rank FROM scored)""", "scored")
cte("top", "SELECT * FROM every WHERE rank <= 5", "every")
# Each step takes the best window left in every source and those it suppresses; where a window is seen last tells its fate.
cte("nms_walk", """SELECT source_id, candidate, start_ms, end_ms, score, rank AS rk, 0 AS step FROM every
  UNION ALL SELECT source_id, candidate, start_ms, end_ms, score, rk, step + 1 FROM (SELECT *, min(rk) OVER p AS best, arg_min(start_ms, rk) OVER p AS s, arg_min(end_ms, rk) OVER p AS e
    FROM nms_walk WINDOW p AS (PARTITION BY source_id)) WHERE rk > best AND greatest(0, least(e, end_ms) - greatest(s, start_ms))::DOUBLE / (greatest(e, end_ms) - least(s, start_ms)) < 0.5""", "every", recursive=True)
cte("nms_last", "SELECT source_id, candidate, max(step) AS step FROM nms_walk GROUP BY 1, 2", "nms_walk")
cte("nms_best", "SELECT source_id, step, arg_min(candidate, rk) AS best, arg_min(start_ms, rk) AS s, arg_min(end_ms, rk) AS e FROM nms_walk GROUP BY 1, 2", "nms_walk")
cte("survivors", """SELECT v.* REPLACE (row_number() OVER (PARTITION BY v.source_id ORDER BY v.rank) AS rank) FROM every v JOIN nms_last l ON l.source_id = v.source_id AND l.candidate = v.candidate
  JOIN nms_best b ON b.source_id = l.source_id AND b.step = l.step AND b.best = l.candidate""", "nms_last", "nms_best")
