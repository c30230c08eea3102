"""Queries over sentences, candidate windows and scores."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import islands, strategies as st, windows as wn
from ..session import table
from . import tables as tb
from .catalog import query
from .oracle import cte, with_

SCORED = ("source_id, first_pos, last_pos, start_ms, end_ms, duration_ms, n_sentences, keyword_hits, text_units, "
          "has_answer, keyword_score, pace_score, volume_score, qa_score, duration_score, score")


def scored(spark, sf):
    return wn.score_rule(tb.features(spark, sf), bounded=True)


@query("top_windows", with_("scored", f"""SELECT {SCORED}, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY source_id ORDER BY score DESC, start_ms, end_ms, first_pos) AS rank FROM scored) WHERE rank <= 5"""))
def top_windows(spark, sf):
    return wn.best_per_source(scored(spark, sf), 5)


@query("plain_sentences", with_("sentences", "SELECT * FROM sentences"))
def plain_sentences(spark, sf):
    return tb.sentences(spark, sf)


@query("sentence_windows", with_("windows", "SELECT * FROM windows"))
def sentence_windows(spark, sf):
    features = tb.plain_features(spark, sf)
    return wn.sentence_windows(features, bounded=True)


@query("rule_score", with_("scored", f"SELECT {SCORED} FROM scored"))
def rule_score(spark, sf):
    return scored(spark, sf)


DEFAULT = st.default().digest()
cte("unit_hash", "SELECT source_id, pos, sha256(pos || '|' || start_ms || '|' || end_ms || '|' || text) AS h FROM sentences", "sentences")
cte("digest_1", "SELECT source_id, pos // 256 AS a, pos // 65536 AS b, pos // 16777216 AS c, sha256(string_agg(h, chr(10) ORDER BY pos)) AS h FROM unit_hash GROUP BY 1, 2, 3, 4", "unit_hash")
cte("digest_2", "SELECT source_id, b, c, sha256(string_agg(h, chr(10) ORDER BY a)) AS h FROM digest_1 GROUP BY 1, 2, 3", "digest_1")
cte("digest_3", "SELECT source_id, c, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM digest_2 GROUP BY 1, 2", "digest_2")
cte("source_digest", "SELECT source_id, sha256(string_agg(h, chr(10) ORDER BY c)) AS digest FROM digest_3 GROUP BY 1", "digest_3")
cte("window_ids", f"SELECT w.*, 'c_' || sha256('{DEFAULT}/' || digest || '/' || first_pos || '-' || last_pos) AS candidate_id FROM every w JOIN source_digest d ON d.source_id = w.source_id", "every", "source_digest")


@query("candidate_ids", with_("window_ids", "SELECT source_id, first_pos, last_pos, start_ms, end_ms, candidate_id FROM window_ids"))
def candidate_ids(spark, sf):
    return st.generate(st.default(), tb.sentences(spark, sf), tx.LATIN, bounded=True)


@query("window_warnings", with_("sentences windows", """SELECT source_id, unnest(list_filter([CASE WHEN n IS NULL THEN 'no_sentences' END, CASE WHEN long THEN 'overlong_sentence_unit_skipped' END, CASE WHEN w IS NULL THEN 'no_eligible_window' END], lambda x: x IS NOT NULL)) AS warning
  FROM (SELECT doc_id AS source_id FROM documents GROUP BY 1) d LEFT JOIN (SELECT source_id, count(*) AS n, bool_or(end_ms - start_ms > 90000) AS long FROM sentences GROUP BY 1) s USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) AS w FROM windows GROUP BY 1) v USING (source_id)"""))
def window_warnings(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"))
    features = tb.plain_features(spark, sf)
    return st.window_warnings(docs, features, wn.sentence_windows(features, bounded=True))


cte("batch_rows", "SELECT i.source_id, i.candidate_id, i.score, (i.start_ms * 30) // 1000 AS f1, (i.end_ms * 30 + 999) // 1000 AS f2 FROM window_ids i JOIN survivors s ON s.source_id = i.source_id AND s.candidate = i.candidate", "window_ids", "survivors")
cte("batch_tree", f"""SELECT source_id, sha256('{DEFAULT}' || '/' || sha256(string_agg(h, chr(10) ORDER BY p2))) AS batch_id FROM (SELECT source_id, p2, sha256(string_agg(h, chr(10) ORDER BY p4)) AS h FROM (
  SELECT source_id, substr(candidate_id, 3, 2) AS p2, substr(candidate_id, 3, 4) AS p4, sha256(string_agg(sha256(candidate_id || '|' || f1 || '|' || f2 || '|' || round_even(score * 1e6::DOUBLE, 0)::BIGINT), chr(10) ORDER BY candidate_id)) AS h FROM batch_rows GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""", "batch_rows")


@query("frozen_batch", with_("batch_rows batch_tree", """SELECT r.source_id, row_number() OVER (PARTITION BY r.source_id ORDER BY candidate_id) AS sample, candidate_id, score, f1 AS start_frame, f2 AS end_frame,
  (count(*) OVER (PARTITION BY r.source_id) * 85 + 99) // 100 AS required_passes, batch_id FROM batch_rows r JOIN batch_tree t ON t.source_id = r.source_id"""))
def frozen_batch(spark, sf):
    from .quality_queries import survivors
    return st.freeze(st.with_ids(survivors(spark, sf), tb.sentences(spark, sf), st.default()), st.default())
