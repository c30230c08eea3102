"""Queries of evaluation statistics, ratings and levels."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev, scan as sc
from ..session import table
from . import tables as tb
from .catalog import query
from .oracle import cte, with_

cte("cut_ref", "SELECT DISTINCT source_id, at_ms // 60000 AS frame FROM ev WHERE event_type = 'purchase'", "ev")
cte("cut_pred", "SELECT DISTINCT source_id, at_ms // 60000 AS frame FROM ev WHERE event_type = 'click'", "ev")
MATCH = """lists AS (SELECT source_id, coalesce(r, []) AS r, coalesce(p, []) AS p FROM (SELECT DISTINCT source_id FROM ev) LEFT JOIN (SELECT source_id, list(frame ORDER BY frame) AS r FROM cut_ref GROUP BY 1) USING (source_id)
  LEFT JOIN (SELECT source_id, list(frame ORDER BY frame) AS p FROM cut_pred GROUP BY 1) USING (source_id)),
steps AS (SELECT source_id, r, p, 1 AS i, 1 AS j, NULL::BIGINT AS ref_frame, NULL::BIGINT AS pred_frame, NULL::VARCHAR AS outcome FROM lists
  UNION ALL SELECT source_id, r, p, CASE WHEN o IN ('match', 'missed') THEN i + 1 ELSE i END, CASE WHEN o IN ('match', 'extra') THEN j + 1 ELSE j END,
  CASE WHEN o IN ('match', 'missed') THEN r[i] END, CASE WHEN o IN ('match', 'extra') THEN p[j] END, o FROM (
  SELECT *, CASE WHEN i > len(r) THEN 'extra' WHEN j > len(p) THEN 'missed' WHEN p[j] < r[i] - 30 THEN 'extra' WHEN r[i] < p[j] - 30 THEN 'missed' ELSE 'match' END AS o FROM steps WHERE i <= len(r) OR j <= len(p))),
matched AS (SELECT source_id, ref_frame, pred_frame, outcome FROM steps WHERE outcome IS NOT NULL)"""


def rec(names, extra, body):
    return with_(names, "").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + extra + "\n" + body


def cut_lists(spark, sf):
    e = tb.events(spark, sf)
    pick = lambda kind: e.where(F.col("event_type") == kind).select("source_id", F.floor(F.col("at_ms") / 60000).alias("frame")).distinct()
    return pick("purchase"), pick("click")


def matches(spark, sf):
    return ev.match_cuts(*cut_lists(spark, sf), tolerance=30)


@query("cut_matches", rec("cut_ref cut_pred", MATCH, "SELECT * FROM matched"))
def cut_matches(spark, sf):
    return matches(spark, sf)


PER = """per AS (SELECT source_id, source_id % 3 AS category, source_id % 2 AS split, count(*) FILTER (outcome = 'match') AS tp, count(*) FILTER (outcome = 'extra') AS fp,
  count(*) FILTER (outcome = 'missed') AS fn FROM matched GROUP BY 1)"""
METRICS = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1"""


@query("micro_f1", rec("cut_ref cut_pred", MATCH + ",\n" + PER, f"""SELECT *, {METRICS} FROM (SELECT category, split, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
  count(*) AS sources FROM per GROUP BY GROUPING SETS ((), (category), (split)))"""))
def micro_f1(spark, sf):
    users = tb.events(spark, sf).select("source_id").distinct()
    sets = users.select("source_id", (F.col("source_id") % 3).alias("category"), (F.col("source_id") % 2).alias("split"))
    return ev.micro_f1(matches(spark, sf), sets)


@query("dataset_readiness", rec("cut_ref cut_pred", MATCH + ",\n" + PER, f"""SELECT *, scored >= 10 AND smallest_category >= 3 AND category_not_eligible + missing_annotation = 0 AND duplicates = 0 AS ready,
  coalesce(scored >= 10 AND smallest_category >= 3 AND category_not_eligible + missing_annotation = 0 AND duplicates = 0 AND f1 >= 0.75, false) AS target_met FROM (SELECT *, {METRICS} FROM (
  SELECT count(*) FILTER (cat < 3 AND ann) AS scored, count(*) FILTER (cat >= 3) AS category_not_eligible, count(*) FILTER (cat < 3 AND NOT ann) AS missing_annotation,
  least(count(*) FILTER (cat = 0 AND ann), count(*) FILTER (cat = 1 AND ann), count(*) FILTER (cat = 2 AND ann)) AS smallest_category,
  coalesce(sum(tp) FILTER (cat < 3 AND ann), 0)::BIGINT AS tp, coalesce(sum(fp) FILTER (cat < 3 AND ann), 0)::BIGINT AS fp, coalesce(sum(fn) FILTER (cat < 3 AND ann), 0)::BIGINT AS fn,
  count(*) - count(DISTINCT h) AS duplicates FROM (SELECT *, source_id % 5 AS cat, tp + fn > 0 AS ann, source_id // 2 AS h FROM per)))"""))
def dataset_readiness(spark, sf):
    per = matches(spark, sf).groupBy("source_id").agg(*[F.count_if(F.col("outcome") == o).alias(n) for n, o in (("tp", "match"), ("fp", "extra"), ("fn", "missed"))])
    items = per.withColumn("category", F.col("source_id") % 5).withColumn("annotated", F.col("tp") + F.col("fn") > 0).withColumn(
        "source_hash", F.floor(F.col("source_id") / 2))
    return ev.readiness(items, categories=(0, 1, 2))


FORM = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{P}]', '', 'g')"
# The check database counts edits by byte; capitals, which lower-case text does not have, stand for the letters beyond ASCII.
BYTES = "translate({}, 'éèêçàáíóúñäöüß', 'ABCDEFGHIJKLMN')"
EDITS = f"levenshtein({BYTES.format('reference')}, {BYTES.format('hypothesis')})"
cte("pairs", f"""SELECT a.source_id, a.pos, {FORM.replace('text', 'a.text')} AS reference, {FORM.replace('text', 'b.text')} AS hypothesis, a.pos % 17 = 0 AS partial
  FROM sentences a JOIN sentences b ON b.source_id = a.source_id AND b.pos = a.pos + 1""", "sentences")
cte("rates", f"""SELECT *, {EDITS} AS edits, length(reference) AS ref_chars,
  CASE WHEN length(reference) > 0 THEN {EDITS} / length(reference)::DOUBLE END AS cer FROM pairs""", "pairs")


def pairs(spark, sf):
    """Neighbouring sentences as reference and hypothesis."""
    s = sc.scan(tb.sentences(spark, sf).select("source_id", "pos", tx.error_rate_form(F.col("text")).alias("reference")), ["source_id"], ["pos"], None,
                hypothesis=sc.following(F.col("reference")))
    return s.where("hypothesis IS NOT NULL").withColumn("partial", F.col("pos") % 17 == 0)


@query("error_rates", with_("rates", "SELECT * FROM rates"))
def error_rates(spark, sf):
    return ev.error_rates(pairs(spark, sf))


@query("pooled_error_rate", with_("rates", """SELECT source_id, count(*) AS pairs, sum(edits) FILTER (NOT partial)::BIGINT AS edits, sum(ref_chars) FILTER (NOT partial)::BIGINT AS ref_chars,
  NOT bool_or(partial) AS complete, CASE WHEN NOT bool_or(partial) AND sum(ref_chars) > 0 THEN sum(edits) FILTER (NOT partial) / (sum(ref_chars) FILTER (NOT partial))::DOUBLE END AS cer FROM rates GROUP BY 1"""))
def pooled_error_rate(spark, sf):
    return ev.pooled_error_rate(ev.error_rates(pairs(spark, sf)), ["source_id"])


@query("edit_alignment")
def edit_alignment(spark, sf):
    p = pairs(spark, sf)
    return p.withColumn("c", ev.edit_counts("reference", "hypothesis")).select("source_id", "pos", "c.*")


ENDPOINT = "CASE WHEN abs({p} - {h}) + unsure <= 300 THEN 'pass' WHEN greatest(abs({p} - {h}) - unsure, 0) > 300 THEN 'fail' ELSE 'uncertain' END"
cte("targets", """SELECT source_id, start_ms AS p_start, end_ms AS p_end, start_ms + (pos % 13 - 6) * 60 AS h_start, end_ms + (pos % 11 - 5) * 70 AS h_end,
  (pos % 5) * 40 AS unsure, pos % 19 > 0 AS locatable FROM words""", "words")


@query("timing_report", with_("targets", f"""SELECT source_id, count(*) AS targets, count(*) FILTER (st = 'pass') AS pass, count(*) FILTER (st = 'fail') AS fail, count(*) FILTER (st = 'uncertain') AS uncertain,
  count(*) FILTER (st = 'not_measurable') AS not_measurable, sum(e1 + e2) FILTER (locatable) / (2 * count(*) FILTER (locatable))::DOUBLE AS mae_ms,
  max(greatest(e1, e2) + unsure) FILTER (locatable) AS max_bound_ms FROM (SELECT *, abs(p_start - h_start) AS e1, abs(p_end - h_end) AS e2,
  CASE WHEN NOT locatable THEN 'not_measurable' WHEN a = 'fail' OR b = 'fail' THEN 'fail' WHEN a = 'pass' AND b = 'pass' THEN 'pass' ELSE 'uncertain' END AS st
  FROM (SELECT *, {ENDPOINT.format(p='p_start', h='h_start')} AS a, {ENDPOINT.format(p='p_end', h='h_end')} AS b FROM targets)) GROUP BY 1"""))
def timing_report(spark, sf):
    p = F.col("pos")
    t = tb.words(spark, sf).select("source_id", F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"),
                                   (F.col("start_ms") + (p % 13 - 6) * 60).alias("h_start"), (F.col("end_ms") + (p % 11 - 5) * 70).alias("h_end"),
                                   ((p % 5) * 40).alias("unsure"), (p % 19 > 0).alias("locatable"))
    return ev.timing_report(t, ["source_id"])


DELTA = "CASE WHEN {lo} >= -300 AND {hi} <= 300 THEN 'within_tolerance' WHEN {hi} < -300 OR {lo} > 300 THEN 'outside_tolerance' ELSE 'uncertain' END"


@query("cue_timing_classes", with_("sentences", f"""SELECT *, CASE WHEN a = 'outside_tolerance' OR b = 'outside_tolerance' THEN 'outside_tolerance' WHEN a = 'within_tolerance' AND b = 'within_tolerance' THEN 'within_tolerance'
  WHEN a = 'uncertain' OR b = 'uncertain' THEN 'uncertain' ELSE 'not_fully_measurable' END AS status FROM (SELECT source_id, pos,
  {DELTA.format(lo='(pos % 9 - 4) * 110', hi='(pos % 9 - 4) * 110 + (n_words % 6) * 50')} AS a,
  CASE WHEN pos % 23 = 0 THEN 'not_measured' ELSE {DELTA.format(lo='(pos % 7 - 3) * 120', hi='(pos % 7 - 3) * 120 + (n_words % 4) * 90')} END AS b FROM sentences)"""))
def cue_timing_classes(spark, sf):
    p, n = F.col("pos"), F.col("n_words")
    a = ev.delta_class((p % 9 - 4) * 110, (p % 9 - 4) * 110 + (n % 6) * 50)
    b = F.when(p % 23 == 0, "not_measured").otherwise(ev.delta_class((p % 7 - 3) * 120, (p % 7 - 3) * 120 + (n % 4) * 90))
    return tb.sentences(spark, sf).select("source_id", "pos", a.alias("a"), b.alias("b")).withColumn("status", ev.worst_class(F.col("a"), F.col("b")))


# Six answers per document and rater; the last one accepts and comes from the labels.
def answer_sql(q: int, rater: int) -> str:
    return f"CASE WHEN (doc_id * 7 + {q} * 3 + {rater} * 5) % 11 < 7 THEN 'yes' WHEN (doc_id * 7 + {q} * 3 + {rater} * 5) % 11 < 9 THEN 'no' ELSE 'uncertain' END"


ACCEPT = ("CASE WHEN quality IS NULL THEN 'uncertain' WHEN quality = 1 THEN 'yes' ELSE 'no' END",
          "CASE WHEN toxic IS NULL THEN 'uncertain' WHEN toxic = 0 THEN 'yes' ELSE 'no' END")
cte("answers", "SELECT d.doc_id, lang, source, r.rater, " + ", ".join(
    f"CASE rater WHEN 'A' THEN {answer_sql(q, 0)} ELSE {answer_sql(q, 1)} END AS q{q}" for q in range(1, 6)) +
    f", CASE rater WHEN 'A' THEN {ACCEPT[0]} ELSE {ACCEPT[1]} END AS q6 FROM (SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) d, (VALUES ('A'), ('B')) r(rater)")


def documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id", "left")


def answers(spark, sf):
    both = documents(spark, sf).withColumn("rater", F.explode(F.array(F.lit("A"), F.lit("B"))))
    a = F.col("rater") == "A"
    qs = [F.when(a, F.expr(answer_sql(q, 0))).otherwise(F.expr(answer_sql(q, 1))).alias(f"q{q}") for q in range(1, 6)]
    return both.select("doc_id", "lang", "source", "rater", *qs, F.when(a, F.expr(ACCEPT[0])).otherwise(F.expr(ACCEPT[1])).alias("q6"))


cte("accepts", f"SELECT doc_id, lang, source, {ACCEPT[0]} AS a, {ACCEPT[1]} AS b FROM documents LEFT JOIN labels USING (doc_id)")


def accepts(spark, sf):
    return documents(spark, sf).select("doc_id", "lang", "source", F.expr(ACCEPT[0]).alias("a"), F.expr(ACCEPT[1]).alias("b"))


def kappa_sql(by: str, rows: str) -> str:
    g = f"{by}, " if by else ""
    on = " AND ".join(f"x.{c.strip()} = t.{c.strip()}" for c in by.split(",")) if by else "true"
    return f"""SELECT t.*, agree / n::DOUBLE AS po, CASE WHEN n * n - expected > 0 THEN (agree * n - expected) / (n * n - expected)::DOUBLE END AS kappa,
  CASE WHEN n * n - expected = 0 THEN 'one_minus_Pe_is_zero' END AS null_reason FROM (SELECT t.*, coalesce(x.e, 0)::BIGINT AS expected FROM (
  SELECT {g}count(*) AS n, count(*) FILTER (a = b) AS agree FROM ({rows}) {'GROUP BY ' + by if by else ''}) t LEFT JOIN (
  SELECT {g}sum(ca * cb) AS e FROM (SELECT {g}a AS l, count(*) AS ca FROM ({rows}) GROUP BY {g}a) JOIN (SELECT {g}b AS l, count(*) AS cb FROM ({rows}) GROUP BY {g}b) USING ({g}l)
  {'GROUP BY ' + by if by else ''}) x ON {on}) t"""


@query("kappa_by_language", with_("accepts", kappa_sql("lang", "SELECT * FROM accepts")))
def kappa_by_language(spark, sf):
    return ev.kappa(accepts(spark, sf), ["lang"]).withColumn("expected", F.col("expected").cast("bigint"))


YES = "SELECT lang, CASE WHEN a = 'yes' THEN 'yes' ELSE 'not_yes' END AS a, CASE WHEN b = 'yes' THEN 'yes' ELSE 'not_yes' END AS b FROM accepts"


@query("kappa_yes_vs_rest", with_("accepts", kappa_sql("lang", YES)))
def kappa_yes_vs_rest(spark, sf):
    yes = lambda c: F.when(F.col(c) == "yes", "yes").otherwise("not_yes").alias(c)
    return ev.kappa(accepts(spark, sf).select("lang", yes("a"), yes("b")), ["lang"]).withColumn("expected", F.col("expected").cast("bigint"))


PERQ = "SELECT question, a, b FROM (" + " UNION ALL ".join(
    f"SELECT {q} AS question, max(q{q}) FILTER (rater = 'A') AS a, max(q{q}) FILTER (rater = 'B') AS b FROM answers GROUP BY doc_id" for q in range(1, 7)) + ")"


@query("kappa_by_question", with_("answers", kappa_sql("question", PERQ)))
def kappa_by_question(spark, sf):
    w = answers(spark, sf)
    wide = w.groupBy("doc_id").agg(*[F.max(F.when(F.col("rater") == r, F.col(f"q{q}"))).alias(f"{r}{q}") for q in range(1, 7) for r in "AB"])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(f"A{q}").alias("a"), F.col(f"B{q}").alias("b")) for q in range(1, 7)])).alias("r"))
    return ev.kappa(long.select("r.*"), ["question"]).withColumn("expected", F.col("expected").cast("bigint"))


UNSURE = ", ".join(f"count(*) FILTER (q{q} = 'uncertain') AS uncertain_q{q}" for q in range(1, 7))
RATES_SQL = f"""count(*) AS samples, count(*) FILTER (q1 = 'yes' AND q2 = 'yes') / count(*)::DOUBLE AS boundary_rate,
  count(*) FILTER (q1 = 'yes' AND q2 = 'yes' AND q3 = 'yes' AND q4 = 'yes' AND q5 = 'yes') / count(*)::DOUBLE AS semantic_rate, count(*) FILTER (q6 = 'yes') / count(*)::DOUBLE AS accept_rate,
  {UNSURE}, count(*) FILTER ('uncertain' IN (q1, q2, q3, q4, q5, q6)) AS any_uncertain"""


@query("rater_rates", with_("answers", f"SELECT rater, {RATES_SQL} FROM answers GROUP BY rater"))
def rater_rates(spark, sf):
    return ev.rater_rates(answers(spark, sf), ["rater"])


@query("source_balanced_rates", with_("answers", f"""SELECT rater, count(*) AS sources, round(avg(boundary_rate), 9) AS boundary_rate, round(avg(semantic_rate), 9) AS semantic_rate, round(avg(accept_rate), 9) AS accept_rate
  FROM (SELECT rater, source, lang, {RATES_SQL} FROM answers GROUP BY rater, source, lang) GROUP BY rater"""))
def source_balanced_rates(spark, sf):
    per = ev.rater_rates(answers(spark, sf), ["rater", "source", "lang"])
    out = ev.balanced_mean(per, ["rater"], ["boundary_rate", "semantic_rate", "accept_rate"])
    return out.select("rater", "sources", *[F.round(c, 9).alias(c) for c in ("boundary_rate", "semantic_rate", "accept_rate")])


@query("accept_overlap", with_("accepts", """SELECT lang, count(*) AS n, count(*) FILTER (a = 'yes' AND b = 'yes') AS both_yes, count(*) FILTER ((a = 'yes') <> (b = 'yes')) AS one_yes,
  count(*) FILTER (a <> 'yes' AND b <> 'yes') AS neither_yes FROM accepts GROUP BY lang"""))
def accept_overlap(spark, sf):
    return ev.accept_overlap(accepts(spark, sf), ["lang"])


@query("question_margins", with_("answers", "SELECT rater, question, count(*) FILTER (x = 'yes') AS yes_count, count(*) FILTER (x = 'no') AS no_count, count(*) FILTER (x = 'uncertain') AS uncertain_count, count(*) FILTER (x <> 'yes') AS non_yes_count FROM (" + " UNION ALL ".join(
    f"SELECT rater, {q} AS question, q{q} AS x FROM answers" for q in range(1, 7)) + ") GROUP BY 1, 2"))
def question_margins(spark, sf):
    long = answers(spark, sf).select("rater", F.posexplode(F.array(*[f"q{q}" for q in range(1, 7)])).alias("p", "x"))
    return long.groupBy("rater", (F.col("p") + 1).alias("question")).agg(
        *[F.count_if(F.col("x") == v).alias(f"{v}_count") for v in ("yes", "no", "uncertain")], F.count_if(F.col("x") != "yes").alias("non_yes_count"))


cte("files", """SELECT event_id AS file, user_id % 6 AS batch, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS rater,
  CASE event_type WHEN 'error' THEN 'in_progress' WHEN 'view' THEN 'not_applicable' ELSE 'complete' END AS status, sha256((user_id % 6)::VARCHAR || '/' || (CASE WHEN user_id % 6 = 4 AND value > 100 THEN 1 ELSE 0 END)::VARCHAR) AS fingerprint FROM events""")
cte("states", """SELECT batch, rater, count(DISTINCT fingerprint) FILTER (status = 'complete') AS variants, count(*) FILTER (status = 'complete') AS complete_files, count(*) FILTER (status = 'in_progress') AS in_progress,
  count(*) FILTER (status = 'not_applicable') AS not_applicable, CASE WHEN count(DISTINCT fingerprint) FILTER (status = 'complete') > 1 THEN 'conflicting_complete_results'
  WHEN count(*) FILTER (status = 'complete') > 1 THEN 'complete_with_duplicates' WHEN count(*) FILTER (status = 'complete') = 1 THEN 'complete' WHEN count(*) FILTER (status = 'not_applicable') > 0 THEN 'not_applicable' ELSE 'pending' END AS state,
  CASE WHEN count(DISTINCT fingerprint) FILTER (status = 'complete') = 1 THEN min(file) FILTER (status = 'complete') END AS chosen FROM files GROUP BY 1, 2""", "files")


def files(spark, sf):
    e = table(spark, sf, "events")
    b = F.col("user_id") % 6
    content = F.concat_ws("/", b.cast("string"), F.when((b == 4) & (F.col("value") > 100), 1).otherwise(0).cast("string"))
    return e.select(F.col("event_id").alias("file"), b.alias("batch"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("rater"),
                    F.when(F.col("event_type") == "error", "in_progress").when(F.col("event_type") == "view", "not_applicable").otherwise("complete").alias("status"),
                    F.sha2(content, 256).alias("fingerprint"))


@query("answer_files", with_("states", "SELECT * FROM states"))
def answer_files(spark, sf):
    return ev.resolve_answer_files(files(spark, sf))


@query("gated_statistics", with_("states accepts", """SELECT g.coverage_complete, pending, CASE WHEN coverage_complete THEN n END AS n, CASE WHEN coverage_complete THEN both_yes END AS both_yes FROM (
  SELECT bool_and(coalesce(starts_with(state, 'complete'), false)) AS coverage_complete, count(*) FILTER (NOT coalesce(starts_with(state, 'complete'), false)) AS pending
  FROM (SELECT unnest(range(6)) AS batch) b CROSS JOIN (VALUES ('A'), ('B')) r(rater) LEFT JOIN states s ON s.batch = b.batch AND s.rater = r.rater) g,
  (SELECT count(*) AS n, count(*) FILTER (a = 'yes' AND b = 'yes') AS both_yes FROM accepts)"""))
def gated_statistics(spark, sf):
    stats = ev.accept_overlap(accepts(spark, sf), []).select("n", "both_yes")
    return ev.gate(stats, ev.resolve_answer_files(files(spark, sf)), batches=6, raters=("A", "B"))


@query("batch_summary", with_("accepts", """SELECT source, count(*) AS denominator, count(*) FILTER (a <> 'uncertain') AS reviewed, count(*) FILTER (a = 'uncertain') AS pending, count(*) FILTER (a = 'yes') AS passed,
  count(*) FILTER (a <> 'uncertain') = count(*) AS complete, CASE WHEN count(*) FILTER (a <> 'uncertain') = count(*) THEN count(*) FILTER (a = 'yes') / count(*)::DOUBLE END AS rate,
  CASE WHEN count(*) FILTER (a <> 'uncertain') = count(*) THEN count(*) FILTER (a = 'yes') * 100 >= count(*) * 85 END AS meets_target FROM accepts GROUP BY source"""))
def batch_summary(spark, sf):
    n, done, good = F.count(F.lit(1)), F.count_if(F.col("a") != "uncertain"), F.count_if(F.col("a") == "yes")
    rows = accepts(spark, sf).groupBy("source").agg(n.alias("denominator"), done.alias("reviewed"), good.alias("passed"))
    full = F.col("reviewed") == F.col("denominator")
    return rows.select("source", "denominator", "reviewed", (F.col("denominator") - F.col("reviewed")).alias("pending"), "passed", full.alias("complete"),
                       F.when(full, F.col("passed") / F.col("denominator")).alias("rate"),
                       F.when(full, F.col("passed") * 100 >= F.col("denominator") * 85).alias("meets_target"))


@query("usage_rollup", """SELECT user_id AS source_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS retries, sum(floor(value))::BIGINT AS tokens, count(*) FILTER (event_type = 'view') AS unknown_usage,
  CASE WHEN user_id % 3 > 0 THEN sum(floor(value))::BIGINT * 2 END AS known_cost, user_id % 3 > 0 AND count(*) FILTER (event_type = 'view') = 0 AS total_cost_known FROM events GROUP BY user_id""")
def usage_rollup(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "source_id")
    rows = e.groupBy("source_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("retries"),
                                      F.sum(F.floor("value")).alias("tokens"), F.count_if(F.col("event_type") == "view").alias("unknown_usage"))
    priced = F.col("source_id") % 3 > 0
    return rows.withColumn("known_cost", F.when(priced, F.col("tokens") * 2)).withColumn("total_cost_known", priced & (F.col("unknown_usage") == 0))


@query("auc", """SELECT lang, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (2 * below + q)) / (sum(p) * sum(q) * 2)::DOUBLE END AS auc FROM (
  SELECT *, coalesce(sum(q) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT lang, n_chars, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS q
  FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)) GROUP BY lang""")
def auc(spark, sf):
    d = documents(spark, sf).where("quality IS NOT NULL").withColumn("good", F.col("quality") == 1)
    return ev.auc(d, ["lang"], "n_chars", "good", block=sc.by_rows("n_chars", 256))


@query("top_k_pass", """SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS passed FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)) WHERE r <= 5 GROUP BY lang""")
def top_k_pass(spark, sf):
    from pyspark.sql import Window
    d = documents(spark, sf).where("quality IS NOT NULL")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return d.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("passed"))


LVL = "greatest(-120.0::DOUBLE, log10(greatest({x}, 1e-6::DOUBLE)) * 20)"
cte("frames", f"""SELECT source_id, frame, round_even({LVL.format(x='rms')} * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS rms_db, round_even({LVL.format(x='peak')} * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS peak_db FROM (
  SELECT user_id AS source_id, event_id // 400 AS frame, sqrt((sum(round_even((value * 0.001::DOUBLE) * (value * 0.001::DOUBLE) * 1e9::DOUBLE, 0)::BIGINT)::BIGINT / 1e9::DOUBLE) / count(*)) AS rms, max(abs(value * 0.001::DOUBLE)) AS peak FROM events GROUP BY 1, 2)""")


def level_frames_(spark, sf):
    s = table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("i"), (F.col("value") * 0.001).alias("x"))
    return ev.level_frames(s, size=400)


@query("level_frames", with_("frames", "SELECT * FROM frames"))
def level_frames(spark, sf):
    return level_frames_(spark, sf)


@query("baseline_levels", with_("frames", """SELECT source_id, coalesce(round_even(median(rms_db) FILTER (rms_db > -60) * 1e6::DOUBLE, 0) / 1e6::DOUBLE, -120.0::DOUBLE) AS baseline_db FROM frames GROUP BY 1"""))
def baseline_levels(spark, sf):
    return ev.baseline_level(level_frames_(spark, sf))


@query("window_levels", with_("frames ivals", """SELECT i.source_id, i.event_id, coalesce(max(rms_db), -120.0::DOUBLE) AS peak_rms_db, coalesce(max(peak_db), -120.0::DOUBLE) AS sample_peak_db, count(f.frame) AS frames
  FROM ivals i LEFT JOIN frames f ON f.source_id = i.source_id AND i.start_ms <= f.frame * 3600000 + 1800000 AND f.frame * 3600000 + 1800000 < i.end_ms GROUP BY 1, 2"""))
def window_levels(spark, sf):
    return ev.window_levels(tb.intervals(spark, sf), level_frames_(spark, sf), "event_id", frame_ms=3_600_000)
