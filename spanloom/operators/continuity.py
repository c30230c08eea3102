"""Paired discourse constructions between neighbouring units, and what they leave open.

A construction at the end of one unit (an intent, a cause, a slot without its complement) asks for a continuation at
the head of the next. Found, it is a link; missing, an open edge if the construction cannot stand alone, else an
ambiguity. Text inside quotations, also in those that began in an earlier unit, is masked.

Some rules ask whether a unit belongs to an answer. That is an automaton over the units of a source with two states,
idle and active: a response or a reason activates the next unit, a link of an active unit carries on, a topic switch
ends it. Each unit is a map of the two states and ``scan.automaton`` composes the maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import brackets, discourse as dc, scan as sc

KEY = ["source_id"]
CLAUSE_CHARS = 256

# Surface patterns.
CAUSE = r"(?i)^(?:因为|由于|because\b)\s*(.+)$"
INLINE_RESULT = r"(?i)(?:所以|因此|因而|于是|导致|以至于|结果(?:是|就)|so\b|therefore\b)"
RESULT = r"(?i)^(?:所以|因此|因而|于是|导致|结果是|therefore\b|so\b)[，,\s]*(.+)$"
REASON = r"(?i)^(?:(?:我觉得|我认为)[，,\s]*)?(?:是因为|主要原因是|原因是|因为|由于|because\b)[，,\s]*(.+)$"
INTENT = (r"(?:我|我们)(?:(?:就|会|还|也|其实|很|蛮|仍然|一直|比较|挺|特别|非常|确实|有点)){0,4}"
          r"(?:好奇|想知道|想问)([^。！？!?；;\n]{1,80})$")
ASPECT = (r"(?:(?:我们|你们|他们|她们|它们|我|你|您|他|她|它|大家)(?:(?:目前|现在|最近|主要|就|也|还|一直|其实|可能)){0,3}|^)"
          r"在[^。！？!?；;，,\n]{1,24}(?:方面|上面)$")
PREDICATE = (r"^(?:得(?:了|到)|遇(?:到|见)|有(?:了|一些|些)|获得|面临|产生|受(?:到)|变(?:得|成)|出现|增加|减少|感觉|发现|经历|"
             r"需要|可以|能够|不能|会|没法|无法)")
COPULA = r"就是$"
CONTRAST = r"反而$"
CONTRAST_HEAD = r"^(?:不|没|更|会|是|影响|让|导致|增加|减少|变|获得|失去)"
ENUMERATED_REASON = r"^(?:另外一个|另一个|另一方面|还有一个原因|第二个原因|另外一点)(?:是|原因是|就是)(.+)$"
CONTRAST_REASON = r"^(?:但是|但|不过)因为(.+)$"
META = r"(?i)^(?:这个词|这句话|的意思|这个说法|这个表达|the word\b|the phrase\b)"
NEGATED_INTENT = r"(?:并不|不再|不是|没有|无需|不必|不用)[^。！？!?；;\n]{0,12}$"
SETTLED = (r"(?i)(?:但|不过|后来|而)[^。！？!?；;\n]{0,24}(?:已经|早已|都|也)?(?:查清|知道|明白|弄清|了解|解决)|"
           r"(?:(?:答案是|原因是|是因为|因为)(?!(?:什么|啥|何|哪))|because\b(?!\s+(?:what|why)\b)|the answer is\b(?!\s+what\b))")
DEFINITION = r"就是[^。！？!?；;，,\n]{0,60}(?:一些|几个|这些|那些)([^。！？!?；;，,\n]{1,20})$"
FINITE_HEAD = r"(?:了|过|着|已经|但是|然后|所以|因为|表示|认为|说)$"
DEFINES = r"^是(?!(?:的|啊|呀|吧|吗|新话题|另一个话题)(?:[。！？!?；;，,\s]|$))(.+)$"
RANGE_QUESTION = r"(?i)(?:哪(?:个|一)?(?:方面|领域|范围|方向|部分)|where\b)"
FILLER = r"(?i)^(?:嗯|呃|额|啊|唔|um|uh|erm)[。！？!?；;，,\s]*$"
TERMINAL = r"[。！？!?；;.]\s*$"
QUOTED_TARGETS = ("这个词", "这句话", "这个说法")
AGREEING_HEAD = r"^(?:是的|是啊|是呀)"
PARTICLES = "的了着是吧啊吗呢哦嗯呃额唔"
ENDING = r"[。！？!?；;.,， \t\r\n]+"

# What a construction becomes.
LINK, OPEN, AMBIGUOUS = "link", "open_edge", "ambiguity"


def like(text: Column, pattern: str) -> Column:
    """Match with letters, spaces and word edges of all scripts."""
    return F.coalesce(text.rlike("(?Ud)" + pattern), F.lit(False))


def group(text: Column, pattern: str, number: int = 1) -> Column:
    return F.regexp_extract(text, "(?Ud)" + pattern, number)


def masked(units: DataFrame, *, block: int = brackets.BLOCK) -> DataFrame:
    """``source_id, pos, text, m``: ``m`` is the text with everything inside quotations as spaces, line feeds kept."""
    marks = brackets.depths(dc.quotation_marks(units), len(dc.OPENING), {dc.OPENING.index(q) for q in "\"'"}, block=block)
    per_unit = marks.groupBy("source_id", F.col("unit").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("at", "before", "after", "lone"))).alias("marks"), F.max_by("after", "at").alias("left"))
    rows = units.select("source_id", "pos", "text").join(per_unit, ["source_id", "pos"], "left")
    rows = sc.scan(rows, KEY, ["pos"], sc.by_rows("pos"), _left=sc.latest(F.col("left"), inclusive=False)).withColumn("depth", F.coalesce("_left", F.lit(0)))
    chars, k = F.split("text", ""), F.size("marks")
    blank = lambda t: F.regexp_replace(t, "[^\n]", " ")
    between = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")

    def piece(i: Column) -> Column:
        before, here = F.get("marks", i - 1), F.get("marks", i)
        text = between(F.when(i == 0, 0).otherwise(before["at"] + 1).cast("int"), F.when(i == k, F.size(chars)).otherwise(here["at"]).cast("int"))
        text = F.when(F.when(i == 0, F.col("depth")).otherwise(before["after"]) > 0, blank(text)).otherwise(text)
        shown = (here["before"] == 0) & (here["after"] == 0) & ~here["lone"]
        mark = F.when(i == k, "").when(shown, F.get(chars, here["at"].cast("int"))).otherwise(" ")
        return F.concat(text, mark)

    whole = F.when(F.col("marks").isNull(), F.when(F.col("depth") > 0, blank(F.col("text"))).otherwise(F.col("text"))).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), k), piece), ""))
    return rows.select("source_id", "pos", "text", whole.alias("m"))


def bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^{ENDING}", ""), rf"{ENDING}\z", "")


def substantive(text: Column, single: bool = False) -> Column:
    """Two letters or digits at least (or one Han character that is no particle), no filler, no talk about words."""
    content = F.regexp_replace(bare(text), r"[^\p{L}\p{N}_]", "")
    enough = F.length(content) >= 2
    if single:
        enough = enough | (content.rlike("^[\u3400-\u9fff]$") & ~content.rlike(f"[{PARTICLES}]"))
    return enough & ~like(bare(text), FILLER) & ~like(bare(text), META)


def continuity(units: DataFrame, *, block: Column | str | None = sc.AUTO, fan: int = sc.FAN, marks: int = brackets.BLOCK) -> DataFrame:
    """``source_id, first_unit, last_unit, kind, status`` of all constructions.

    ``status`` is ``link`` (to ``last_unit``), ``open_edge`` or ``ambiguity`` (without ``last_unit``). Clauses of more
    than ``CLAUSE_CHARS`` characters are not parsed and give one ambiguity.
    """
    text = sc.cut(masked(units, block=marks))
    asked = dc.dependencies(units, block=block).where("kind = 'question_response' AND last_unit IS NOT NULL")
    asked = asked.join(text.select("source_id", F.col("pos").alias("first_unit"), "m"), ["source_id", "first_unit"]).groupBy(
        "source_id", F.col("last_unit").alias("pos")).agg(F.max(like(F.col("m"), RANGE_QUESTION)).alias("ranged"))
    near = sc.scan(text, KEY, ["pos"], block, _next=sc.following(F.struct("pos", "m"))).join(asked, ["source_id", "pos"], "left")

    near = near.withColumn("_body", F.regexp_replace("m", rf"{ENDING}\z", "")).withColumn("_prefix", F.regexp_extract("_body", r"(?s)^(.*[。！？!?；;\n])", 1))
    near = near.withColumn("_rest", F.expr("substring(_body, length(_prefix) + 1)")).withColumn("clause", F.regexp_replace("_rest", r"(?U)^\s+", "")).withColumn("head", F.substring(F.regexp_replace("_next.m", r"(?U)^\s+", ""), 1, CLAUSE_CHARS))
    clause, head, m = F.col("clause"), F.col("head"), F.col("m")
    near = near.select("source_id", "pos", "m", "ranged", "clause", "head", "_prefix", F.col("_next.pos").alias("next"), F.col("_next").isNull().alias("final"),
                       (F.length(clause) > CLAUSE_CHARS).alias("clipped"), (F.length("_prefix") + F.length("_rest") > F.length(clause)).alias("inset"))
    # What each construction needs of its clause and of the head behind it; stored, so that one plan does not hold all patterns.
    before = lambda pattern: F.regexp_replace(clause, pattern, "")
    near = sc.cut(near.select(
        "*", ((clause != "") & ~F.col("clipped")).alias("parsed"), (~F.col("final") & ~like(head, dc.NEW_TOPIC)).alias("goes_on"),
        F.coalesce(substantive(head) & ~like(head, META) & ~like(head, AGREEING_HEAD), F.lit(False)).alias("sound"),
        group(clause, INTENT).alias("target"), group(clause, rf"(?s)^(.*?)(?:{INTENT})").alias("led"), group(clause, CAUSE).alias("because"),
        like(head, CONTRAST_REASON).alias("contrast"), like(m, TERMINAL).alias("ended"),
        F.when(like(clause, ASPECT), "predicate_complement").when(like(clause, DEFINITION) & ~like(group(clause, DEFINITION), FINITE_HEAD), "definition_continuation")
        .when(like(clause, COPULA) & substantive(before(COPULA)), "copular_continuation").when(like(clause, CONTRAST) & substantive(before(CONTRAST)), "contrast_continuation").alias("slot")))
    fits = lambda pattern: F.col("goes_on") & F.col("sound") & like(head, pattern)
    full = lambda pattern: fits(pattern) & substantive(group(head, pattern), single=True)
    target, led, because = (F.col(c) for c in ("target", "led", "because"))
    near = sc.cut(near.select(
        "source_id", "pos", "next", "final", "clipped", "contrast", F.col("ranged").isNotNull().alias("answers"),
        (F.col("parsed") & like(clause, INTENT) & ~like(target, SETTLED) & ~like(led, NEGATED_INTENT) & substantive(target, single=True) & ~bare(target).isin(*QUOTED_TARGETS)).alias("intent"),
        full(REASON).alias("reason"), full(RESULT).alias("result"),
        (F.col("parsed") & like(clause, CAUSE) & F.col("inset") & dc.question_kind(F.trim("_prefix")).isNotNull()).alias("explained"),
        (F.col("parsed") & ~like(head, r"[?？]") & F.when(F.col("contrast"), full(CONTRAST_REASON)).otherwise(full(ENUMERATED_REASON))).alias("more"),
        (F.col("parsed") & like(clause, CAUSE) & substantive(because, single=True) & ~like(because, INLINE_RESULT) & ~F.col("ended")
         & ~like(F.regexp_replace(because, r"(?U)^\s+", ""), META)).alias("pending"),
        F.when(F.col("parsed"), F.col("slot")).alias("slot"),
        F.when(F.col("slot") == "predicate_complement", fits(PREDICATE)).when(F.col("slot") == "definition_continuation", full(DEFINES))
        .when(F.col("slot") == "copular_continuation", fits("")).when(F.col("slot") == "contrast_continuation", fits(CONTRAST_HEAD)).alias("filled"),
        F.when(F.col("slot") == "predicate_complement", F.coalesce("ranged", F.lit(False)) & F.col("ended")).otherwise(F.col("slot") == "definition_continuation").alias("alone"),
        (F.col("parsed") & like(clause, dc.NEW_TOPIC)).alias("switched")))
    names = ("final", "clipped", "contrast", "answers", "intent", "explained", "more", "pending", "filled", "alone", "switched")
    rows = near.select("source_id", "pos", "next", "slot", *[F.coalesce(c, F.lit(False)).alias(c) for c in names],
                       F.coalesce(F.col("intent") & F.col("reason"), F.lit(False)).alias("reason_why"), F.coalesce(F.col("pending") & F.col("result"), F.lit(False)).alias("resulting"))
    rows = sc.scan(rows, KEY, ["pos"], block, _reasoned=sc.previous(F.col("reason_why")))
    seeded = F.col("answers") | F.coalesce("_reasoned", F.lit(False))
    active = lambda carried: F.col("explained") | ((carried | seeded) & ~F.col("switched"))
    leads = lambda carried: F.when(F.when(active(carried), F.col("more") | F.col("filled")).otherwise(F.col("resulting")), "1").otherwise("0")
    run = sc.automaton(rows, KEY, ["pos"], F.concat(leads(F.lit(False)), leads(F.lit(True))), "0", 2, "_carried", fan=fan)
    on = active(F.col("_carried") == "1")
    found = lambda when, kind, status: F.when(when, F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), status.alias("status")))
    status = lambda linked, ambiguous: F.when(linked, LINK).when(ambiguous, AMBIGUOUS).otherwise(OPEN)
    kinds = F.filter(F.array(
        found(F.col("clipped"), "long_clause_not_parsed", F.lit(AMBIGUOUS)),
        found(F.col("intent"), "implicit_question_reason", status(F.col("reason_why"), ~F.col("final"))),
        found(on & F.col("more"), F.when(F.col("contrast"), "contrast_cause_continuation").otherwise("reason_enumeration"), F.lit(LINK)),
        found(~on & F.col("pending"), "cause_result", status(F.col("resulting"), F.lit(True))),
        found(F.col("slot").isNotNull(), F.col("slot"), status(F.col("filled"), F.col("alone")))), lambda k: k.isNotNull())
    each = run.select("source_id", F.col("pos").alias("first_unit"), "next", F.explode(kinds).alias("k"))
    return each.select("source_id", "first_unit", F.when(F.col("k.status") == LINK, F.col("next")).alias("last_unit"), "k.kind", "k.status")
