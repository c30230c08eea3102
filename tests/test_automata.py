"""Automata over blocks, bracket matching and the discourse rules against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import scan as sc
from spanloom.streaming import reviews as rv


def walked(events):
    """Job transitions of one task in order."""
    now, out = None, []
    for sequence, status in sorted(events):
        legal = now in rv.TRANSITIONS.get(status, ())
        out.append((sequence, status, now, legal))
        now = status if legal else now
    return out


@pytest.mark.parametrize("fan", [16, 512])
def test_states_before_rows_equal_a_walk(spark, monkeypatch, fan):
    monkeypatch.setattr(sc.automaton, "__kwdefaults__", {"fan": fan})
    rng = random.Random(fan)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(10 ** 12), rng.choice([*rv.TRANSITIONS, "QUEUED", "RUNNING", "odd", None])) for _ in range(700)]
    df = spark.createDataFrame(rows, "task_id long, sequence long, status string")
    got = sorted((tuple(r) for r in rv.job_states(df).collect()), key=str)
    want = [(k, *x) for k in (1, 2, None) for x in walked([(s, w) for t, s, w in rows if t == k])]
    assert got == sorted(want, key=str)
    assert rv.job_states(df.where("sequence < 0")).count() == 0


def test_blocks_by_counts_hold_at_most_so_many_rows_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2]), rng.choice([rng.randrange(5), rng.randrange(10 ** 15)]), i) for i in range(500)]
    got = sc.ranked(spark.createDataFrame(rows, "k long, a long, b long"), ["k"], ["a", "b"], 7).collect()
    assert len(got) == len(rows)
    sizes, last = {}, {}
    for r in sorted(got, key=lambda r: (r["k"], r["a"], r["b"])):
        sizes[r["k"], r["_block"]] = sizes.get((r["k"], r["_block"]), 0) + 1
        assert r["_block"] >= last.get(r["k"], -1)
        last[r["k"]] = r["_block"]
    assert max(sizes.values()) <= 7 and len(sizes) < 120


def plain_quotations(units):
    """The sequential stack rule over (unit, text) of one source."""
    from spanloom.operators.discourse import OPENERS, QUOTES

    mates = {c: o for o, c in OPENERS.items()} | {q: q for q in "\"'"}
    word = lambda c: c.isascii() and c.isalnum()
    stack, out = [], []
    for unit, text in units:
        for i, c in enumerate(text):
            if c not in QUOTES:
                continue
            before, after = text[i - 1:i] if i else "", text[i + 1:i + 2]
            single = c in "'‘’" and word(before)
            if single and word(after):
                continue
            if stack and stack[-1][0] == mates.get(c):
                opened = stack.pop()[1]
                if opened != unit:
                    out.append((opened, unit, "paired_quotation"))
            elif single and (not after or after in " \t\n\r\x0b\x0c"):
                continue
            elif c in OPENERS.values():
                out.append((None, unit, "quotation_missing_opener"))
            else:
                stack.append((c, unit))
    return out + [(u, None, "quotation_missing_closer") for _, u in stack]


@pytest.mark.parametrize("block", [2, 4096])
def test_quotations_equal_the_stack_rule(spark, block):
    from spanloom.operators import discourse as dc

    rng = random.Random(block)
    bits = ["“", "”", "‘", "’", "「", "」", "『", "』", '"', '"', "'", "'", "a", "b ", " ", "\n", "don't", "dogs' "]
    sources = {s: [(u, "".join(rng.choice(bits if s < 4 else bits[8:]) for _ in range(rng.randrange(9)))) for u in range(40)] for s in range(7)}
    sources[7] = [(u, "“" * 40) for u in range(4)] + [(9 + u, "”" * 30) for u in range(6)]
    rows = [(s, u, t) for s, v in sources.items() for u, t in v]
    df = spark.createDataFrame(rows, "source_id long, pos long, text string")
    got = [tuple(r) for r in dc.quotations(df, block=block).select("source_id", "first_unit", "last_unit", "kind").collect()]
    want = [(s, *x) for s, v in sources.items() for x in plain_quotations(v)]
    assert len(want) > 200 and sorted(got, key=str) == sorted(want, key=str)
    assert dc.quotations(df.where("pos < 0")).count() == 0


def plain_masks(texts):
    """Texts with everything inside quotations blanked, quotations running on over texts."""
    from spanloom.operators.discourse import OPENERS

    stack, out = [], []
    word = lambda c: c.isascii() and c.isalnum()
    for text in texts:
        shown = ""
        for i, c in enumerate(text):
            before, after = text[i - 1:i] if i else "", text[i + 1:i + 2]
            inside = bool(stack)
            closes = bool(stack) and stack[-1] == c
            apostrophe = c in "'‘’" and word(before) and (word(after) or not closes and (not after or after.isspace()))
            lone = False
            if not apostrophe:
                if closes:
                    stack.pop()
                elif c in OPENERS or c in "\"'":
                    stack.append(OPENERS.get(c, c))
                else:
                    lone = c in OPENERS.values()
            shown += "\n" if c == "\n" else " " if inside or stack or lone else c
        out.append(shown)
    return out


def plain_continuity(units):
    """The rules of ``continuity`` for one source, unit after unit."""
    import re

    from spanloom.operators import continuity as ct, discourse as dc

    search = lambda p, t: re.search(p, t)
    positions, shown = [u for u, _ in units], plain_masks([t for _, t in units])
    strip = lambda t: t.strip("。！？!?；;.,， \t\r\n")

    def solid(t, single=False):
        content = re.sub(r"\W", "", strip(t))
        one = single and re.fullmatch(r"[㐀-鿿]", content) and content not in ct.PARTICLES
        return bool((len(content) >= 2 or one) and not search(ct.FILLER, strip(t)) and not search(ct.META, strip(t)))

    def question(t):
        if search(r"[?？]$", t):
            return True
        clause = re.split(r"[。！？!?；;\n]", t)[-1].strip()
        if not t or search(dc.TERMINAL, t) or not clause or search(dc.INLINE_RESPONSE, clause):
            return False
        return any(search(p, clause) for p in (dc.QUESTION_PREFIX, dc.ADDRESSED_QUESTION, dc.QUESTION_TAIL, dc.ENGLISH_QUESTION))

    heads = [t.lstrip()[:256] for t in shown]
    asked = [question(re.sub(dc.CLOSERS, "", t.strip()).rstrip()) for _, t in units]
    out, active = [], set()
    ranged = {i + 1 for i in range(len(units) - 1) if asked[i] and search(ct.RANGE_QUESTION, shown[i])}
    active |= {i + 1 for i in range(len(units) - 1) if asked[i]}

    def fits(i, pattern, body):
        if i + 1 == len(units) or search(dc.NEW_TOPIC, heads[i + 1]):
            return False
        h = heads[i + 1]
        m = search(pattern, h)
        return bool(m and solid(h) and not search(ct.META, h) and not search(ct.AGREEING_HEAD, h) and (not body or solid(m[1], True)))

    def add(i, kind, linked, ambiguous):
        status = "link" if linked else "ambiguity" if ambiguous else "open_edge"
        out.append((positions[i], positions[i + 1] if linked else None, kind, status))
        return linked

    parts = []
    for t in shown:
        body = t.rstrip("。！？!?；;.,， \t\r\n")
        cut = max((m.end() for m in re.finditer(r"[。！？!?；;\n]", body)), default=0)
        while cut < len(body) and body[cut].isspace():
            cut += 1
        parts.append((body[:cut], body[cut:]))
    for i, (_, clause) in enumerate(parts):
        if len(clause) > 256:
            add(i, "long_clause_not_parsed", False, True)
            continue
        m = search(ct.INTENT, clause)
        if m and not search(ct.SETTLED, m[1]) and not search(ct.NEGATED_INTENT, clause[:m.start()]) and solid(m[1], True) and strip(m[1]) not in ct.QUOTED_TARGETS:
            if add(i, "implicit_question_reason", fits(i, ct.REASON, True), i + 1 < len(units)):
                active.add(i + 1)
    for i, (prefix, clause) in enumerate(parts):
        if not clause or len(clause) > 256:
            continue
        if search(dc.NEW_TOPIC, clause):
            active.discard(i)
        cause = search(ct.CAUSE, clause)
        if cause and prefix and question(prefix.strip()):
            active.add(i)
        on = i in active
        if on and i + 1 < len(units) and not search("[?？]", heads[i + 1]):
            contrast = search(ct.CONTRAST_REASON, heads[i + 1])
            if fits(i, ct.CONTRAST_REASON if contrast else ct.ENUMERATED_REASON, True):
                add(i, "contrast_cause_continuation" if contrast else "reason_enumeration", True, False)
                active.add(i + 1)
        if cause and not on and solid(cause[1], True) and not search(ct.INLINE_RESULT, cause[1]) and not search(ct.TERMINAL, shown[i]) and not search(ct.META, cause[1].lstrip()):
            if add(i, "cause_result", fits(i, ct.RESULT, True), True):
                active.add(i + 1)
        definition = search(ct.DEFINITION, clause)
        linked = None
        if search(ct.ASPECT, clause):
            linked = add(i, "predicate_complement", fits(i, ct.PREDICATE, False), i in ranged and bool(search(ct.TERMINAL, shown[i])))
        elif definition and not search(ct.FINITE_HEAD, definition[1]):
            linked = add(i, "definition_continuation", fits(i, ct.DEFINES, True), True)
        elif search(ct.COPULA, clause) and solid(re.sub(ct.COPULA, "", clause)):
            linked = add(i, "copular_continuation", fits(i, "^", False), False)
        elif search(ct.CONTRAST, clause) and solid(re.sub(ct.CONTRAST, "", clause)):
            linked = add(i, "contrast_continuation", fits(i, ct.CONTRAST_HEAD, False), False)
        if linked and on:
            active.add(i + 1)
    return out


@pytest.mark.parametrize("fan", [2, 512])
def test_continuity_equals_the_rules_unit_after_unit(spark, fan):
    from spanloom.operators import continuity as ct

    rng = random.Random(fan)
    ends = ["我想知道原因", "我不是我想知道原因", "我想知道但后来知道了", "我想知道因为什么", "我想知道这个词", "因为下雨", "为什么呢？因为下雨", "我们在工作方面", "这就是一些办法", "这就是那些说", "结果就是", "影响反而", "好", "嗯", "你在哪个方面？", "为什么？", "因为“下雨", "下面说", "x" * 300]
    heads = ["因为忙", "原因是这个说法", "所以停了", "另一个是钱", "但是因为钱", "遇到困难", "是的", "是好事", "不好", "下面说别的", "”后来", "It's", "「引", "」", "嗯。", "是的啊", ""]
    sources = {s: [(3 * u, rng.choice(heads) + rng.choice(["", "，", "。", "\n", " then "]) + rng.choice(ends) + rng.choice(["", "", "", "。", "\n"])) for u in range(60)] for s in range(16)}
    sources |= {s: [(u, "".join(c for c in t if s > 11 or c not in "“”「」")) for u, t in v] for s, v in sources.items()}
    df = spark.createDataFrame([(s, u, t) for s, v in sources.items() for u, t in v], "source_id long, pos long, text string")
    got = [tuple(r) for r in ct.continuity(df, fan=fan, marks=3 if fan == 2 else 4096).select("source_id", "first_unit", "last_unit", "kind", "status").collect()]
    want = [(s, *x) for s, v in sources.items() for x in plain_continuity(v)]
    assert len({x[3:] for x in want}) > 10 and sorted(got, key=str) == sorted(want, key=str)
