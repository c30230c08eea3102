"""Conversation repair against all cheapest edit strings of a plain search, and the query on damaged rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import conversations, four_russians as fr
from spanloom.llm.queries import QUERIES

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """Cost and ASCII-least audit by best-first search over (cost, audit), without automaton tables."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles[-1:], len(roles) > 0) in seen:
            continue
        seen.add((i, roles[-1:], len(roles) > 0))
        if i == len(symbols) and GOOD.fullmatch(roles):
            return cost, audit
        def push(c, letter, j, made):
            if re.fullmatch(r"s?(ua)*u?", roles + made):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + made))
        for r in "ua":
            push(3, "I", i, r)
        if i < len(symbols):
            role, fault = symbols[i]
            push(4, "D", i + 1, "")
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                push(extra, "K", i + 1, role)
                for r in "ua":
                    push(3 + extra, "R", i + 1, r)
    raise AssertionError


def digit(role, fault):
    return str(fr.GONE) if fault in ("blank", "duplicate") else str(2 * "suax".index(role if role in "sua" else "x") + (fault == "truncated"))


def test_blocks_give_the_least_of_the_cheapest_edits():
    rng = random.Random(1)
    for n in [*range(9), *[rng.randrange(9, 40) for _ in range(300)]]:
        rows = [(rng.choice("suuaaax"), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
        symbols = "".join(digit(*r) for r in rows)
        made, _ = fr.trace(symbols, 0, 0, True)
        to, add = fr.transfer(symbols)
        cost, audit = cheapest(rows)
        assert made.translate(fr.TO_AUDIT) == audit
        assert add[0] + fr.tables()[0][to[0]][0] == cost


def expected(rows):
    """The query's rows by loops over (conv_id, turn, role, text)."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        out[conv] += [((turn is not None, turn or 0), role, digest, copy, turn, text) for copy in range(2 if kind == 3 else 1)]
    result = []
    for conv, items in out.items():
        seen, marks = set(), []
        items.sort(key=lambda x: x[:4])
        for _, role, _, _, turn, text in items:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            marks.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(x[1][:1] or "x", m) for x, m in zip(items, marks)])
        lines, i, state = [], 0, ""
        for letter in audit:
            want = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(want + ":")
                state = want[0]
                continue
            if letter != "D":
                role = want if letter == "R" else items[i][1]
                lines.append(f"{role}:{items[i][5]}")
                state = role[0]
            i += 1
        turns = {x[4] for x in items if x[4] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(items, items[1:])]
        result.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
                       sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return result


def rows_of(rng, n):
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t\n", None, "a.b", "So it is. ", "x\n\n", "Ünï.\x0b", "\x85", "end. ", "?" * 3000, "long word " * 4000]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "ux"]
    return [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice(roles[: rng.choice([3, 9])]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("piece_rows", [65_536, 40])
def test_query_equals_loops_also_with_split_conversations(spark, tmp_path, monkeypatch, piece_rows):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece_rows)
    rng = random.Random(2)
    rows = rows_of(rng, 500) + [(7, i, rng.choice(["user", "assistant", "system"]), f"turn {i // 2}" + rng.choice([".", ""])) for i in range(900)]
    rows += [(8, 1, "user", "Same.")] * 50 + [(-3, 2, "user", "One."), (-3, -2, "assistant", "Two.")]
    schema = "conv_id long, turn long, role string, text string, copy string, pos string, conv string, fault string, made string"
    spark.createDataFrame([(*r, *"abcde") for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(expected(rows), key=key)


def test_repaired_turns_follow_the_pattern(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 300)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in sorted(conversations.repair(df).collect(), key=lambda r: (r["pos"], r["part"])):
        found.setdefault(r["conv_id"], []).append(r["role"][:1])
    assert found and all(GOOD.fullmatch("".join(v)) for v in found.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_conversation_repair"](spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(11, 9, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_conversation_repair"](spark, str(tmp_path)).count() == 1
