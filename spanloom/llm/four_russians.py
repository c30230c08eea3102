"""Cheapest edits of a symbol string to ``(s?(ua)+)?`` by tables over blocks of symbols.

A cost vector gives, for each state of the automaton, the cost of the cheapest way to the end. Less its minimum it is
one of a few dozen vectors, so the vector before a block of symbols follows from the vector behind it by one look-up
in a table that is computed once for all blocks. Blocks are processed from the end of the string to its start; then
each is expanded backward from the vector behind it, and walked forward along the first letter that keeps the cost,
which gives the ASCII-least of the cheapest edit strings. Every expansion is kept for the next equal block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4
# Symbols: role class (s, u, a, other) times 2, plus 1 if truncated; GONE must be deleted.
SYMBOLS, GONE = 9, 8
# States: nothing yet, behind s, behind u, behind a. Roles that may follow, and the state behind a made role.
FOLLOW = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
MADE = (("U", "u", 2), ("U", "u", 2), ("A", "a", 3), ("U", "u", 2))
TO_AUDIT = str.maketrans("UAuakd", "IIRRKD")
Vector = tuple[int, int, int, int]


def _inserted(costs: list[int]) -> Vector:
    for _ in range(3):
        costs = [min(c, INSERT + costs[MADE[s][2]]) for s, c in enumerate(costs)]
    return tuple(costs)


END: Vector = _inserted([0, 1 << 20, 1 << 20, 0])


def _options(after: Vector, symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter of the edit, cost to the end and next state, for the edits that use up the symbol; ASCII order of the audit."""
    out = [("d", DELETE + after[state], state)]
    if symbol != GONE:
        role, extra = symbol // 2, TRUNCATED * (symbol % 2)
        if role in FOLLOW[state]:
            out.append(("k", extra + after[FOLLOW[state][role]], FOLLOW[state][role]))
        _, letter, new = MADE[state]
        out.append((letter, REROLE + extra + after[new], new))
    return out


def before(after: Vector, symbol: int) -> Vector:
    return _inserted([min(c for _, c, _ in _options(after, symbol, s)) for s in range(4)])


@lru_cache(maxsize=1)
def tables() -> tuple[list[Vector], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Normalised vectors, and for 1, 2 and ``BLOCK`` symbols the vector before and the cost to add."""
    vectors, number = [END], {END: 0}
    to, add = [], []
    for v in vectors:
        row_to, row_add = [], []
        for symbol in range(SYMBOLS):
            costs = before(v, symbol)
            least = min(costs)
            plain = tuple(c - least for c in costs)
            if plain not in number:
                number[plain] = len(vectors)
                vectors.append(plain)
            row_to.append(number[plain])
            row_add.append(least)
        to.append(row_to)
        add.append(row_add)
    out = {1: (np.array(to), np.array(add))}
    size = 1
    while size < BLOCK:
        t, a = out[size]
        # The later half of the block comes first: code = earlier * SYMBOLS ** size + later.
        later = np.tile(np.arange(t.shape[1]), t.shape[1])
        earlier = np.repeat(np.arange(t.shape[1]), t.shape[1])
        middle = t[:, later]
        out[2 * size] = (t[middle, earlier], a[:, later] + a[middle, earlier])
        size *= 2
    return vectors, out


def blocks(symbols: str) -> list[tuple[int, int]]:
    """(length, code) of the blocks of a digit string; a rest shorter than a block is single symbols at the end."""
    whole = len(symbols) // BLOCK * BLOCK
    return [(BLOCK, int(symbols[i:i + BLOCK], SYMBOLS)) for i in range(0, whole, BLOCK)] + [(1, int(c)) for c in symbols[whole:]]


def transfer(symbols: str) -> tuple[np.ndarray, np.ndarray]:
    """Vector before the string and cost to add, for every vector that may stand behind it."""
    vectors, step = tables()
    now, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for size, code in reversed(blocks(symbols)):
        total += step[size][1][now, code]
        now = step[size][0][now, code]
    return now, total


@lru_cache(maxsize=1 << 18)
def expand(behind: int, size: int, code: int, state: int) -> tuple[str, int]:
    """Edits of a block entered in ``state`` with vector ``behind`` after it, and the state it leaves in."""
    symbols = [code // SYMBOLS ** i % SYMBOLS for i in range(size - 1, -1, -1)]
    costs = [tables()[0][behind]]
    for symbol in reversed(symbols):
        costs.append(before(costs[-1], symbol))
    costs.reverse()
    out, i = [], 0
    while i < size:
        best = costs[i][state]
        first, *rest = _options(costs[i + 1], symbols[i], state)
        insert = (MADE[state][0], INSERT + costs[i][MADE[state][2]], MADE[state][2])
        letter, _, state = next(o for o in (first, insert, *rest) if o[1] == best)
        out.append(letter)
        i += letter not in "UA"
    return "".join(out), state


def trace(symbols: str, behind: int, state: int, last: bool) -> tuple[str, int]:
    """Edits of a whole piece: U and A insert, u and a rerole, k keeps, d deletes; and the state behind it."""
    parts, rights = blocks(symbols), [behind]
    step = tables()[1]
    for size, code in reversed(parts):
        rights.append(int(step[size][0][rights[-1], code]))
    out = []
    for (size, code), right in zip(parts, rights[-2::-1]):
        made, state = expand(right, size, code, state)
        out.append(made)
    while last and END[state]:
        letter, _, state = MADE[state]
        out.append(letter)
    return "".join(out), state
