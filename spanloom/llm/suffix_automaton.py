"""Suffix automaton of several word sequences, with the least owner of every stretch."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """All stretches of the added sequences; each knows the least owner that holds it.

    States are classes of stretches with the same right contexts: ``length`` is the longest
    of the class, ``link`` the class of the longest suffix in another one.
    """

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.least: list[int | None] = [None]

    def add(self, sequence: Iterable[Hashable], owner: int) -> None:
        at = 0
        for symbol in sequence:
            at = self._grow(at, symbol)
            if self.least[at] is None or owner < self.least[at]:
                self.least[at] = owner

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.length) - 1

    def _split(self, source: int, symbol: Hashable, target: int) -> int:
        """The class of the stretches of ``target`` that end a stretch of ``source``."""
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._state(self.length[source] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while source >= 0 and self.step[source].get(symbol) == target:
            self.step[source][symbol] = copy
            source = self.link[source]
        return copy

    def _grow(self, at: int, symbol: Hashable) -> int:
        known = self.step[at].get(symbol)
        if known is not None:
            return self._split(at, symbol, known)
        new = self._state(self.length[at] + 1, {}, 0)
        while at >= 0 and symbol not in self.step[at]:
            self.step[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, symbol, self.step[at][symbol])
        return new

    def close(self) -> "SuffixAutomaton":
        """Hand the least owners down to the suffixes; call once after the last ``add``."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.least[s] is not None and (self.least[up] is None or self.least[s] < self.least[up]):
                self.least[up] = self.least[s]
        return self

    def statistics(self, sequence: Iterable[Hashable], most: int) -> Iterator[tuple[int, int | None]]:
        """For each position: length of the longest known stretch that ends there, cut at ``most``, and its least owner."""
        at, n = 0, 0
        step, link, length = self.step, self.link, self.length
        for symbol in sequence:
            while at and symbol not in step[at]:
                at = link[at]
                n = length[at]
            if symbol in step[at]:
                at = step[at][symbol]
                n += 1
            else:
                n = 0
            while at and length[link[at]] >= most:
                at = link[at]
            n = min(n, most)
            yield n, (self.least[at] if at else None)
