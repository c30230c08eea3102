"""Named scorers: transforms from a feature table to a scored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import windows

Scorer = Callable[[DataFrame], DataFrame]
REQUIRED = ("source_id", "start_ms", "end_ms", "score")


class ScorerRegistry:
    def __init__(self):
        self._scorers: dict[str, Scorer] = {}

    def register(self, name: str, scorer: Scorer) -> None:
        if not name.strip() or not callable(scorer):
            raise ValueError("a scorer needs a name and a function")
        if name in self._scorers:
            raise ValueError(f"scorer already registered: {name}")
        self._scorers[name] = scorer

    def apply(self, name: str, features: DataFrame) -> DataFrame:
        if name not in self._scorers:
            raise ValueError(f"unknown scorer: {name}")
        scored = self._scorers[name](features)
        missing = [c for c in REQUIRED if c not in scored.columns]
        if missing:
            raise ValueError(f"scorer {name} lacks columns: {missing}")
        return scored


def default_registry() -> ScorerRegistry:
    registry = ScorerRegistry()
    registry.register("rule", windows.score_rule)
    return registry
