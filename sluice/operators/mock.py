"""Mock stage: a stand-in for a model, with declared substrings and confidences."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import gotext
from .stages import ConstantStage, Decided, Env


@dataclass(frozen=True)
class Outcome:
    category: str = ""
    confidence: float = 0.0


@dataclass(frozen=True)
class MockMatcher:
    contains: list[str]
    category: str = ""
    confidence: float = 0.0


class MockStage(ConstantStage):
    def __init__(self, matchers: list[MockMatcher] = (), default: Outcome | None = None, name: str = "mock"):
        if not matchers and default is None:
            raise ValueError("mock: at least one matcher or a default is required")
        for i, m in enumerate(matchers, 1):
            where = f"matcher {i}"
            if not m.contains:
                raise ValueError(f"mock: {where} ({m.category}): contains is required")
            if "" in m.contains:
                raise ValueError(f"mock: {where} ({m.category}): contains must not hold an empty string")
            self._check(where, m.category, m.confidence)
        if default is not None:
            self._check("default", default.category, default.confidence)
        self.matchers, self.default, self.name = list(matchers), default, name

    @staticmethod
    def _check(where: str, category: str, confidence: float) -> None:
        if not category or math.isnan(confidence) or not 0 <= confidence <= 1:
            raise ValueError(f"mock: {where}: category {gotext.quote(category)} with confidence {gotext.number(confidence)} is invalid")

    @staticmethod
    def _decided(category: str, confidence: float, name: str) -> Decided:
        return Decided(category, confidence, name, (("mock", f"mock score {gotext.number(confidence)} for {gotext.quote(category)}"),))

    def cases(self, env: Env, name: str) -> tuple[list[tuple[Column, Decided]], Decided | None]:
        hit = lambda m: reduce(lambda a, b: a | b, (F.coalesce(F.contains(env.text(), F.lit(n)), F.lit(False)) for n in m.contains))
        default = self._decided(self.default.category, self.default.confidence, name) if self.default else None
        return [(hit(m), self._decided(m.category, m.confidence, name)) for m in self.matchers], default
