"""Ceilings on queries: how costly their shape may be, and how often they may come."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from trellis.errors import LimitExceededError
from trellis.plans import ast as A
from trellis.plans.parser import parse

#: Points of a clause or part.
_POINTS = {A.Match: 2, A.Unwind: 1, A.Projection: 1, A.CallProcedure: 2, A.Create: 2, A.SetClause: 2, A.Delete: 2, A.Merge: 4, A.Foreach: 3, A.RelPattern: 2, A.Exists: 3, A.PatternComprehension: 3, A.Comprehension: 1, A.Reduce: 1}


def complexity(query: str) -> int:
    """Points of a query: clauses, hops, sub-queries; a hop of variable length counts its hops, unbounded ones twenty."""
    total = 0
    for n in A.walk(parse(query).statements):
        total += next((p for kind, p in _POINTS.items() if isinstance(n, kind)), 0)
        if isinstance(n, A.RelPattern) and n.length is not None:
            total += 2 * (n.length[1] if n.length[1] is not None else 20)
        if isinstance(n, A.Match) and len(n.paths) > 1:
            total += 5 * (len(n.paths) - 1)
    return total


@dataclass
class Limits:
    """``rate`` queries a second on average, ``burst`` at once; ``most`` points of complexity."""

    most: int | None = None
    rate: float | None = None
    burst: int = 10
    clock: Callable[[], float] = time.monotonic
    _tokens: float = field(default=-1.0, init=False)
    _at: float = field(default=0.0, init=False)

    def check(self, query: str) -> None:
        if self.most is not None and (points := complexity(query)) > self.most:
            raise LimitExceededError(f"the query has {points} points of complexity, over {self.most}")
        if self.rate is not None:
            now = self.clock()
            self._tokens = float(self.burst) if self._tokens < 0 else min(float(self.burst), self._tokens + (now - self._at) * self.rate)
            self._at = now
            if self._tokens < 1:
                raise LimitExceededError(f"more than {self.rate} queries a second")
            self._tokens -= 1
