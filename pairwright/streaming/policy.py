"""How many comparisons to release at a time."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass
class Fixed:
    """Comparison-budget mode: K for each increment."""

    k: int

    def next(self) -> int:
        return self.k


@dataclass
class Adaptive:
    """K follows the rates: it grows by one while profiles arrive more slowly than comparisons are served, and shrinks by one
    otherwise; it never falls under 1 nor, while several comparisons fit between two arrivals, goes over that number. Once the
    input has ended it stays at the greatest K so far. Times are means of the last `window` intervals, in seconds."""

    window: int = 1000
    k: int = 1
    most: int = 1
    ended: bool = False
    arrivals: deque = field(default_factory=deque)
    services: deque = field(default_factory=deque)
    demands: deque = field(default_factory=deque)

    def _add(self, held: deque, seconds: float) -> None:
        held.append(seconds)
        if len(held) > self.window:
            held.popleft()

    def arrived(self, seconds: float) -> None:
        self._add(self.arrivals, seconds)

    def served(self, seconds: float) -> None:
        self._add(self.services, seconds)

    def demanded(self, seconds: float) -> None:
        self._add(self.demands, seconds)

    def next(self) -> int:
        if self.ended:
            return self.most
        mean = lambda held: sum(held) / len(held) if held else 0.0
        slowest, gap = max(mean(self.services), mean(self.demands)), mean(self.arrivals)
        if slowest > 0:
            ratio = gap / slowest
            self.k = max(1, self.k + (1 if ratio > 1 else -1))
            if int(ratio) >= 1:
                self.k = min(self.k, int(ratio))
        self.most = max(self.most, self.k)
        return self.k
