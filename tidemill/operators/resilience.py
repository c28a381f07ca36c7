"""Error categories, retries, a circuit breaker, and the figures of running jobs."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The vendor's codes by category.
TRANSIENT = [-2147483647, -2147483644]
AMBIGUOUS = [-2147483636, -2147483627]
PERMANENT = [
    0, -1,
    -2147483646, -2147483645, -2147483643, -2147483642, -2147483641, -2147483640, -2147483639, -2147483638, -2147483637, -2147483635, -2147483634, -2147483633, -2147483632,
    -2147483631, -2147483630, -2147483629, -2147483628, -2147483626, -2147483625, -2147483624, -2147483623, -2147483622, -2147483621, -2147483620, -2147483619, -2147483618,
    -2147483617, -2147483616,
    -2147483393, -2147483392, -2147483391, -2147483390, -2147483389,
]


def error_category(code: Column) -> Column:
    """transient, ambiguous, permanent or unknown; null codes are unknown."""
    return F.when(code.isin(*TRANSIENT), "transient").when(code.isin(*AMBIGUOUS), "ambiguous").when(code.isin(*PERMANENT), "permanent").otherwise("unknown")


def category_of(code: int) -> str:
    if code in TRANSIENT:
        return "transient"
    if code in AMBIGUOUS:
        return "ambiguous"
    return "permanent" if code in PERMANENT else "unknown"


@dataclass
class Retry:
    """Attempts and first delay (s) by category; other categories are never tried again."""

    plans: dict = field(default_factory=lambda: {"transient": (5, 30.0), "ambiguous": (3, 60.0)})
    factor: float = 2.0
    cap: float = 600.0
    jitter: float = 0.2
    sleep: Callable[[float], None] = time.sleep

    def delay(self, base: float, attempt: int) -> float:
        return min(base * self.factor ** (attempt - 1), self.cap) * (1 + random.uniform(-self.jitter, self.jitter))

    def run(self, job: Callable, category: Callable[[Exception], str]):
        attempt = 1
        while True:
            try:
                return job()
            except Exception as e:
                most, base = self.plans.get(category(e), (1, 0.0))
                if attempt >= most:
                    raise
                self.sleep(self.delay(base, attempt))
                attempt += 1


class CircuitOpen(RuntimeError):
    pass


class CircuitBreaker:
    """Opens after ``threshold`` failures within ``window`` seconds; one trial call after ``cooldown`` closes it or doubles the wait."""

    def __init__(self, threshold: int = 10, window: float = 300.0, cooldown: float = 600.0, longest: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.threshold, self.window, self.base, self.longest, self.clock = threshold, window, cooldown, longest, clock
        self.cooldown, self.failures, self.opened = cooldown, deque(), None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.cooldown else "open"

    def call(self, job: Callable):
        state = self.state
        if state == "open":
            raise CircuitOpen(f"closed to calls for {self.cooldown - (self.clock() - self.opened):.0f} s")
        try:
            out = job()
        except Exception:
            now = self.clock()
            self.failures.append(now)
            while self.failures and now - self.failures[0] > self.window:
                self.failures.popleft()
            if state == "half_open":
                self.cooldown, self.opened = min(self.cooldown * 2, self.longest), now
            elif len(self.failures) >= self.threshold:
                self.opened = now
            raise
        if state == "half_open":
            self.opened, self.cooldown = None, self.base
            self.failures.clear()
        return out


def best_of(fetch: Callable[[], tuple], enough: float = 99.99, retries: int = 2):
    """Fetches again while the completeness of (rows, percent) is too low, and keeps the best."""
    best = fetch()
    for _ in range(retries):
        if best[1] >= enough:
            break
        best = max(best, fetch(), key=lambda x: x[1])
    return best


def split_evenly(chunks: DataFrame, days: DataFrame, by: list[str]) -> DataFrame:
    """A chunk's ``trades_count`` over its days (``chunk_date``): equal parts, the remainder on the last day."""
    w = Window.partitionBy(*by)
    rows = chunks.join(days, by).withColumns({"n": F.count("*").over(w), "last": F.max("chunk_date").over(w)})
    part = F.expr("trades_count div n")
    return rows.select(*by, "chunk_date", (part + F.when(F.col("chunk_date") == F.col("last"), F.col("trades_count") - part * F.col("n")).otherwise(0)).alias("trades_count"))


def progress(total: Column, done: Column, trades: Column, elapsed_s: Column) -> dict[str, Column]:
    """Trades a second, chunks an hour and the seconds left; null where nothing has been done yet."""
    some = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    return {"trades_per_s": trades / some(elapsed_s), "chunks_per_h": done * 3600.0 / some(elapsed_s), "eta_s": (total - done) * elapsed_s / some(done)}
