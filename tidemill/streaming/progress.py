"""What watches and steers a running stream: progress events, a switch to pause or cancel, and metrics."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol


@dataclass(frozen=True)
class Event:
    """State after a batch; ``eta_s`` is None while the end is unknown."""

    done: int
    trades: int
    elapsed_s: float
    total: int | None = None
    eta_s: float | None = None


class Progress:
    """Counts batches and trades and tells observers, at most once every ``pause`` seconds and always when the total is reached.

    An observer that fails is dropped from the event only: the batch it was told of is committed already.
    """

    def __init__(self, total: int | None = None, pause: float = 0.5, clock: Callable[[], float] = time.monotonic):
        self.total, self.pause, self.clock = total, pause, clock
        self.begun, self.told, self.done, self.trades = clock(), None, 0, 0
        self.observers: list[Callable[[Event], None]] = []

    def observe(self, tell: Callable[[Event], None]) -> Callable[[], None]:
        """Adds an observer; the function that comes back takes it off."""
        self.observers.append(tell)
        return lambda: self.observers.remove(tell) if tell in self.observers else None

    def event(self) -> Event:
        spent = self.clock() - self.begun
        eta = None if self.total is None or not self.done else max(self.total - self.done, 0) * spent / self.done
        return Event(self.done, self.trades, spent, self.total, eta)

    def batch(self, trades: int) -> None:
        self.done, self.trades = self.done + 1, self.trades + trades
        now = self.clock()
        if self.told is None or now - self.told >= self.pause or self.done == self.total:
            self.told = now
            self.flush()

    def flush(self) -> None:
        """Tells the present state at once."""
        event = self.event()
        for tell in list(self.observers):
            try:
                tell(event)
            except Exception:  # the observer's own trouble
                continue


class Switch:
    """Pauses or cancels between batches: pass it as ``stop``.  A batch under way is always finished."""

    def __init__(self):
        self._go, self._off = threading.Event(), threading.Event()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        self._off.set()
        self._go.set()

    def __call__(self) -> bool:
        self._go.wait()
        return self._off.is_set()


class Metrics(Protocol):
    """What an exporter of metrics has to offer."""

    def count(self, name: str, by: float = 1, **labels: str) -> None: ...

    def gauge(self, name: str, value: float, **labels: str) -> None: ...

    def observe(self, name: str, value: float, **labels: str) -> None: ...


class Silent:
    """Metrics that go nowhere."""

    def count(self, name: str, by: float = 1, **labels: str) -> None: ...

    def gauge(self, name: str, value: float, **labels: str) -> None: ...

    def observe(self, name: str, value: float, **labels: str) -> None: ...


class Registry:
    """Metrics kept in the driver: counters that only rise, gauges, and histograms over fixed bounds."""

    def __init__(self, bounds: dict[str, tuple[float, ...]] | None = None, default: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 60.0)):
        self.bounds, self.default, self.lock = bounds or {}, default, threading.Lock()
        self.kinds: dict[str, str] = {}
        self.values: dict[tuple, float | list] = {}

    def _at(self, name: str, kind: str, labels: dict) -> tuple:
        if self.kinds.setdefault(name, kind) != kind:
            raise ValueError(f"{name} is a {self.kinds[name]}")
        return name, tuple(sorted(labels.items()))

    def count(self, name: str, by: float = 1, **labels: str) -> None:
        if by < 0:
            raise ValueError("a counter can't fall")
        with self.lock:
            key = self._at(name, "counter", labels)
            self.values[key] = self.values.get(key, 0) + by

    def gauge(self, name: str, value: float, **labels: str) -> None:
        with self.lock:
            self.values[self._at(name, "gauge", labels)] = value

    def observe(self, name: str, value: float, **labels: str) -> None:
        bounds = self.bounds.get(name, self.default)
        with self.lock:
            # one number a bucket (the last is open), then the sum
            cells = self.values.setdefault(self._at(name, "histogram", labels), [0] * (len(bounds) + 1) + [0.0])
            cells[bisect_left(bounds, value)] += 1
            cells[-1] += value

    def render(self) -> str:
        """The text format that scrapers of metrics read."""
        out, last = [], None
        with self.lock:
            for (name, labels), v in sorted(self.values.items(), key=lambda x: x[0]):
                if name != last:
                    out.append(f"# TYPE {name} {self.kinds[name]}")
                    last = name
                if self.kinds[name] != "histogram":
                    out.append(f"{name}{_labels(labels)} {v:g}")
                    continue
                below = 0
                for bound, n in zip([*(f"{b:g}" for b in self.bounds.get(name, self.default)), "+Inf"], v):
                    below += n
                    out.append(f"{name}_bucket{_labels((*labels, ('le', bound)))} {below}")
                out += [f"{name}_sum{_labels(labels)} {v[-1]:g}", f"{name}_count{_labels(labels)} {below}"]
        return "\n".join(out) + "\n" if out else ""


def _labels(pairs: tuple) -> str:
    clean = [(k, str(v).replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n")) for k, v in pairs]
    return "{" + ",".join(f'{k}="{v}"' for k, v in clean) + "}" if clean else ""
