"""Stopwatch with laps and several timers."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


@dataclass
class Timer:
    """One timer. Laps are whole milliseconds; a stopped timer counts its last stretch as a lap."""

    started: int | None = None
    lap_started: int | None = None
    elapsed_ns: int = 0
    laps: list[int] = field(default_factory=list)

    def start(self) -> None:
        self.started = self.lap_started = time.perf_counter_ns()
        self.elapsed_ns, self.laps = 0, []

    reset = start

    def end_lap(self) -> None:
        now = time.perf_counter_ns()
        if self.lap_started is not None:
            self.laps.append((now - self.lap_started) // 1_000_000)
        self.lap_started = now

    def stop(self) -> None:
        if self.started is None:
            return
        self.end_lap()
        self.elapsed_ns, self.started = time.perf_counter_ns() - self.started, None

    @property
    def average_lap(self) -> float:
        """Mean lap in milliseconds; 0 without laps."""
        return sum(self.laps) / len(self.laps) if self.laps else 0.0


class Stopwatch:
    """Timers by number; 0 always exists, others come into being when started."""

    def __init__(self) -> None:
        self.timers: dict[int, Timer] = {0: Timer()}

    def __getitem__(self, number: int) -> Timer:
        return self.timers.setdefault(number, Timer())

    def new(self) -> int:
        number = max(self.timers) + 1
        self[number].start()
        return number

    def seconds(self, number: int = 0) -> float:
        """Elapsed seconds, 0 for an unknown timer."""
        return self.timers[number].elapsed_ns / 1e9 if number in self.timers else 0.0

    def formatted(self, number: int = 0) -> str:
        return format_time(self.seconds(number) * 1000)


def format_time(milliseconds: float) -> str:
    hours, rest = divmod(milliseconds, 3_600_000)
    minutes, rest = divmod(rest, 60_000)
    seconds, rest = divmod(rest, 1000)
    return f"{hours:.0f} hours, {minutes:.0f} minutes, {seconds:.0f} seconds, {rest:.6f} milliseconds"
