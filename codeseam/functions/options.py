"""Numbers as they are shown, and values of options as they are checked."""

from __future__ import annotations

import re
from collections.abc import Callable
from threading import RLock, Timer

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 2**53 - 1


def bytes_shown(n: Column) -> Column:
    """``512B, 1.5KB, 2.25MB``."""
    small, kilo = n < 1024, n < 1024 * 1024
    return F.when(small, F.format_string("%dB", n.cast("bigint"))).when(kilo, F.format_string("%.1fKB", n / 1024)).otherwise(F.format_string("%.2fMB", n / 1024 / 1024))


def share_shown(value: float) -> str:
    return f"{value * 100:.1f}%"


def interval_shown(low: float, high: float) -> str:
    return f"[{low:.3f}, {high:.3f}]"


def duration_shown(ms: float) -> str:
    """``250ms, 1.5s, 2m 5s``."""
    if ms < 1000:
        return f"{ms:.0f}ms"
    return f"{ms / 1000:.1f}s" if ms < 60_000 else f"{int(ms // 60_000)}m {ms % 60_000 / 1000:.0f}s"


def progress_shown(phase: str, status: str, message: str, ms: float) -> str:
    took = f"{ms / 1000:.1f}s" if ms < 60_000 else f"{int(ms // 60_000)}m {int(ms % 60_000 // 1000)}s"
    return f"[eval {took}] {status.upper():<8} {phase}: {message}"


def whole(value: str | None, option: str, least: int | None = None, most: int | None = None) -> int:
    """The whole number that an option was given, within its bounds; an error names the option."""
    if value is None or not re.fullmatch(r"-?\d+", value):
        raise ValueError(f"{option} needs a whole number")
    number = int(value)
    if abs(number) > LARGEST:
        raise ValueError(f"{option} needs a number up to {LARGEST}")
    if least is not None and number < least:
        raise ValueError(f"{option} must be at least {least}")
    if most is not None and number > most:
        raise ValueError(f"{option} must be at most {most}")
    return number


def share(value: str | None, option: str) -> float:
    """A number from 0 to 1."""
    try:
        number = float(value or "")
    except ValueError:
        raise ValueError(f"{option} needs a number from 0 to 1") from None
    if not 0 <= number <= 1:
        raise ValueError(f"{option} must be between 0 and 1")
    return number


class Writer:
    """Writes of a driver one after the other, in the order of their calls; one that fails does not keep the next from it."""

    def __init__(self) -> None:
        self._lock, self._held = RLock(), 0
        self._timer: Timer | None = None

    @property
    def active(self) -> bool:
        return self._held > 0

    def run(self, task: Callable, *args, **named):
        with self._lock:
            self._held += 1
            try:
                return task(*args, **named)
            finally:
                self._held -= 1

    def every(self, seconds: float, task: Callable) -> Callable[[], None]:
        """Run a task now and again each so many seconds; gives what stops it. An earlier plan is given up."""
        if self._timer:
            self._timer.cancel()

        def again() -> None:
            try:
                self.run(task)
            finally:
                self._timer = Timer(seconds, again)
                self._timer.daemon = True
                self._timer.start()

        again()

        def stop() -> None:
            if self._timer:
                self._timer.cancel()
                self._timer = None

        return stop
