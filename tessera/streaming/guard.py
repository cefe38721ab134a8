"""Driver-side guards of a streaming writer: a circuit breaker and retries with backoff."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half-open"


class Refused(RuntimeError):
    """The breaker is open."""


class Breaker:
    """Opens after `failures` failures, or at a failure rate of `rate` over `calls` calls or more, within `window` seconds; after `rest` seconds it
    lets calls through half-open: `probes` successes close it, a failure opens it again."""

    def __init__(self, failures: int = 5, rate: float = 0.5, calls: int = 10, window: float = 60.0, rest: float = 30.0, probes: int = 2, clock: Callable[[], float] = time.monotonic):
        self.failures, self.rate, self.calls, self.window, self.rest, self.probes, self.clock = failures, rate, calls, window, rest, probes, clock
        self._seen: deque[tuple[float, bool]] = deque()
        self._state, self._since, self._good = CLOSED, 0.0, 0

    @property
    def state(self) -> str:
        if self._state == OPEN and self.clock() - self._since >= self.rest:
            self._state, self._good = HALF_OPEN, 0
        return self._state

    def record(self, ok: bool) -> None:
        now, state = self.clock(), self.state
        if state == HALF_OPEN:
            self._good += ok
            if not ok:
                self._state, self._since = OPEN, now
            elif self._good >= self.probes:
                self._state = CLOSED
                self._seen.clear()
            return
        self._seen.append((now, ok))
        while self._seen and self._seen[0][0] < now - self.window:
            self._seen.popleft()
        bad = sum(not x for _, x in self._seen)
        if state == CLOSED and (bad >= self.failures or (len(self._seen) >= self.calls and bad / len(self._seen) >= self.rate)):
            self._state, self._since = OPEN, now

    def call(self, f: Callable):
        if self.state == OPEN:
            raise Refused("too many failures")
        try:
            out = f()
        except Exception:
            self.record(False)
            raise
        self.record(True)
        return out


def with_retries(f: Callable, retries: int = 2, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """f's result; after a failure it is tried again, with waits of base, 2 base, ... The last failure is raised: nothing is dropped."""
    for attempt in range(retries + 1):
        try:
            return f()
        except Exception:
            if attempt == retries:
                raise
            sleep(base * 2**attempt)
