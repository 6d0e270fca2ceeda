"""The circuit breaker's step, shared by the batch and the streaming form."""

from __future__ import annotations

#: Failures in a row that open a breaker, seconds until it lets a probe through.
FAILURES, RECOVERY = 5, 30.0


def step(failed: int, opened: float | None, at: float, ok: bool, failures: int = FAILURES, recovery: float = RECOVERY) -> tuple[str, int, float | None]:
    """What a call at `at` meets (closed, open or half_open), and the failures in a row and the time of opening after it."""
    met = "closed" if opened is None else "half_open" if at - opened >= recovery else "open"
    if met == "open":
        return met, failed, opened
    if ok:
        return met, 0, None
    failed += 1
    return (met, failures, at) if met == "half_open" or failed >= failures else (met, failed, opened)
