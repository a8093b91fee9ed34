"""Searches along one event's frames when asking is dear, and selection of events.

Where all answers are at hand, ``sequence.onset_offset`` gives the same places in
one pass; these functions are for predicates that cost a call each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache


def bisect_onset(present: Callable[[int], bool], low: int, high: int) -> tuple[int, int]:
    """(first present place in low..high with ``high`` present, repairs): bisection
    in ceil(log2 n) calls, then steps back while the place before is present."""
    ask = cache(present)
    a, b = low, high
    while a < b:
        mid = (a + b) // 2
        a, b = (a, mid) if ask(mid) else (mid + 1, b)
    repairs = 0
    while b > low and ask(b - 1):
        b, repairs = b - 1, repairs + 1
    return b, repairs


def bisect_offset(present: Callable[[int], bool], low: int, high: int) -> tuple[int, int]:
    """(last present place in low..high with ``low`` present, repairs)."""
    mirrored, repairs = bisect_onset(lambda i: present(low + high - i), low, high)
    return low + high - mirrored, repairs


def gallop(present: Callable[[int], bool], seed: int, step: int, end: int, doublings: int = 6) -> int:
    """The furthest present place from ``seed`` in direction ``step`` (1 or -1) up
    to ``end``: doubling strides until one misses, then bisection."""
    ask = cache(present)
    at, stride = seed, 1
    for _ in range(doublings):
        ahead = at + step * stride
        if (end - ahead) * step < 0 or not ask(ahead):
            break
        at, stride = ahead, stride * 2
    ahead = at + step * stride
    limit = ahead if (end - ahead) * step >= 0 else end
    found, _ = bisect_offset(ask, at, limit) if step > 0 else bisect_onset(ask, limit, at)
    return found


def _solid(present: Callable[[int], bool], start: int, end: int, step: int) -> int:
    """The furthest place from ``start`` towards ``end`` up to which all are present."""
    return next((i - step for i in range(start + step, end + step, step) if not present(i)), end)


def ground_event(present: Callable[[int], bool], seeds: list[int], size: int, gap: int = 1, recurrence: int | None = None) -> list[tuple[int, int]]:
    """Runs of places of an event, grown from its seeds in both directions over
    gaps of at most ``gap``; seeds that are not present are dropped, runs that
    meet are one.  With ``recurrence`` the places after the last run are asked, from
    ``gap`` on and that many apart, for the event coming back; each hit is a seed.
    An event that no seed confirms has no runs.  What the strides passed over is asked again, so a run has no
    longer gaps inside."""
    ask = cache(present)
    runs: list[tuple[int, int]] = []
    waiting = sorted(set(seeds))
    while True:
        if waiting:
            seed = waiting.pop(0)
        elif recurrence and runs:
            probes = range(runs[-1][1] + 1 + gap, size, max(1, recurrence))
            seed = next((i for i in probes if ask(i)), -1)
        else:
            seed = -1
        if seed < 0 and not waiting:
            break
        if not 0 <= seed < size or not ask(seed) or (runs and seed <= runs[-1][1]):
            continue
        first, last = seed, seed
        for step, end in ((-1, 0), (1, size - 1)):
            at = _solid(ask, seed, gallop(ask, seed, step, end), step)
            while True:
                jump = next((at + step * d for d in range(1, gap + 2) if (end - (at + step * d)) * step >= 0 and ask(at + step * d)), None)
                if jump is None:
                    break
                at = _solid(ask, jump, gallop(ask, jump, step, end), step)
            first, last = (at, last) if step < 0 else (first, at)
        if runs and first <= runs[-1][1] + 1:
            runs[-1] = (min(first, runs[-1][0]), max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    return runs
