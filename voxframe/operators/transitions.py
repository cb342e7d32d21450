"""What a stretch of a stream does to the state of the segment fold, for every state at once.

Just before a speech window the fold's state is one number: the samples x of the open segment so far, or of the look-back
that a new one would open with; the segment starts x samples before the window either way. A stretch from one such window to
another maps x to its value there, and that map is made of a few pieces: over an interval of x the state either moves along (x + c,
the segment stays open, perhaps cut at the hard limit) or ends in one value (a pause closed the segment). Maps of adjacent stretches
compose, so the states at all block borders come out of a prefix composition, in any order and in parallel.

The shift that a segment reports travels with x: a piece keeps the incoming one, or takes the one of a look-back that opened
with part of a window; a hard cut on a window edge sets it to 0.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil

import numpy as np

from voxframe.operators.fold import SegmentFold, SegmentOptions

FIELDS = ("low", "slope", "value", "cuts", "source", "shift")


class StateMap:
    """Pieces by their least x: ``value`` is the constant (slope 0) or what is added to x (slope 1).

    ``cuts`` counts hard limits passed. ``source`` is 0 if the incoming shift goes on, else the number of the cut after
    which the look-back opened with part of a window. ``shift`` is that of a constant piece.
    """

    def __init__(self, low, slope, value, cuts=None, source=None, shift=None):
        zeros = np.zeros(len(low), np.int64)
        self.low, self.slope, self.value, self.cuts, self.source, self.shift = (
            zeros if a is None else np.asarray(a, np.int64) for a in (low, slope, value, cuts, source, shift))

    @staticmethod
    def constant(x: int, shift: int) -> StateMap:
        return StateMap([0], [0], [x], shift=[shift])

    @property
    def is_constant(self) -> bool:
        return len(self.low) == 1 and self.slope[0] == 0

    def columns(self) -> tuple[np.ndarray, ...]:
        return tuple(getattr(self, f) for f in FIELDS)

    def pack(self) -> bytes:
        return np.stack(self.columns()).astype("<i8").tobytes()

    @staticmethod
    def unpack(data: bytes) -> StateMap:
        return StateMap(*np.frombuffer(data, "<i8").reshape(len(FIELDS), -1))

    def merged(self) -> StateMap:
        """Neighbours that do the same become one piece."""
        same = np.ones(len(self.low), bool)
        same[0] = False
        for a in self.columns()[1:]:
            same[1:] &= a[1:] == a[:-1]
        return self if not same.any() else StateMap(*(a[~same] for a in self.columns()))

    def apply(self, x: int, shift: int, o: SegmentOptions) -> tuple[int, int]:
        i = int(np.searchsorted(self.low, x, "right")) - 1
        if not self.slope[i]:
            return int(self.value[i]), int(self.shift[i])
        return x + int(self.value[i]), shift_after(x, shift, int(self.cuts[i]), int(self.source[i]), o)

    def then(self, after: StateMap, o: SegmentOptions) -> StateMap:
        """First this map, then ``after``."""
        moved = self.low + self.value
        high = np.append(self.low[1:], domain(o)) - 1
        first = np.searchsorted(after.low, np.where(self.slope == 1, moved, self.value), "right") - 1
        last = np.where(self.slope == 1, np.searchsorted(after.low, high + self.value, "right") - 1, first)
        sizes = last - first + 1
        i = np.repeat(np.arange(len(self.low)), sizes)
        j = np.repeat(first, sizes) + np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        low = np.where(self.slope[i] == 1, np.maximum(self.low[i], after.low[j] - self.value[i]), self.low[i])
        both, ends = (self.slope[i] == 1) & (after.slope[j] == 1), after.slope[j] == 0
        value = np.where(ends, after.value[j], self.value[i] + after.value[j])
        shift = np.where(ends, after.shift[j], np.where(self.slope[i] == 0, self.shift[i], 0))
        for k in np.flatnonzero((self.slope[i] == 0) & ~ends & (after.cuts[j] + after.source[j] > 0)):
            shift[k] = shift_after(int(self.value[i[k]]), int(self.shift[i[k]]), int(after.cuts[j[k]]), int(after.source[j[k]]), o)
        cuts = np.where(both, self.cuts[i] + after.cuts[j], 0)
        source = np.where(both, np.where(after.source[j] > 0, self.cuts[i] + after.source[j], self.source[i]), 0)
        return StateMap(low, both.astype(np.int64), value, cuts, source, shift).merged()


def shift_after(x: int, shift: int, cuts: int, source: int, o: SegmentOptions) -> int:
    """The shift behind ``cuts`` hard limits of a segment that was x samples long."""
    w = o.window
    if source:
        shift = (source * o.hard_samples - x) % w
    return 0 if any((k * o.hard_samples - x) % w == 0 for k in range(source + 1, min(cuts, source + w) + 1)) else shift


def _least(condition, guess: int) -> int:
    """Least whole number that meets a condition which holds from some point on, near a guess."""
    guess = max(0, guess)
    while condition(guess):
        if guess == 0:
            return 0
        guess -= 1
    while not condition(guess):
        guess += 1
    return guess


@lru_cache(maxsize=64)
def domain(o: SegmentOptions) -> int:
    """States are below this number."""
    return max(o.hard_samples, o.back_windows * o.window + 1)


def speech_map(o: SegmentOptions, windows: int) -> StateMap:
    """A run of speech: x grows, and the hard limit cuts it as often as needed."""
    hard, grown = o.hard_samples, windows * o.window
    first = grown // hard
    low, value, cuts = [0], [grown - first * hard], [first]
    at = (first + 1) * hard - grown
    while at < hard:
        low, cuts = [*low, at], [*cuts, cuts[-1] + 1]
        value, at = [*value, value[-1] - hard], at + hard
    slope, shift = [1] * len(low), [0] * len(low)
    if domain(o) > hard:
        # A look-back beyond the limit closes at once, before the run's first window.
        low, slope, value, cuts, shift = [*low, hard], [*slope, 0], [*value, grown % hard], [*cuts, 0], [*shift, 0]
    return StateMap(low, slope, value, cuts, None, shift)


@lru_cache(maxsize=64)
def silence_maps(o: SegmentOptions) -> tuple[StateMap, ...]:
    """The maps of 0, 1, ... windows of silence, up to the length that makes all states one.

    Between the points at which a limit is reached in one window more, pieces do not change; the fold
    itself tells what happens at each of them.
    """
    w, hard, n = o.window, o.hard_samples, o.quiet_windows
    turning = {_least(lambda t: not t / o.rate < o.min_speech_s, int(o.min_speech_s * o.rate) - 1), hard}
    if o.soft_limit_s is not None and o.soft_limit_s < o.hard_limit_s:
        turning.add(_least(lambda t: t / o.rate > o.soft_limit_s, int(o.soft_limit_s * o.rate) - 1))
    points = {0, 1, 2} | {t - i * w + d for t in turning for i in range(n + 2) for d in (0, 1)}
    low = np.array(sorted(p for p in points if 0 <= p < hard), np.int64)
    ends = np.append(low[1:], hard)
    # The state at each point and right after it, window by window.
    folds = [[SegmentFold(o, (True, -x, x, 0, 0.0, 0, 0, 0)) if x else SegmentFold(o) for x in (int(a), int(min(a + 1, b - 1)))]
             for a, b in zip(low, ends, strict=True)]
    maps = [StateMap([0], [1], [0])]
    for k in range(1, n):
        rows = []
        for x, one_point, (a, b) in zip(low.tolist(), (ends - low == 1).tolist(), folds, strict=True):
            a.feed(0, 1, False)
            b.feed(0, 1, False)
            if a.in_speech:
                rows.append((1, k * w, 0, 0, 0))
                continue
            at, then = a.back * w - a.back_short, b.back * w - b.back_short
            if then == at + 1:
                rows.append((1, at - x, 1, 1, 0))
            else:
                rows.append((0, at, 0, 0, a.back_short))
            if not one_point and then not in (at, at + 1):
                raise AssertionError("a limit inside a piece")
        maps.append(StateMap(low, *np.array(rows, np.int64).T).merged())
    return (*maps, StateMap.constant(o.back_windows * w, 0))


@lru_cache(maxsize=1 << 14)
def pair_map(o: SegmentOptions, speech: int, silence: int) -> StateMap:
    """A run of speech and the silence behind it."""
    maps = silence_maps(o)
    return speech_map(o, speech).then(maps[min(silence, len(maps) - 1)], o)


def entering(fold: SegmentFold) -> tuple[int, int]:
    """(x, shift) of a fold, right before a speech window."""
    if fold.in_speech:
        return fold.speech + fold.silence, fold.shift
    return fold.back * fold.o.window - fold.back_short, fold.back_short


def entered(o: SegmentOptions, window: int, x: int, shift: int) -> SegmentFold:
    """The fold right before a speech window."""
    return SegmentFold(o, (True, window * o.window - x, x, 0, 0.0, 0, 0, shift))


def _every_state(o: SegmentOptions, runs: list[tuple[int, int, bool]]) -> StateMap:
    """The map of runs under a hard limit so short that silence need not settle anything: by all states there are."""
    w, hard = o.window, o.hard_samples
    phases, p = set(), 0
    while p not in phases:
        phases.add(p)
        p = (p - hard) % w
    states = sorted(x for x in {i * w + p for i in range(ceil(domain(o) / w) + 1) for p in phases} if x < domain(o))
    rows = []
    for x in states:
        # A negative shift that comes out again is the incoming one.
        fold = entered(o, runs[0][0], x, -1)
        for run in runs:
            fold.feed(*run)
            fold.out.clear()
        to, shift = entering(fold)
        rows.append((x, 1, to - x, 0, 0, 0) if shift < 0 else (x, 0, to, 0, 0, shift))
    rows[0] = (0, *rows[0][1:])
    return StateMap(*np.array(rows, np.int64).T).merged()


def stretch_map(o: SegmentOptions, runs: list[tuple[int, int, bool]]) -> StateMap:
    """The map of alternating (first window, length, is speech) runs that begin with speech.

    As soon as all states have become one, the fold itself goes on.
    """
    if o.quiet_windows is None:
        return _every_state(o, runs)
    total, i = StateMap([0], [1], [0]), 0
    while i < len(runs):
        pause = runs[i + 1][1] if i + 1 < len(runs) else 0
        total = total.then(pair_map(o, runs[i][1], pause), o)
        i += 2
        if total.is_constant and i < len(runs):
            fold = entered(o, runs[i][0], int(total.value[0]), int(total.shift[0]))
            for run in runs[i:]:
                fold.feed(*run)
                fold.out.clear()
            return StateMap.constant(*entering(fold))
    return total
