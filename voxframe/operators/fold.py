"""The segment fold: one pass over runs of equal flags, in sample counts only.

A segment is a contiguous sample range, so the state machine needs no samples. It is fed
runs (first window, number of windows, speech or not) and carries a small state that can
be handed from one block of a stream to the next.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from voxframe.functions.signal import TARGET_RATE, window_size_for

# The default segmentation options and the reduced silence threshold.
MIN_SPEECH_S = 3.0
SOFT_LIMIT_S = 60.0
HARD_LIMIT_S = 3600.0
MIN_SILENCE_MS = 2000
LOOK_BACK_S = 0.5
ADAPTIVE_SILENCE_MS = 32

STATE_DDL = (
    "struct<in_speech:boolean,start:bigint,speech:bigint,silence:bigint,silence_ms:double,"
    "back:int,back_short:bigint,shift:bigint>"
)
STATE_FIELDS = ("in_speech", "start", "speech", "silence", "silence_ms", "back", "back_short", "shift")


@dataclass(frozen=True)
class SegmentOptions:
    rate: int = TARGET_RATE
    window: int | None = None
    min_speech_s: float = MIN_SPEECH_S
    soft_limit_s: float | None = SOFT_LIMIT_S
    hard_limit_s: float = HARD_LIMIT_S
    min_silence_ms: float = MIN_SILENCE_MS
    look_back_s: float = LOOK_BACK_S
    compat_start: bool = True
    discard_open: bool = False

    def __post_init__(self):
        if self.window is None:
            object.__setattr__(self, "window", window_size_for(self.rate))
        object.__setattr__(self, "look_back_s", max(0.0, self.look_back_s))
        if self.soft_limit_s is not None and self.soft_limit_s > self.hard_limit_s:
            raise ValueError("soft_limit_s cannot exceed hard_limit_s")

    @property
    def window_s(self) -> float:
        return self.window / self.rate

    @property
    def hard_samples(self) -> int:
        return int(round(self.hard_limit_s * self.rate))

    @property
    def back_windows(self) -> int:
        return floor((self.look_back_s + 1e-9) / self.window_s)

    @property
    def quiet_windows(self) -> int | None:
        """Non-speech windows after which the detector is idle with a full look-back.

        None if the hard limit is so short that no such length can be promised.
        """
        if self.hard_limit_s < self.min_speech_s + 2 * self.window_s:
            return None
        step_ms = self.window_s * 1000
        silence = max(1, ceil(self.min_silence_ms / step_ms))
        return ceil(self.min_speech_s / self.window_s) + silence + self.back_windows + 2


class SegmentFold:
    """Feed runs in order; closed segments collect in ``out``.

    Each entry of ``out`` is (start_sample, n_samples, shift, end_reason). ``shift`` is how
    much earlier the historic start time lies than the exact start sample: a look-back that
    opens with a part of a window counts it as a whole one.
    """

    def __init__(self, options: SegmentOptions, state=None):
        self.o = options
        self.hard = options.hard_samples
        self.out: list[tuple[int, int, int, str]] = []
        self.clear()
        if state is not None:
            (self.in_speech, self.start, self.speech, self.silence, self.silence_ms,
             self.back, self.back_short, self.shift) = state

    def clear(self):
        """Forget everything, without emitting an open segment."""
        self.in_speech = False
        self.start = self.speech = self.silence = self.shift = 0
        self.silence_ms = 0.0
        self.back = self.back_short = 0

    def state(self) -> tuple:
        return (self.in_speech, self.start, self.speech, self.silence, self.silence_ms,
                self.back, self.back_short, self.shift)

    def idle_with_look_back(self, windows: int):
        self.clear()
        self.back = min(windows, self.o.back_windows)

    @property
    def seconds(self) -> float:
        return (self.speech + self.silence) / self.o.rate

    def feed(self, first: int, n: int, is_speech: bool):
        if n <= 0:
            return
        if is_speech:
            self._speech_run(first, n)
        else:
            self._silent_run(n)

    def finish(self):
        if self.o.discard_open:
            self.clear()
        elif self.in_speech and self.speech + self.silence > 0:
            self.speech += self.silence
            self._emit("flush")

    def _speech_run(self, first: int, n: int):
        w = self.o.window
        if self.in_speech:
            self._keep_silence()
        else:
            before = self.back * w - self.back_short
            self.start = first * w - before
            self.speech = before
            self.shift = self.back_short
            self.back = self.back_short = 0
            self.in_speech = True
        self._grow(n * w)

    def _keep_silence(self):
        self.speech += self.silence
        self.silence = 0
        self.silence_ms = 0.0

    def _grow(self, samples: int):
        """Add speech samples, cutting at the exact hard limit as often as needed."""
        while samples > 0:
            take = min(samples, max(0, self.hard - self.speech))
            self.speech += take
            samples -= take
            if self.speech < self.hard:
                return
            end, shift = self.start + self.speech, self.shift
            self._emit("hard_limit")
            # A cut on a window edge restarts from that window's own time stamp.
            if samples > 0:
                self.in_speech, self.start = True, end
                self.shift = 0 if end % self.o.window == 0 else shift

    def _emit(self, reason: str):
        self.out.append((self.start, self.speech, self.shift, reason))
        self.clear()

    def _silence_threshold(self) -> float:
        o = self.o
        over_soft = (
            o.soft_limit_s is not None
            and o.soft_limit_s < o.hard_limit_s
            and self.seconds > o.soft_limit_s
        )
        return ADAPTIVE_SILENCE_MS if over_soft and o.min_silence_ms > 0 else o.min_silence_ms

    def _silent_run(self, n: int):
        o, w = self.o, self.o.window
        while n > 0 and self.in_speech:
            n -= 1
            threshold = self._silence_threshold()
            if self.seconds < o.min_speech_s:
                self._keep_silence()
                self._grow(w)
                continue
            take = min(w, max(0, self.hard - self.speech - self.silence))
            self.silence += take
            self.silence_ms += take / o.rate * 1000
            at_limit = self.speech + self.silence >= self.hard
            if at_limit or self.silence_ms >= threshold:
                self.speech += self.silence
                self._emit("hard_limit" if at_limit else "silence")
                if take < w and o.back_windows > 0:
                    self.back, self.back_short = 1, take
        if n > 0:
            room = o.back_windows - self.back
            self.back = min(o.back_windows, self.back + n)
            if n > room:
                self.back_short = 0
