"""Stateful processors for unbounded input.

Contract where the batch form has no counterpart: rows of a stream may arrive in any order and over any micro-batches. A row that
is ahead waits in a map state of packed bits or bytes, keyed by its place, so state is small and only what is touched is
read. A hole is waited for until it closes, the stream ends, ``hole_timeout_ms`` of processing time have passed since it was seen, or (windows) more
than ``reorder`` positions are waiting behind it; then it counts as non-speech, or as lost. Rows behind the position that has been
passed are counted as late, and with ``late_rows`` they come out as rows of their own. A stream ends with an ``is_end`` row, or after
``idle_timeout_ms`` without input; it keeps its position and numbering in case it resumes. State may be given a time to live (``ttl_ms``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxframe.operators.fold import STATE_FIELDS, SegmentFold, SegmentOptions
from voxframe.operators.recognize import RATE, Conversation, recognize_one, timed

#: Windows of a block of waiting windows.
WAITING_BLOCK = 1024

_HEAD = ("in_speech boolean, start bigint, speech bigint, silence bigint, silence_ms double, back int, back_short bigint, shift bigint, "
         "next bigint, last bigint, segments bigint, late bigint, hole_at bigint, idle_at bigint")


class _Timed(StatefulProcessor):
    """Timers for holes and idle streams, kept as times in the processor's head."""

    hole_timeout_ms: int | None = None
    idle_timeout_ms: int | None = None
    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def map_state(self, name: str, key: str, value: str):
        return self.handle.getMapState(name, key, value, self.ttl_ms)

    def set_timers(self, *times: int | None) -> None:
        wanted = {t for t in times if t is not None and t >= 0}
        known = set(self.handle.listTimers())
        for t in known - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - known:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


def _time_mode(*timeouts: int | None) -> str:
    return "none" if all(t is None for t in timeouts) else "processingTime"


class SegmentProcessor(_Timed):
    """Windows in, closed segments out."""

    columns = ["stream_id", "segment_idx", "start_sample", "n_samples", "start_s", "duration_s",
               "end_reason", "late_windows", "late_window_idx"]

    def __init__(self, options: SegmentOptions, reorder: int | None = None, idle_timeout_ms: int | None = None,
                 hole_timeout_ms: int | None = None, late_rows: bool = False, ttl_ms: int | None = None):
        self.options, self.reorder, self.late_rows = options, reorder, late_rows
        self.idle_timeout_ms, self.hole_timeout_ms, self.ttl_ms = idle_timeout_ms, hole_timeout_ms, ttl_ms

    def open(self, handle) -> None:
        self.head = handle.getValueState("head", _HEAD, self.ttl_ms)
        self.waiting = self.map_state("waiting", "block bigint", "present binary, speech binary, reset binary")

    # --- state --------------------------------------------------------------------------

    def _load(self) -> None:
        values = tuple(self.head.get()) if self.head.exists() else (*SegmentFold(self.options).state(), 0, -1, 0, 0, -1, -1)
        n = len(STATE_FIELDS)
        self.fold = SegmentFold(self.options, values[:n])
        self.next, self.last, self.segments, self.late, self.hole_at, self.idle_at = values[n:]
        # Per block, by window: whether it waits, whether it is speech, whether the detector is reset before it.
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _store(self) -> None:
        for block, planes in self.blocks.items():
            if planes[0].any():
                self.waiting.updateValue((block,), tuple(np.packbits(x).tobytes() for x in planes))
            elif self.waiting.containsKey((block,)):
                self.waiting.removeKey((block,))
        self.head.update((*self.fold.state(), self.next, self.last, self.segments, self.late, self.hole_at, self.idle_at))
        if self.hole_timeout_ms is not None or self.idle_timeout_ms is not None:
            self.set_timers(self.hole_at, self.idle_at)

    def _block(self, block: int, create: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if block not in self.blocks:
            if self.waiting.containsKey((block,)):
                self.blocks[block] = tuple(
                    np.unpackbits(np.frombuffer(bytes(x), np.uint8)).astype(bool) for x in self.waiting.getValue((block,)))
            elif create:
                self.blocks[block] = tuple(np.zeros(WAITING_BLOCK, bool) for _ in range(3))
        return self.blocks.get(block)

    def _put(self, index: np.ndarray, speech: np.ndarray, reset: np.ndarray) -> None:
        blocks = index // WAITING_BLOCK
        for block in np.unique(blocks).tolist():
            own = blocks == block
            present, flags, resets = self._block(block, create=True)
            at = index[own] % WAITING_BLOCK
            present[at] = True
            flags[at] = speech[own]
            resets[at] = reset[own]

    def _first_waiting(self) -> int | None:
        """The first window that waits at or behind the position."""
        stored = {int(k[0]) for k in self.waiting.keys()} if self.last >= self.next else set()
        for block in sorted(b for b in stored | set(self.blocks) if b >= self.next // WAITING_BLOCK):
            found = self._block(block)
            at = np.flatnonzero(found[0]) if found else []
            if len(at):
                return block * WAITING_BLOCK + int(at[0])
        return None

    # --- work ---------------------------------------------------------------------------

    def _feed_present(self) -> None:
        """All windows from the position on, up to a hole."""
        while self.next <= self.last:
            found = self._block(self.next // WAITING_BLOCK)
            offset = self.next % WAITING_BLOCK
            if found is None or not found[0][offset]:
                return
            present, speech, reset = found
            gaps = np.flatnonzero(~present[offset:])
            end = offset + int(gaps[0]) if len(gaps) else WAITING_BLOCK
            turns = np.diff(speech[offset:end]) | reset[offset + 1 : end]
            cuts = np.flatnonzero(turns) + offset + 1
            for a, b in zip([offset, *cuts], [*cuts, end], strict=True):
                if reset[a]:
                    self.fold.clear()
                self.fold.feed(self.next, int(b - a), bool(speech[a]))
                self.next += int(b - a)
            present[offset:end] = reset[offset:end] = False

    def _drain(self, everything: bool, pass_hole: bool = False) -> None:
        while True:
            self._feed_present()
            if self.next > self.last:
                return
            first = self._first_waiting()
            if first is None:
                return
            hole = first - self.next
            if not everything and not pass_hole:
                hole = 0 if self.reorder is None else min(hole, max(0, self.last - self.next - self.reorder + 1))
            if hole == 0:
                return
            self.fold.feed(self.next, hole, False)
            self.next += hole
            pass_hole = False
            if self.next < first:
                return

    def _after(self, now: int | None, ended: bool) -> None:
        waits = self.next <= self.last and not ended
        if self.hole_timeout_ms is not None:
            self.hole_at = -1 if not waits else self.hole_at if self.hole_at >= 0 else now + self.hole_timeout_ms
        if ended:
            self.idle_at = -1
        elif self.idle_timeout_ms is not None and now is not None:
            self.idle_at = now + self.idle_timeout_ms

    def _finish(self, key) -> pd.DataFrame:
        self.fold.finish()
        out = self._rows(key, [])
        self.fold.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        ended, late = False, []
        for pdf in rows:
            end = pdf["is_end"].fillna(False).to_numpy(bool)
            ended |= bool(end.any())
            index = pdf["window_idx"].to_numpy()[~end].astype(np.int64)
            speech = pdf["is_speech"].fillna(False).to_numpy()[~end].astype(bool)
            reset = pdf["is_reset"].fillna(False).to_numpy()[~end].astype(bool) if "is_reset" in pdf else np.zeros(len(index), bool)
            behind = index < self.next
            self.late += int(behind.sum())
            late += index[behind].tolist()
            if len(index) > behind.sum():
                self._put(index[~behind], speech[~behind], reset[~behind])
                self.last = max(self.last, int(index.max()))
        before = self.next
        self._drain(ended)
        out = self._finish(key) if ended else self._rows(key, [])
        if self.next > before:
            self.hole_at = -1
        timed_mode = self.hole_timeout_ms is not None or self.idle_timeout_ms is not None
        self._after(timerValues.getCurrentProcessingTimeInMs() if timed_mode else None, ended)
        self._store()
        yield pd.concat([out, self._late(key, late)]) if late and self.late_rows else out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()
        idle = 0 <= self.idle_at <= at
        if idle:
            self._drain(True)
            out = self._finish(key)
        else:
            self._drain(False, pass_hole=0 <= self.hole_at <= at)
            self.hole_at = -1
            out = self._rows(key, [])
        idle_at = self.idle_at
        self._after(now, idle)
        # Input alone moves the idle time.
        self.idle_at = -1 if idle else idle_at
        self._store()
        yield out

    def _rows(self, key, late: list) -> pd.DataFrame:
        o, first = self.options, self.segments
        self.segments += len(self.fold.out)
        out = pd.DataFrame([
            (key[0], first + i, s, n, max(0, s - (sh if o.compat_start else 0)) / o.rate, n / o.rate, why, self.late, None)
            for i, (s, n, sh, why) in enumerate(self.fold.out)
        ], columns=self.columns, dtype=object)
        self.fold.out.clear()
        return out

    def _late(self, key, late: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *[None] * 6, self.late, x) for x in late], columns=self.columns, dtype=object)


def segment_activity_stream(
    windows: DataFrame, options: SegmentOptions | None = None, reorder: int | None = None,
    idle_timeout_ms: int | None = None, hole_timeout_ms: int | None = None, late_rows: bool = False, ttl_ms: int | None = None, **named,
) -> DataFrame:
    """Segments of a stream of ``stream_id, window_idx, is_speech, is_end`` rows, as they close.

    Before a window with ``is_reset`` (if there is such a column) the detector forgets everything, an open segment too. With ``late_rows`` each late window is a row of its own: ``late_window_idx`` and no segment.
    """
    options = options or SegmentOptions(**named)
    stream_type = windows.schema["stream_id"].dataType.simpleString()
    return windows.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=SegmentProcessor(options, reorder, idle_timeout_ms, hole_timeout_ms, late_rows, ttl_ms),
        outputStructType=f"stream_id {stream_type}, segment_idx bigint, start_sample bigint, n_samples bigint, "
                         "start_s double, duration_s double, end_reason string, late_windows bigint, late_window_idx bigint",
        outputMode="append",
        timeMode=_time_mode(idle_timeout_ms, hole_timeout_ms, ttl_ms),
    )


def live_state_of(spark: SparkSession, checkpoint: str, options: SegmentOptions | None = None, operator: int = 0) -> DataFrame:
    """Detector state of all open streams of a running or stopped query, from its checkpoint: the last row of ``live_state`` per stream.

    ``window_idx`` is the last window that has been passed, ``clock_s`` the media time of the stream.
    """
    o = options or SegmentOptions()
    state = (
        spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "head").load(checkpoint)
        .select(F.col("key.stream_id").alias("stream_id"), "value.*"))
    return state.select(
        "stream_id", (F.col("next") - 1).alias("window_idx"), "in_speech",
        ((F.col("speech") + F.col("silence")) / o.rate).alias("segment_seconds"),
        (F.col("next") * o.window / o.rate).alias("clock_s"), F.col("segments").alias("closed_segments"), F.col("late").alias("late_windows"),
    )


class FrameProcessor(_Timed):
    """Chunks in any order in, whole count windows out; less than a window of samples is kept."""

    def __init__(self, size: int, hole_timeout_ms: int | None = None, max_waiting: int | None = None, ttl_ms: int | None = None):
        self.size, self.hole_timeout_ms, self.max_waiting, self.ttl_ms = size, hole_timeout_ms, max_waiting, ttl_ms

    def open(self, handle) -> None:
        self.head = handle.getValueState("head", "next bigint, at bigint, rest binary, waiting bigint, hole_at bigint", self.ttl_ms)
        self.waiting = self.map_state("waiting", "seq bigint", "start bigint, samples binary")

    def _load(self) -> None:
        values = tuple(self.head.get()) if self.head.exists() else (0, 0, b"", 0, -1)
        self.next, self.at, rest, self.n_waiting, self.hole_at = values
        # The rest ends at sample ``at`` of the stream.
        self.rest = np.frombuffer(bytes(rest), "<f4")

    def _store(self, now: int | None) -> None:
        if self.hole_timeout_ms is not None:
            self.hole_at = -1 if not self.n_waiting else self.hole_at if self.hole_at >= 0 else now + self.hole_timeout_ms
            self.set_timers(self.hole_at)
        self.head.update((self.next, self.at, self.rest.astype("<f4").tobytes(), self.n_waiting, self.hole_at))

    def _take(self, start: int, samples: np.ndarray, out: list) -> None:
        """Append a chunk; samples before a gap that fill no window are lost, as are those behind it up to the next window."""
        if start >= 0 and start != self.at:
            skip = min(-start % self.size, len(samples))
            self.rest, self.at, samples = np.empty(0, np.float32), start + skip, samples[skip:]
            if self.at % self.size:
                return
        joined = np.concatenate((self.rest, samples)) if len(self.rest) else samples
        first = (self.at - len(self.rest)) // self.size
        n = len(joined) // self.size
        self.at += len(samples)
        self.rest = joined[n * self.size:]
        out += [(first + i, joined[i * self.size : (i + 1) * self.size]) for i in range(n)]

    def _drain(self, out: list) -> None:
        while self.n_waiting and self.waiting.containsKey((self.next,)):
            start, samples = self.waiting.getValue((self.next,))
            self.waiting.removeKey((self.next,))
            self.n_waiting -= 1
            self._take(int(start), np.frombuffer(bytes(samples), "<f4"), out)
            self.next += 1

    def _pass_hole(self, out: list) -> None:
        """Go on with the first chunk that waits."""
        seqs = [int(k[0]) for k in self.waiting.keys()]
        self.n_waiting = len(seqs)
        if seqs:
            self.next = min(seqs)
            self._drain(out)

    def handleInputRows(self, key, rows, timerValues):
        self._load()
        before, out = self.next, []
        for pdf in rows:
            starts = pdf["start_sample"].fillna(-1).astype(np.int64) if "start_sample" in pdf else np.full(len(pdf), -1)
            for seq, start, samples in zip(pdf["chunk_seq"].tolist(), starts, pdf["samples"], strict=True):
                values = np.asarray(samples, dtype=np.float32)
                if seq == self.next:
                    self._take(int(start), values, out)
                    self.next += 1
                    self._drain(out)
                elif seq > self.next:
                    self.n_waiting += not self.waiting.containsKey((seq,))
                    self.waiting.updateValue((seq,), (int(start), values.astype("<f4").tobytes()))
                    while self.max_waiting is not None and self.n_waiting > self.max_waiting:
                        self._pass_hole(out)
        if self.next > before:
            self.hole_at = -1
        self._store(timerValues.getCurrentProcessingTimeInMs() if self.hole_timeout_ms is not None else None)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load()
        out = []
        if 0 <= self.hole_at <= expiredTimerInfo.getExpiryTimeInMs():
            self._pass_hole(out)
            self.hole_at = -1
        self._store(timerValues.getCurrentProcessingTimeInMs())
        yield self._rows(key, out)

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]] * len(out), "window_idx": [w for w, _ in out], "samples": [x for _, x in out]})


def frame_stream(
    chunks: DataFrame, size: int = 512, hole_timeout_ms: int | None = None, max_waiting: int | None = None, ttl_ms: int | None = None
) -> DataFrame:
    """Whole windows of a stream of ``stream_id, chunk_seq, samples`` rows, with ``start_sample`` where chunks know it.

    A missing chunk is waited for. With ``max_waiting`` at most so many chunks wait behind it, with ``hole_timeout_ms`` for so long; then
    the stream goes on behind it, and windows that touch the gap are lost. That needs ``start_sample``, which places what follows.
    """
    if (max_waiting is not None or hole_timeout_ms is not None) and "start_sample" not in chunks.columns:
        raise ValueError("a missing chunk can be passed only if chunks have start_sample")
    stream_type = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=FrameProcessor(size, hole_timeout_ms, max_waiting, ttl_ms),
        outputStructType=f"stream_id {stream_type}, window_idx bigint, samples array<float>",
        outputMode="append", timeMode=_time_mode(hole_timeout_ms, ttl_ms),
    )


class _Ordered(_Timed):
    """Segments handed on by their index; one that is ahead waits as bytes. An ``is_end`` row lets the waiting ones go."""

    def open(self, handle) -> None:
        self.head = handle.getValueState("head", "next bigint, waiting bigint, hole_at bigint, memory string", self.ttl_ms)
        self.waiting = self.map_state("waiting", "segment_idx bigint", "body binary")

    # Of the rows of a segment: what to keep of it, and its output when its turn has come.
    def keep(self, row) -> bytes:
        raise NotImplementedError

    def turn(self, key, index: int, body: bytes, memory) -> tuple[list[tuple], object]:
        raise NotImplementedError

    def ended(self, key, index: int, memory) -> tuple[list[tuple], object]:
        return [], memory

    columns: list[str] = []

    def _run(self, key, everything: bool, pass_hole: bool) -> list[tuple]:
        out = []
        while self.n_waiting:
            if not self.waiting.containsKey((self.next,)):
                if not everything and not pass_hole:
                    break
                ahead = [int(k[0]) for k in self.waiting.keys()]
                self.n_waiting, pass_hole = len(ahead), False
                if not ahead:
                    break
                self.next = min(ahead)
            body = bytes(self.waiting.getValue((self.next,))[0])
            self.waiting.removeKey((self.next,))
            self.n_waiting -= 1
            rows, self.memory = self.turn(key, self.next, body, self.memory)
            out += rows
            self.next += 1
        return out

    def _load(self) -> None:
        values = tuple(self.head.get()) if self.head.exists() else (0, 0, -1, "null")
        self.next, self.n_waiting, self.hole_at, memory = values
        self.memory = json.loads(memory)

    def _store(self, timerValues) -> None:
        if self.hole_timeout_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.hole_at = -1 if not self.n_waiting else self.hole_at if self.hole_at >= 0 else now + self.hole_timeout_ms
            self.set_timers(self.hole_at)
        self.head.update((self.next, self.n_waiting, self.hole_at, json.dumps(self.memory)))

    def handleInputRows(self, key, rows, timerValues):
        self._load()
        before, ended = self.next, False
        for pdf in rows:
            for row in pdf.to_dict("records"):
                if row.get("is_end") is True:
                    ended = True
                    continue
                index = int(row["segment_idx"])
                if index >= self.next:
                    self.n_waiting += not self.waiting.containsKey((index,))
                    self.waiting.updateValue((index,), (self.keep(row),))
        out = self._run(key, ended, False)
        if ended:
            rows_out, self.memory = self.ended(key, self.next, self.memory)
            out += rows_out
        if self.next > before:
            self.hole_at = -1
        self._store(timerValues)
        yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load()
        out = []
        if 0 <= self.hole_at <= expiredTimerInfo.getExpiryTimeInMs():
            out = self._run(key, False, True)
            self.hole_at = -1
        self._store(timerValues)
        yield pd.DataFrame(out, columns=self.columns, dtype=object)


def _plain(chunks) -> list[dict]:
    """Chunk structs as plain dicts."""
    number = lambda x: None if x is None or x != x else float(x)
    return [{"text": c["text"], "t0": number(c["t0"]), "t1": number(c["t1"])} for c in chunks if c is not None]


class RetryProcessor(_Ordered):
    """Recognized segments in, retry plans out."""

    columns = ["stream_id", "segment_idx", "repeat_idx", "trim_start_s", "trim_start_samples", "prompt"]

    def __init__(self, condition: bool, rate: int, hole_timeout_ms: int | None = None, ttl_ms: int | None = None):
        self.condition, self.rate, self.hole_timeout_ms, self.ttl_ms = condition, rate, hole_timeout_ms, ttl_ms

    def keep(self, row) -> bytes:
        return json.dumps(_plain(row["chunks"])).encode()

    def turn(self, key, index, body, memory):
        memory, chunks, out = Conversation(*(memory or [])), json.loads(body), []
        texts, prompt = [c["text"] for c in chunks], memory.prompt
        i = memory.echo_at(texts)
        if i is not None and (i > 0 or prompt) and chunks[i]["t0"] is not None:
            at = chunks[i]["t0"]
            out.append((key[0], index, i, at, int(at * self.rate), prompt))
        if self.condition:
            memory.remember(texts)
        return out, memory.lines()


def plan_retries_stream(
    segments: DataFrame, condition: bool = True, rate: int = 16000, hole_timeout_ms: int | None = None, ttl_ms: int | None = None
) -> DataFrame:
    """Retry plans for a stream of ``stream_id, segment_idx, chunks`` rows, numbered from 0 and in any order.

    A segment is planned when all before it have come; rows with ``is_end`` (if there is such a column) end the wait.
    """
    stream_type = segments.schema["stream_id"].dataType.simpleString()
    return segments.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=RetryProcessor(condition, rate, hole_timeout_ms, ttl_ms),
        outputStructType=f"stream_id {stream_type}, segment_idx bigint, repeat_idx int, trim_start_s double, "
                         "trim_start_samples bigint, prompt string",
        outputMode="append", timeMode=_time_mode(hole_timeout_ms, ttl_ms),
    )


class TranscribeProcessor(_Ordered):
    """Segments with samples in, transcript rows out, with the memory of the stream."""

    columns = ["stream_id", "segment_idx", "chunk_idx", "text", "start_s", "end_s", "prompt_retry", "chunks"]

    def __init__(self, recognizer, condition: bool, sub_timestamps: bool, convert, raw_memory: bool, rate: int,
                 hole_timeout_ms: int | None, ttl_ms: int | None):
        self.recognizer, self.condition, self.sub_timestamps, self.convert = recognizer, condition, sub_timestamps, convert
        self.raw_memory, self.rate, self.hole_timeout_ms, self.ttl_ms, self.fn = raw_memory, rate, hole_timeout_ms, ttl_ms, None

    def keep(self, row) -> bytes:
        return np.float64(row["start_s"]).tobytes() + np.asarray(row["samples"], "<f4").tobytes()

    def turn(self, key, index, body, memory):
        if self.fn is None:
            self.fn = self.recognizer()
        memory = Conversation(*(memory or [])) if self.condition else Conversation()
        start, samples = float(np.frombuffer(body[:8])[0]), np.frombuffer(body[8:], "<f4")
        chunks = recognize_one(self.fn, samples, memory, self.sub_timestamps, self.convert, self.condition, self.raw_memory, self.rate)
        rows = list(timed(chunks, start, len(samples) / self.rate, self.sub_timestamps))
        # A segment without words is one row without a chunk, so that what follows knows it has been done.
        rows = rows or [(None, None, None, None, None)]
        return [(key[0], index, *r, len(chunks)) for r in rows], memory.lines()


def transcribe_stream(
    segments: DataFrame, recognizer: Callable, condition: bool = True, sub_timestamps: bool = True,
    convert: Callable[[str], str] | None = None, prior_text: str = "converted", rate: int = RATE,
    hole_timeout_ms: int | None = None, ttl_ms: int | None = None,
) -> DataFrame:
    """Transcript rows of a stream of ``stream_id, segment_idx, start_s, samples`` rows in any order, numbered from 0.

    The same walk as ``recognize.transcribe_segments``, its memory kept as state. ``chunks`` is the number of chunks of the
    segment; one without words is a row with ``chunks`` 0.
    """
    stream_type = segments.schema["stream_id"].dataType.simpleString()
    return segments.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=TranscribeProcessor(
            recognizer, condition, sub_timestamps, convert, prior_text == "raw", rate, hole_timeout_ms, ttl_ms),
        outputStructType=f"stream_id {stream_type}, segment_idx bigint, chunk_idx int, text string, start_s double, end_s double, "
                         "prompt_retry boolean, chunks int",
        outputMode="append", timeMode=_time_mode(hole_timeout_ms, ttl_ms),
    )


class LogProcessor(_Timed):
    """Segments, transcripts and ends in, log rows out, numbered in log order."""

    columns = ["stream_id", "seq", "type", "segment_idx", "chunk_idx", "text", "start_s", "end_s", "prompt_retry"]

    def __init__(self, transcribed: bool, ttl_ms: int | None = None):
        self.transcribed, self.ttl_ms = transcribed, ttl_ms

    def open(self, handle) -> None:
        self.head = handle.getValueState("head", "next bigint, seq bigint, ends bigint", self.ttl_ms)
        self.segments = self.map_state("segments", "segment_idx bigint", "start_s double, end_s double")
        self.texts = self.map_state("texts", "segment_idx bigint", "body string")

    def handleInputRows(self, key, rows, timerValues):
        next_, seq, ends = tuple(self.head.get()) if self.head.exists() else (0, 0, -1)
        out = []

        def put(kind, segment=None, chunk=None, text=None, start=None, end=None, retry=None):
            nonlocal seq
            out.append((key[0], seq, kind, segment, chunk, text, start, end, retry))
            seq += 1

        if seq == 0:
            put("stream_start")
        for pdf in rows:
            for row in pdf.to_dict("records"):
                if row["kind"] == "end":
                    ends = int(row["segment_idx"])
                    continue
                at = (int(row["segment_idx"]),)
                if at[0] < next_:
                    continue
                if row["kind"] == "segment":
                    self.segments.updateValue(at, (float(row["start_s"]), float(row["end_s"])))
                else:
                    doc = json.loads(self.texts.getValue(at)[0]) if self.texts.containsKey(at) else {"n": int(row["chunks"]), "of": {}}
                    if doc["n"]:
                        begin, end = (None if row[c] != row[c] else row[c] for c in ("start_s", "end_s"))
                        doc["of"][str(int(row["chunk_idx"]))] = [row["text"], begin, end, bool(row["prompt_retry"])]
                    self.texts.updateValue(at, (json.dumps(doc),))
        while self.segments.containsKey((next_,)):
            doc = {"n": 0, "of": {}}
            if self.transcribed:
                if not self.texts.containsKey((next_,)):
                    break
                doc = json.loads(self.texts.getValue((next_,))[0])
                if len(doc["of"]) < doc["n"]:
                    break
                self.texts.removeKey((next_,))
            start, end = self.segments.getValue((next_,))
            self.segments.removeKey((next_,))
            put("segment_start", next_, 0, None, start)
            for chunk in sorted(doc["of"], key=int):
                text, begin, stop, retry = doc["of"][chunk]
                if begin is not None:
                    put("transcript", next_, int(chunk), text, begin, stop, retry)
            put("segment_end", next_, 0, None, None, end)
            next_ += 1
        if 0 <= ends <= next_:
            put("stream_end")
            ends = -1
        self.head.update((next_, seq, ends))
        yield pd.DataFrame(out, columns=self.columns, dtype=object)


def log_input(segments: DataFrame | None = None, transcripts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The union that ``merge_log_stream`` takes: closed segments, rows of ``transcribe_stream``, and (stream_id, segments) of ended streams."""
    parts = []
    if segments is not None:
        parts.append(segments.filter("segment_idx is not null").select(
            "stream_id", F.lit("segment").alias("kind"), "segment_idx", "start_s", (F.col("start_s") + F.col("duration_s")).alias("end_s")))
    if transcripts is not None:
        parts.append(transcripts.select(
            "stream_id", F.lit("transcripts").alias("kind"), "segment_idx", "start_s", "end_s", "chunk_idx", "text", "prompt_retry", "chunks"))
    if ends is not None:
        parts.append(ends.select("stream_id", F.lit("end").alias("kind"), F.col("segments").cast("long").alias("segment_idx")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def merge_log_stream(records: DataFrame, transcribed: bool = True, ttl_ms: int | None = None) -> DataFrame:
    """Log rows of all streams in order: ``seq`` counts the records of a stream, whatever order its parts came in.

    A segment is written when all before it are and its transcripts are complete (with ``transcribed``), a
    stream's end when all its segments are. See ``log_input``; ``sink.write_merged_log`` makes records of the rows.
    """
    stream_type = records.schema["stream_id"].dataType.simpleString()
    return records.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=LogProcessor(transcribed, ttl_ms),
        outputStructType=f"stream_id {stream_type}, seq bigint, type string, segment_idx bigint, chunk_idx int, text string, start_s double, "
                         "end_s double, prompt_retry boolean",
        outputMode="append", timeMode=_time_mode(ttl_ms),
    )


def late_windows(segments: DataFrame) -> DataFrame:
    return segments.groupBy("stream_id").agg(F.max("late_windows").alias("late_windows"))
