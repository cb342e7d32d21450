"""Activity segmentation over DataFrames of flagged windows.

Input rows are ``stream_id, window_idx, is_speech`` with ``window_idx`` counting from 0;
a missing window counts as non-speech. A stream is cut into blocks of ``BLOCK`` windows,
one row per block holding the offsets of its speech windows, packed on the map side. So a task
holds one Arrow batch of blocks, whose bytes are bounded, however long the stream is.

What a block needs from its predecessor is the fold's state. Many blocks contain a silence
long enough to make their exit state independent of their entry state. The others report
what they do to every entry state at once (``transitions.StateMap``); for most of them all states
become one within a few pauses. The maps that are left are composed pairwise, each round over
twice as many blocks as the one before, so a stream of n blocks that never pauses is settled in log n
rounds, all blocks side by side. Then all blocks are folded in parallel.

Options are one ``SegmentOptions`` for all streams, or a struct column ``options`` of the windows, the
same for all windows of a stream: streams with different limits are segmented in one pass.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators import transitions
from voxframe.operators.fold import STATE_DDL, STATE_FIELDS, SegmentFold, SegmentOptions
from voxframe.operators.ordering import carry_forward
from voxframe.session import materialize

BLOCK = 32768
# At most this many adjacent blocks of pure speech become one row.
SOLID_BLOCKS = 1024
# Rows per output batch of the live state, each a stretch of windows.
LIVE_ROWS = 20000

# What the struct column ``options`` may have; what it has not, or null, is the default.
OPTION_FIELDS = ("rate", "window", "min_speech_s", "soft_limit_s", "hard_limit_s", "min_silence_ms", "look_back_s", "discard_open")
# A soft limit that is null means none, so that the default has to be asked for by this value.
DEFAULT_SOFT = -1.0

_KEY = ["stream_id", "block"]
_SEGMENT_DDL = "struct<start_sample:bigint,n_samples:bigint,shift:bigint,end_reason:string>"


@lru_cache(maxsize=4096)
def _options_of(values: tuple, default: SegmentOptions) -> SegmentOptions:
    given = dict(values)
    soft = given.pop("soft_limit_s", DEFAULT_SOFT)
    given = {k: v for k, v in given.items() if v is not None}
    if soft != DEFAULT_SOFT:
        given["soft_limit_s"] = soft
    base = {f: getattr(default, f) for f in default.__dataclass_fields__}
    if "rate" in given and "window" not in given:
        base["window"] = None
    return SegmentOptions(**(base | given))


def row_options(value, default: SegmentOptions) -> SegmentOptions:
    """The options of a row with a struct ``value``, or the ones for all streams."""
    if value is None:
        return default
    given = value if isinstance(value, dict) else value.asDict()
    plain = ((k, None if v is None or v != v else v.item() if isinstance(v, np.generic) else v) for k, v in given.items())
    return _options_of(tuple((k, int(v) if v is not None and k in ("rate", "window") else v) for k, v in plain if k in OPTION_FIELDS), default)


def _pack(windows: DataFrame, block_windows: int) -> DataFrame:
    """One row per (stream, block): last window seen, sorted offsets of speech windows, options."""
    idx = F.col("window_idx")
    own = "options" in windows.columns
    return (
        windows.select(
            "stream_id",
            (F.col("options") if own else F.lit(None).cast("struct<rate:int>")).alias("_options"),
            F.floor(idx / block_windows).alias("block"),
            (idx % block_windows).cast("int").alias("_offset"),
            F.col("is_speech").alias("_speech"),
        )
        .groupBy(*_KEY)
        .agg(
            (F.max("_offset") + 1).cast("long").alias("_len"),
            F.sort_array(F.collect_list(F.when(F.col("_speech"), F.col("_offset")))).alias("offsets"),
            F.first("_options").alias("options"),
        )
        .select(
            *_KEY, "options",
            (F.col("block") * block_windows).alias("first"),
            (F.col("block") * block_windows + F.col("_len")).alias("end"),
            "offsets",
        )
    )


def _link(blocks: DataFrame, block_windows: int) -> DataFrame:
    """Join blocks of pure speech into one and tell each block what precedes it.

    Within a stream only the last block may be cut short, so all others reach their full
    length: windows missing at their end are silent ones. A row of adjacent blocks that
    are speech throughout is a single run, which the fold handles in closed form.
    """
    order = Window.partitionBy("stream_id").orderBy("block")
    behind = Window.partitionBy("stream_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = blocks.select(
        *_KEY, "end", (F.size("offsets") == block_windows).alias("solid"),
        (F.col("first") + F.get("offsets", F.lit(0))).alias("speech"),
    ).select(
        *_KEY, "speech",
        F.when(F.lead("block").over(order).isNull(), F.col("end"))
        .otherwise((F.col("block") + 1) * block_windows).alias("end"),
        F.when(
            F.col("solid") & F.lag("solid").over(order)
            & (F.lag("block").over(order) == F.col("block") - 1)
            & (F.col("block") % SOLID_BLOCKS != 0), 0,
        ).otherwise(1).alias("_new"),
    )
    merged = (
        edges.withColumn("_group", F.sum("_new").over(order))
        .groupBy("stream_id", "_group")
        .agg(F.min("block").alias("block"), F.max("end").alias("end"), F.min("speech").alias("speech"))
        .select(
            *_KEY, "end",
            F.last("speech", ignorenulls=True).over(behind).alias("next_speech"),
            F.lag("block").over(order).alias("prev_block"),
            F.coalesce(F.lag("end").over(order), F.lit(0)).alias("prev_end"),
            F.lead("block").over(order).isNull().alias("is_last"),
        )
    )
    return blocks.drop("end").join(merged, _KEY)


def _runs(first: int, end: int, offsets: np.ndarray, block_windows: int):
    """Alternating (first window, length, is speech) runs that cover [first, end)."""
    at = first
    if len(offsets) == block_windows:
        yield first, end - first, True
        return
    if len(offsets):
        breaks = np.flatnonzero(np.diff(offsets) != 1)
        starts = offsets[np.concatenate(([0], breaks + 1))].tolist()
        stops = offsets[np.concatenate((breaks, [len(offsets) - 1]))].tolist()
        for a, b in zip(starts, stops):
            a, b = first + a, first + b + 1
            if a > at:
                yield at, a - at, False
            yield a, b - a, True
            at = b
    if end > at:
        yield at, end - at, False


def _last_quiet_cut(
    first: int, end: int, offsets: np.ndarray, quiet: int, block_windows: int
) -> int | None:
    """Last window of the block that surely finds the detector idle with a full look-back."""
    if len(offsets) == block_windows:
        return None
    if end - first - (int(offsets[-1]) + 1 if len(offsets) else 0) >= quiet:
        return end
    gaps = np.diff(offsets, prepend=-1) - 1
    hits = np.flatnonzero(gaps >= quiet)
    return first + int(offsets[hits[-1]]) if len(hits) else None


def _state_of(value):
    return None if value is None else tuple(value[f] for f in STATE_FIELDS)


def _settled_exit(row, options: SegmentOptions, block_windows: int) -> SegmentFold | None:
    """The fold after a block that does not depend on its entry, or None: the first of a stream, or one with a long pause."""
    offsets = np.asarray(row.offsets, dtype=np.int64)
    quiet = options.quiet_windows
    cut = None if quiet is None else _last_quiet_cut(row.first, row.end, offsets, quiet, block_windows)
    fold = SegmentFold(options)
    if cut is not None:
        fold.idle_with_look_back(options.back_windows)
        kept = offsets[offsets >= cut - row.first] - (cut - row.first)
        todo = _runs(cut, row.end, kept, block_windows)
    elif row.prev_end == 0:
        fold.feed(0, row.first, False)
        todo = _runs(row.first, row.end, offsets, block_windows)
    else:
        return None
    for run in todo:
        fold.feed(*run)
        fold.out.clear()
    return fold


def _speech_runs(row, end: int, block_windows: int) -> list[tuple[int, int, bool]]:
    """The runs of a block from its first speech window on, the last silence up to ``end``."""
    runs = list(_runs(row.first, row.end, np.asarray(row.offsets, dtype=np.int64), block_windows))
    runs = runs if runs[0][2] else runs[1:]
    if end > row.end:
        at, n, speech = runs[-1]
        runs[-1:] = [(at, n, True), (row.end, end - row.end, False)] if speech else [(at, end - at, False)]
    return runs


_REPORT = ["settled", "base", "exit", "x", "shift", "map"]


def _report_row(row, options: SegmentOptions, block_windows: int) -> tuple:
    """What a block does: its exit if that is settled, and the state before the next speech window or a map to it."""
    fold = _settled_exit(row, options, block_windows)
    follows = row.next_speech is not None and row.next_speech == row.next_speech
    if fold is not None:
        state = dict(zip(STATE_FIELDS, fold.state()))
        if follows:
            fold.feed(row.end, int(row.next_speech) - row.end, False)
        return True, True, state, *transitions.entering(fold), None
    if not len(row.offsets):
        return False, False, None, None, None, None
    if not follows:
        return False, True, None, None, None, None
    found = transitions.stretch_map(options, _speech_runs(row, int(row.next_speech), block_windows))
    if found.is_constant:
        return False, True, None, int(found.value[0]), int(found.shift[0]), None
    return False, True, None, None, None, found.pack()


def _per_block(work, names: list[str], options: SegmentOptions, block_windows: int):
    """Apply ``work`` to each row: (stream, block, *result)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(
                [(row.stream_id, row.block, *work(row, row_options(row.options, options), block_windows)) for row in pdf.itertuples(index=False)],
                columns=[*_KEY, *names], dtype=object)

    return run


def _compose_row(row, options: SegmentOptions, block_windows: int) -> tuple:
    """A map after what lies before it: a state, or the map of as many blocks."""
    own = transitions.StateMap.unpack(row.map)
    if row.before_map is None:
        return row.pos, *own.apply(int(row.before_x), int(row.before_shift), options), None
    both = transitions.StateMap.unpack(row.before_map).then(own, options)
    if both.is_constant:
        return row.pos, int(both.value[0]), int(both.shift[0]), None
    return row.pos, None, None, both.pack()


def _exit_row(row, options: SegmentOptions, block_windows: int) -> tuple:
    """The exit of a block with speech, from the state before its first speech window."""
    runs = _speech_runs(row, row.end, block_windows)
    fold = transitions.entered(options, runs[0][0], int(row.x), int(row.shift))
    for run in runs:
        fold.feed(*run)
        fold.out.clear()
    return (dict(zip(STATE_FIELDS, fold.state())),)


def _silent_exit_row(row, options: SegmentOptions, block_windows: int) -> tuple:
    fold = SegmentFold(options, _state_of(row.base_exit))
    fold.feed(int(row.base_end), row.end - int(row.base_end), False)
    return (dict(zip(STATE_FIELDS, fold.state())),)


def _fold_blocks(options: SegmentOptions, block_windows: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                own = row_options(row.options, options)
                fold = SegmentFold(own, _state_of(row.entry))
                fold.feed(row.prev_end, row.first - row.prev_end, False)
                for part in _runs(row.first, row.end, np.asarray(row.offsets, dtype=np.int64), block_windows):
                    fold.feed(*part)
                if row.is_last:
                    fold.finish()
                rows.append((row.stream_id, row.block, own.rate, [
                    {"start_sample": s, "n_samples": n, "shift": sh, "end_reason": why}
                    for s, n, sh, why in fold.out
                ]))
            yield pd.DataFrame(rows, columns=[*_KEY, "rate", "segments"])

    return run


def _live_pieces(fold: SegmentFold, first: int, n: int, speech: bool):
    """(first window, windows, in speech, samples behind the first one, samples more per window, idle) for a run: stretches in which
    the state grows window by window."""
    w, left = fold.o.window, n
    while left:
        if not speech and not fold.in_speech:
            fold.feed(first, left, False)
            yield first, left, False, 0, 0, True
            return
        base = transitions.entering(fold)[0]
        if speech:
            # As long as the hard limit is not reached.
            taken = min(left, max(0, (fold.hard - base - 1) // w))
            fold.feed(first, taken, True)
        else:
            taken = 0
            while taken < left:
                fold.feed(first + taken, 1, False)
                if fold.out:
                    break
                taken += 1
        if taken:
            yield first, taken, True, base + w, w, False
            first, left = first + taken, left - taken
        if speech and left:
            fold.feed(first, 1, True)
        if left:
            # The window at which something closed.
            fold.out.clear()
            yield first, 1, fold.in_speech, fold.speech + fold.silence, 0, False
            first, left = first + 1, left - 1


def _live_blocks(options: SegmentOptions, block_windows: int):
    names = ["stream_id", "first", "n", "in_speech", "samples", "step", "idle", "rate", "window"]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                own = row_options(row.options, options)
                fold = SegmentFold(own, _state_of(row.entry))
                fold.feed(row.prev_end, row.first - row.prev_end, False)
                fold.out.clear()
                for part in _runs(row.first, row.end, np.asarray(row.offsets, dtype=np.int64), block_windows):
                    rows += [(row.stream_id, *piece, own.rate, own.window) for piece in _live_pieces(fold, *part)]
                    if len(rows) >= LIVE_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def _with_entry(blocks: DataFrame, states: DataFrame) -> DataFrame:
    before = states.select(
        "stream_id", F.col("block").alias("prev_block"), F.col("exit").alias("entry")
    )
    return blocks.join(before, ["stream_id", "prev_block"], "left")


def _linked_blocks(windows: DataFrame, options: SegmentOptions, block_windows: int, plans: DataFrame | None = None) -> DataFrame:
    """Blocks with their final entry state."""
    linked = _link(materialize(_pack(windows, block_windows)), block_windows)
    if plans is not None:
        own = plans.select("stream_id", F.col("plan").alias("_plan"), F.col("options").alias("_options"))
        linked = linked.join(own, "stream_id").withColumns({"stream_id": F.col("_plan"), "options": F.col("_options")}).drop("_plan", "_options")
    blocks = materialize(linked)
    stream_type = blocks.schema["stream_id"].dataType.simpleString()
    key = f"stream_id {stream_type}, block bigint"

    def each(df: DataFrame, work, names: list[str], ddl: str) -> DataFrame:
        return df.mapInPandas(_per_block(work, names, options, block_windows), f"{key}, {ddl}")

    report = materialize(each(
        blocks, _report_row, _REPORT, f"settled boolean, base boolean, exit {STATE_DDL}, x bigint, shift bigint, map binary"))
    exits = report.filter("settled").select(*_KEY, "exit")
    if report.filter("not settled").isEmpty():
        return _with_entry(blocks, exits)

    # Blocks with speech, or settled, in order; one narrow row each.
    order = Window.partitionBy("stream_id").orderBy("block")
    placed = materialize(
        report.filter("base").select(*_KEY, "settled", "x", "shift", "map", F.row_number().over(order).cast("long").alias("pos")))
    known = placed.filter("x is not null").select("stream_id", "pos", "x", "shift")
    waiting = placed.filter("map is not null").join(
        blocks.select(*_KEY, "options"), _KEY).select(*_KEY, "options", "pos", "map")
    step = 1
    while not waiting.isEmpty():
        # Each map covers ``step`` blocks; what lies before them is a state by now, or a map of as many.
        before = known.select("stream_id", "pos", "x", "shift", F.lit(None).cast("binary").alias("map")).unionByName(
            waiting.select("stream_id", "pos", F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("shift"), "map"))
        pairs = waiting.join(
            before.select("stream_id", (F.col("pos") + step).alias("pos"), F.col("x").alias("before_x"),
                          F.col("shift").alias("before_shift"), F.col("map").alias("before_map")), ["stream_id", "pos"])
        done = materialize(each(pairs, _compose_row, ["pos", "x", "shift", "map"], "pos bigint, x bigint, shift bigint, map binary"))
        known = known.unionByName(done.filter("x is not null").select("stream_id", "pos", "x", "shift"))
        waiting = done.filter("map is not null").join(waiting.select(*_KEY, "options"), _KEY).select(*_KEY, "options", "pos", "map")
        step *= 2
    entries = (
        placed.filter("not settled").select(*_KEY, "pos")
        .join(known.select("stream_id", (F.col("pos") + 1).alias("pos"), "x", "shift"), ["stream_id", "pos"]).drop("pos"))
    spoken = materialize(each(blocks.join(entries, _KEY), _exit_row, ["exit"], f"exit {STATE_DDL}"))
    exits = exits.unionByName(spoken)
    # Blocks shorter than a settling pause may hold silence only.
    silent = report.select(*_KEY, "base", F.last(F.when(F.col("base"), F.col("block")), ignorenulls=True).over(order).alias("base_block"))
    bases = exits.join(blocks.select(*_KEY, "end"), _KEY).select(
        "stream_id", F.col("block").alias("base_block"), F.col("exit").alias("base_exit"), F.col("end").alias("base_end"))
    quiet = blocks.join(silent.filter(~F.col("base")).drop("base"), _KEY).join(bases, ["stream_id", "base_block"])
    return _with_entry(blocks, materialize(exits.unionByName(each(quiet, _silent_exit_row, ["exit"], f"exit {STATE_DDL}"))))


def segment_activity(
    windows: DataFrame, options: SegmentOptions | None = None, block_windows: int = BLOCK,
    plans: DataFrame | None = None, **named
) -> DataFrame:
    """Segments of each stream: ``segment_idx, start_sample, n_samples, start_s, duration_s, end_reason``.

    ``options`` (or ``named`` ones) hold for all streams; a struct column ``options`` of ``windows`` takes their place
    where its fields (OPTION_FIELDS) are not null. A soft limit of null means none, one of DEFAULT_SOFT the default.

    ``plans`` (stream_id, plan, options) has the streams segmented by several options each: the windows are packed once per stream, and
    the results have the plan in the place of the stream.
    """
    options = options or SegmentOptions(**named)
    blocks = _linked_blocks(windows, options, block_windows, plans)
    stream_type = blocks.schema["stream_id"].dataType.simpleString()
    folded = materialize(blocks.mapInPandas(
        _fold_blocks(options, block_windows), f"stream_id {stream_type}, block bigint, rate int, segments array<{_SEGMENT_DDL}>"
    ))
    earlier = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = folded.select(*_KEY, F.size("segments").alias("_n")).select(
        *_KEY, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    shift = F.col("s.shift") if options.compat_start else F.lit(0)
    return (
        folded.filter(F.size("segments") > 0)
        .join(counts, _KEY)
        .select("stream_id", "rate", "_before", F.posexplode("segments").alias("_i", "s"))
        .select(
            "stream_id",
            (F.col("_before") + F.col("_i")).alias("segment_idx"),
            "s.start_sample",
            "s.n_samples",
            (F.greatest(F.col("s.start_sample") - shift, F.lit(0)) / F.col("rate")).alias("start_s"),
            (F.col("s.n_samples") / F.col("rate")).alias("duration_s"),
            "s.end_reason",
        )
    )


def segment_activity_with_resets(
    windows: DataFrame, options: SegmentOptions | None = None, block_windows: int = BLOCK, **named
) -> DataFrame:
    """Segments of streams with control rows: before a window with ``is_reset`` the detector forgets everything.

    An open segment is discarded there, look-back and silence start anew; numbering and positions go on. Each stretch
    between resets is a stream of its own for ``segment_activity``, so resets cost one value carried along the windows. A control row may
    stand for a window (``is_speech`` true or false) or for none (null); it counts as one that is not speech then.
    """
    options = options or SegmentOptions(**named)
    w = options.window
    marked = windows.select("stream_id", "window_idx", F.coalesce("is_speech", F.lit(False)).alias("is_speech"),
                            F.when(F.col("is_reset"), F.col("window_idx")).alias("_reset"))
    placed = materialize(carry_forward(marked, "stream_id", "window_idx", {"_reset": "_before"}).select(
        "stream_id", "window_idx", "is_speech", F.coalesce("_reset", "_before", F.lit(0).cast("long")).alias("origin"), "_reset",
        F.coalesce("_before", F.lit(0).cast("long")).alias("_before")))
    # The windows up to a reset belong to the stretch before it, those without a row too.
    ends = placed.filter("_reset is not null and _reset > _before").select(
        "stream_id", (F.col("_reset") - 1).alias("window_idx"), F.lit(False).alias("is_speech"), F.col("_before").alias("origin"))
    last = placed.groupBy("stream_id").agg(F.max("origin").alias("_last"))
    stretches = placed.select("stream_id", "window_idx", "is_speech", "origin").unionByName(ends).join(last, "stream_id")
    key = F.struct("stream_id", "origin")
    cut = segment_activity(stretches.select(
        key.alias("stream_id"), (F.col("window_idx") - F.col("origin")).alias("window_idx"), "is_speech",
        F.struct((F.col("origin") < F.col("_last")).alias("discard_open")).alias("options")), options, block_windows)
    own = cut.select("stream_id.*", "segment_idx", "start_sample", "n_samples", "start_s", "duration_s", "end_reason")
    counts = own.groupBy("stream_id", "origin").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("stream_id").orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("stream_id", "origin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    return own.join(before, ["stream_id", "origin"]).select(
        "stream_id", (F.col("_earlier") + F.col("segment_idx")).alias("segment_idx"),
        (F.col("origin") * w + F.col("start_sample")).alias("start_sample"), "n_samples",
        # In whole samples, as one division.
        ((F.col("origin") * w + F.rint(F.col("start_s") * options.rate)) / options.rate).alias("start_s"), "duration_s", "end_reason")


def segment_activity_with_scorer(
    windows: DataFrame, scorer, options: SegmentOptions | None = None, threshold: float = 0.5, **named
) -> DataFrame:
    """Segments where the score itself depends on the segmentation.

    ``scorer()`` builds a stateful object per task with ``score(samples) -> float`` and
    ``reset()``. It is reset at the start of a stream and whenever a segment closes, so each
    score depends on all windows before it: a stream is one walk over sorted rows, with the
    fold's few numbers and the scorer as only memory. Give precomputed probabilities to
    ``segment_activity`` wherever this feedback is not needed; that form is parallel.
    """
    options = options or SegmentOptions(**named)
    names = ["stream_id", "segment_idx", "start_sample", "n_samples", "start_s", "duration_s", "end_reason"]
    stream_type = windows.schema["stream_id"].dataType.simpleString()

    def run(batches):
        model, current, fold, count, at = scorer(), None, None, 0, 0

        def closed():
            nonlocal count
            rows = []
            for start, n, shift, why in fold.out:
                early = max(0, start - (shift if options.compat_start else 0)) / options.rate
                rows.append((current, count, start, n, early, n / options.rate, why))
                count += 1
            if rows:
                model.reset()
                fold.out.clear()
            return rows

        for pdf in batches:
            rows = []
            for stream, index, samples in pdf.itertuples(index=False, name=None):
                if fold is None or stream != current:
                    if fold is not None:
                        fold.finish()
                        rows += closed()
                    current, fold, count, at = stream, SegmentFold(options), 0, 0
                    model.reset()
                fold.feed(at, index - at, False)
                rows += closed()
                fold.feed(index, 1, model.score(np.asarray(samples, dtype=np.float32)) > threshold)
                rows += closed()
                at = index + 1
            yield pd.DataFrame(rows, columns=names)
        if fold is not None:
            fold.finish()
            yield pd.DataFrame(closed(), columns=names)

    ordered = windows.select("stream_id", "window_idx", "samples").repartition("stream_id")
    return ordered.sortWithinPartitions("stream_id", "window_idx").mapInPandas(
        run,
        f"stream_id {stream_type}, segment_idx bigint, start_sample bigint, n_samples bigint, start_s double, "
        "duration_s double, end_reason string",
    )


def live_state(
    windows: DataFrame, options: SegmentOptions | None = None, block_windows: int = BLOCK, **named
) -> DataFrame:
    """Detector state after each window. Tasks tell stretches in which it grows evenly; windows are made of them natively.

    ``pending_window_s`` is one window while idle and null otherwise, as the historic
    counter kept it; ``gap_metrics`` gives the true length of a pause.
    """
    options = options or SegmentOptions(**named)
    stream_type = windows.schema["stream_id"].dataType.simpleString()
    pieces = _linked_blocks(windows, options, block_windows).mapInPandas(
        _live_blocks(options, block_windows),
        f"stream_id {stream_type}, first bigint, n bigint, in_speech boolean, samples bigint, step bigint, idle boolean, rate int, window int")
    return pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select(
        "stream_id", (F.col("first") + F.col("i")).alias("window_idx"), "in_speech",
        ((F.col("samples") + F.col("i") * F.col("step")) / F.col("rate")).alias("segment_seconds"),
        F.when(F.col("idle"), F.col("window") / F.col("rate")).alias("pending_window_s"))


def activity_runs(
    windows: DataFrame, max_gap_windows: int = 0, window: int = 512, rate: int = 16000,
    block_windows: int = BLOCK,
) -> DataFrame:
    """Runs of speech, joined over at most ``max_gap_windows`` windows of silence.

    Gaps and islands on the speech windows alone, per block; only the first and last run
    of each block can reach into another block and take part in a second joining.
    """
    reach = max_gap_windows + 1
    block = Window.partitionBy("stream_id", "block")
    order = block.orderBy("window_idx")
    inside = (
        windows.filter("is_speech")
        .select("stream_id", F.floor(F.col("window_idx") / block_windows).alias("block"), "window_idx")
        .withColumn("_gap", F.col("window_idx") - F.lag("window_idx").over(order))
        .withColumn("_run", F.sum(F.when(F.col("_gap") > reach, 1).otherwise(0)).over(order))
        .groupBy("stream_id", "block", "_run")
        .agg(F.min("window_idx").alias("first"), F.max("window_idx").alias("last"))
        .withColumn("_edge", (F.col("_run") == 0) | (F.col("_run") == F.max("_run").over(block)))
    )
    stream = Window.partitionBy("stream_id").orderBy("first")
    joined = (
        inside.filter("_edge")
        .withColumn("_gap", F.col("first") - F.lag("last").over(stream))
        .withColumn("_id", F.sum(F.when(F.col("_gap") > reach, 1).otherwise(0)).over(stream))
        .groupBy("stream_id", "_id")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_id")
    )
    closed = inside.filter(~F.col("_edge")).select("stream_id", "first", "last")
    n_samples = (F.col("last") - F.col("first") + 1) * window
    return joined.unionByName(closed).select(
        "stream_id",
        F.col("first").alias("first_window"),
        F.col("last").alias("last_window"),
        (F.col("first") * window).alias("start_sample"),
        n_samples.alias("n_samples"),
        (F.col("first") * window / rate).alias("start_s"),
        (n_samples / rate).alias("duration_s"),
    )


def activity_sessions(
    marks: DataFrame, gap: str, key: str = "stream_id", ts: str = "ts", watermark: str | None = None
) -> DataFrame:
    """Runs of activity in event time: per key, marks at most ``gap`` apart, as ``session_window`` joins them.

    ``marks`` has one row per moment of activity. The form of ``activity_runs`` for rows that have a time and no number: batch, or a
    stream with ``watermark`` (a delay such as "10 minutes"), where a run comes out when the watermark has passed its end. A run is
    summed up per task before it travels; marks without a time belong to none.
    """
    rows = marks.filter(F.col(ts).isNotNull())
    if watermark is not None:
        rows = rows.withWatermark(ts, watermark)
    return (
        rows.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("_session"))
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("marks"))
        .select(key, "first_ts", "last_ts", "marks",
                (F.timestamp_diff("MICROSECOND", "first_ts", "last_ts") / 1_000_000).alias("duration_s"))
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("duration_s").alias("speech_s")
    )


def gap_metrics(segments: DataFrame, rate: int = 16000) -> DataFrame:
    """Non-speech between a segment and the one before it (or the start of the stream)."""
    placed = segments.withColumn("_end", F.col("start_sample") + F.col("n_samples"))
    return carry_forward(placed, "stream_id", "segment_idx", {"_end": "_prev_end"}).select(
        "stream_id", "segment_idx", "start_sample", "n_samples",
        (F.col("start_sample") - F.coalesce("_prev_end", F.lit(0))).alias("gap_samples"),
    ).withColumn("gap_s", F.col("gap_samples") / rate)
