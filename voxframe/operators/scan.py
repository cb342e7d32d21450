"""Ordered transcript scans: prior state, conditioning prompts, retry plans and splicing.

The rows of one segment are bounded by its hard limit, so windows and lists over
(stream, segment) stay small. Whatever crosses segments is scanned block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import (
    NEAR_DUPLICATE_RATIO, conditioning_context, convert_script, folded, is_near_duplicate_folded,
    is_repetitive, may_be_near_duplicate, strip, with_near_duplicate,
)
from voxframe.operators.ordering import CARRY_BLOCK

RATE = 16000
_SEGMENT = ["stream_id", "segment_idx"]


def _blocked(df: DataFrame, block_size: int) -> DataFrame:
    """One partitioning for everything below: blocks of adjacent segments of a stream."""
    return df.withColumn("block", F.floor(F.col("segment_idx") / block_size)).repartition("stream_id", "block")


def segment_line(
    chunks: DataFrame, separator: str = " ", block_size: int = CARRY_BLOCK, keep: Sequence[str] = ()
) -> DataFrame:
    """Texts of a segment's chunks in order, and the stripped last one.

    ``block`` names the partition group, which the scans over segments use again. With ``keep`` the chunks come along as a
    list ``chunks`` of chunk_idx, text and these columns, so that what follows need not shuffle them a second time.
    """
    last = F.element_at("_c", -1)["text"]
    return (
        _blocked(chunks, block_size).groupBy("stream_id", "block", "segment_idx")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_idx", F.coalesce("text", F.lit("")).alias("text"), *keep))).alias("_c"))
        .select(
            "stream_id", "block", "segment_idx",
            F.array_join(F.transform("_c", lambda c: c["text"]), separator).alias("line"),
            strip(last).alias("last_chunk"), *([F.col("_c").alias("chunks")] if keep else []),
        )
    )


def prior_state(
    lines: DataFrame, segments: DataFrame | None = None, block_size: int = CARRY_BLOCK
) -> DataFrame:
    """``prior_line`` and ``prior_last_chunk`` as each segment finds them.

    ``segments`` may list further segments that have no chunks: they get the state but do
    not change it. ``before_line`` is the unstripped line of the latest earlier segment with
    text and ``before_prior`` what that segment itself found as its prior line.

    Inside a block this is a window; what enters a block comes from a table of one row per
    block. Both are fed by the same shuffle. A list ``chunks`` of ``segment_line`` is kept.
    """
    kept = ["chunks"] if "chunks" in lines.columns else []
    if segments is not None:
        lines = segments.select(*_SEGMENT).join(lines.drop("block"), _SEGMENT, "left")
    if "block" not in lines.columns:
        lines = _blocked(lines, block_size)
    # The join below asks for this on one of its sides only, and then their shuffles would be two.
    lines = lines.filter("stream_id is not null and block is not null")
    inner = Window.partitionBy("stream_id", "block").orderBy("segment_idx").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def latest(column, window):
        return F.last(column, ignorenulls=True).over(window)

    def pair(line, prior):
        return F.when(F.col(line).isNotNull(), F.struct(F.col(line).alias("line"), F.col(prior).alias("prior")))

    inside = lines.withColumn("_own", latest("line", inner)).withColumn("_own_chunk", latest("last_chunk", inner))
    filled = F.when(F.col("line").isNotNull(), F.col("segment_idx"))
    ends = inside.groupBy("stream_id", "block").agg(
        F.max_by("line", filled).alias("_end"), F.max_by("_own", filled).alias("_end_prior"),
        F.max_by("last_chunk", filled).alias("_end_chunk"),
    )
    entering = (
        ends.withColumn("_in", latest("_end", outer)).withColumn("_in_chunk", latest("_end_chunk", outer))
        .withColumn("_end_prior", F.coalesce("_end_prior", "_in"))
        .withColumn("_in_pair", latest(pair("_end", "_end_prior"), outer))
        .select("stream_id", "block", "_in", "_in_chunk", "_in_pair")
    )
    own_pair = latest(pair("line", "_own"), inner)
    joined = inside.withColumn("_own_pair", own_pair).join(entering, ["stream_id", "block"])
    before_prior = F.when(
        F.col("_own_pair").isNotNull(), F.coalesce("_own_pair.prior", "_in")
    ).otherwise(F.col("_in_pair.prior"))
    empty = F.lit("")
    return joined.select(
        *_SEGMENT, "line", "last_chunk", *kept,
        F.coalesce(strip(F.coalesce("_own", "_in")), empty).alias("prior_line"),
        F.coalesce("_own_chunk", "_in_chunk", empty).alias("prior_last_chunk"),
        F.coalesce("_own_pair.line", "_in_pair.line").alias("before_line"),
        F.coalesce(strip(before_prior), empty).alias("before_prior"),
    )


def conditioning_prompts(
    state: DataFrame, condition: bool = True, threshold: float = NEAR_DUPLICATE_RATIO
) -> DataFrame:
    """Add ``prompt``: what the recognizer is fed with each segment ("" for none).

    The prompt of a segment is the conditioning context of the latest earlier segment that
    had text. ``prior_state`` delivers that segment's line and prior line, so the prompt is
    local to the row. It is ``conditioning_context`` in steps: what several tests use is made once, and
    texts that an earlier test rules out are not compared.
    """
    state = state.withColumn("prompt", F.lit(""))
    if condition:
        text = strip(F.coalesce("before_line", F.lit("")))
        state = (
            state.withColumn("_text", text)
            .withColumn("_a", F.when((F.col("_text") != "") & ~is_repetitive(F.col("_text")), F.lower("_text")))
            .withColumn("_b", F.when(F.col("_a").isNotNull(), folded(F.col("before_prior"))))
        )
        near = with_near_duplicate(state, "_a", "_b", threshold, "_near")
        state = near.withColumn("prompt", F.when(F.col("_a").isNull() | F.col("_near"), F.lit("")).otherwise(F.col("_text")))
    return state.select(*_SEGMENT, "line", "last_chunk", "prior_line", "prior_last_chunk", "prompt")


def _near_duplicates(df: DataFrame, current: str, prior: str, threshold: float) -> DataFrame:
    """Rows whose two folded texts are near duplicates; only possible pairs reach Python."""
    a, b = F.col(current), F.col(prior)
    return df.filter(may_be_near_duplicate(a, b, threshold)).filter(is_near_duplicate_folded(a, b, threshold))


def _echoing_lines(state: DataFrame, threshold: float) -> DataFrame:
    folds = state.withColumn("_a", folded(F.col("line"))).withColumn("_b", folded(F.col("prior_line")))
    return _near_duplicates(folds, "_a", "_b", threshold)


def near_duplicate_lines(state: DataFrame, threshold: float = NEAR_DUPLICATE_RATIO) -> DataFrame:
    return _echoing_lines(state, threshold).select(*_SEGMENT, "line", "prior_line")


def plan_retries_single(state: DataFrame, threshold: float = NEAR_DUPLICATE_RATIO) -> DataFrame:
    """Segments to recognize again without their prompt: one text each, echoing the prior line.

    Echoes are rare, so they are found first and prompts are derived for them only.
    """
    echoes = _echoing_lines(state, threshold)
    prompt = conditioning_context(F.col("before_line"), F.col("before_prior"), threshold)
    return (
        echoes.select(*_SEGMENT, "line", "prior_line", prompt.alias("prompt")).filter("prompt != ''")
    )


def _chunk_pairs(state: DataFrame, threshold: float) -> DataFrame:
    """The chunks of each segment's list that may repeat the one before: folded texts of both, with the segment's prior state."""
    own = state.withColumn("_c", F.transform("chunks", lambda c: F.struct(
        c["chunk_idx"].alias("chunk_idx"), c["t0"].alias("t0"), folded(c["text"]).alias("_a"))))
    pairs = F.transform("_c", lambda c, i: F.struct(
        c["chunk_idx"].alias("chunk_idx"), c["t0"].alias("t0"), c["_a"].alias("_a"),
        F.when(i == 0, folded(F.col("prior_last_chunk"))).otherwise(F.get(F.col("_c"), i - 1)["_a"]).alias("_b")))
    some = own.withColumn("_p", pairs).withColumn("_p", F.filter("_p", lambda p: may_be_near_duplicate(p["_a"], p["_b"], threshold)))
    return some.select(*_SEGMENT, "before_line", "before_prior", F.explode("_p").alias("_p")).select(
        *_SEGMENT, "before_line", "before_prior", "_p.*")


def plan_retries_chunks(
    chunks: DataFrame | None,
    state: DataFrame,
    condition: bool = True,
    threshold: float = NEAR_DUPLICATE_RATIO,
    rate: int = RATE,
) -> DataFrame:
    """Where to start again: the first chunk of a segment that echoes its predecessor.

    Chunk 0 is compared with the last chunk of the prior segment and counts only if a
    prompt was used; later chunks always count. No plan is made without a start time.
    Prompts are derived for the segments found, not for all. Without ``chunks`` the state has them as its list ``chunks``
    (``segment_line`` with ``keep=["t0"]``): then only what was found is shuffled.
    """
    order = Window.partitionBy(*_SEGMENT).orderBy("chunk_idx")
    before = state.select(*_SEGMENT, *([] if chunks is not None else ["chunks"]), *[
        F.col(c) if condition else F.lit("").alias(c) for c in ("prior_last_chunk", "before_line", "before_prior")
    ])
    compared = _chunk_pairs(before, threshold) if chunks is None else (
        chunks.select(*_SEGMENT, "chunk_idx", "t0", folded(F.col("text")).alias("_a"))
        .join(before, _SEGMENT)
        .withColumn("_b", F.when(F.row_number().over(order) == 1, folded(F.col("prior_last_chunk"))).otherwise(F.lag("_a").over(order)))
    )
    found = _near_duplicates(compared, "_a", "_b", threshold).groupBy(*_SEGMENT).agg(
        F.min("chunk_idx").alias("repeat_idx"),
        F.min_by("t0", "chunk_idx").alias("trim_start_s"),
        F.first("before_line").alias("before_line"),
        F.first("before_prior").alias("before_prior"),
    )
    prompt = conditioning_context(F.col("before_line"), F.col("before_prior"), threshold)
    return (
        found.filter("trim_start_s is not null")
        .withColumn("prompt", prompt)
        .filter("repeat_idx >= 1 or prompt != ''")
        .select(
            *_SEGMENT, "repeat_idx", "trim_start_s",
            (F.col("trim_start_s") * rate).cast("long").alias("trim_start_samples"),
        )
    )


def splice_retries(chunks: DataFrame, plans: DataFrame, retried: DataFrame) -> DataFrame:
    """Chunks before the planned index, then the retried ones moved to their place in time.

    Retried chunks are numbered from 0 and timed from the trim point. ``prompt_retry`` is
    true from the planned index on.
    """
    plan = plans.select(*_SEGMENT, "repeat_idx", "trim_start_s")
    kept = (
        chunks.join(plan, _SEGMENT, "left")
        .filter(F.col("repeat_idx").isNull() | (F.col("chunk_idx") < F.col("repeat_idx")))
        .select(*_SEGMENT, F.col("chunk_idx").cast("int").alias("chunk_idx"), "text", "t0", "t1",
                F.lit(False).alias("prompt_retry"))
    )
    order = Window.partitionBy(*_SEGMENT).orderBy("chunk_idx")
    moved = retried.join(plan, _SEGMENT).select(
        *_SEGMENT,
        (F.col("repeat_idx") + F.row_number().over(order) - 1).cast("int").alias("chunk_idx"),
        "text",
        (F.col("t0") + F.col("trim_start_s")).alias("t0"),
        (F.col("t1") + F.col("trim_start_s")).alias("t1"),
        F.lit(True).alias("prompt_retry"),
    )
    return kept.unionByName(moved)


def to_absolute_times(chunks: DataFrame, segments: DataFrame, rate: int = RATE) -> DataFrame:
    """Chunk times on the stream's clock; a missing end is the segment's end.

    A chunk without a start keeps its row with ``error`` set and null times.
    """
    place = segments.select(*_SEGMENT, F.col("start_s").alias("_start"), (F.col("n_samples") / rate).alias("_len"))
    bad = F.col("t0").isNull()
    return chunks.join(place, _SEGMENT).select(
        *_SEGMENT, "chunk_idx", "text",
        (F.col("_start") + F.col("t0")).alias("start_s"),
        F.when(~bad, F.col("_start") + F.coalesce("t1", "_len")).alias("end_s"),
        "prompt_retry",
        F.when(bad, F.lit("chunk has no start time")).alias("error"),
    )


def whole_segment_times(lines: DataFrame, segments: DataFrame, rate: int = RATE) -> DataFrame:
    """One text per segment, spanning all of it."""
    place = segments.select(*_SEGMENT, "start_s", "n_samples")
    return lines.join(place, _SEGMENT).select(
        *_SEGMENT, F.lit(0).alias("chunk_idx"), F.col("line").alias("text"), "start_s",
        (F.col("start_s") + F.col("n_samples") / rate).alias("end_s"),
    )


def flag_retried(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    plan = plans.select(*_SEGMENT, "repeat_idx")
    return chunks.join(plan, _SEGMENT, "left").withColumn(
        "prompt_retry", F.coalesce(F.col("chunk_idx") >= F.col("repeat_idx"), F.lit(False))
    ).drop("repeat_idx")


def concat_results(results: DataFrame) -> DataFrame:
    """First alternative of each result in order, joined without separator and stripped.

    A segment whose results are all empty keeps its row, with blank text.
    """
    return (
        results.groupBy(*_SEGMENT)
        .agg(F.array_sort(F.collect_list(F.when(
            F.size("alternatives") > 0, F.struct("result_idx", F.get("alternatives", F.lit(0)).alias("t"))
        ))).alias("_r"))
        .select(*_SEGMENT, strip(F.array_join(F.transform("_r", lambda r: r["t"]), "")).alias("text"))
    )


def token_budget(segments: DataFrame, rate: int = RATE, cap: int = 448) -> DataFrame:
    """Add ``max_tokens`` from the segment's length and its model family.

    ``family`` is ``streaming``, ``non_streaming`` or ``fixed``.
    """
    # Tokens per second of the two families, and the flat budget of the third.
    scaled = F.when(F.col("family") == "streaming", F.lit(6.5 / rate)).otherwise(F.lit(13 / rate))
    tokens = F.greatest(F.lit(2), (F.col("n_samples") * scaled).cast("int"))
    return segments.withColumn(
        "max_tokens",
        F.when(F.col("family") == "fixed", F.lit(500))
        .when(F.col("family") == "streaming", F.least(tokens, F.lit(cap)))
        .otherwise(tokens),
    )


def finish_text(
    transcripts: DataFrame, source: str = "", target: str = "", mode: str = "none",
    languages: list[str] | None = None,
) -> DataFrame:
    """Script conversion of transcript text, for all rows or for some ``language`` values."""
    converted = convert_script(F.col("text"), source, target, mode)
    if languages is not None:
        converted = F.when(F.col("language").isin(*languages), converted).otherwise(F.col("text"))
    return transcripts.withColumn("text", converted)


def recovery_audit(log: DataFrame) -> DataFrame:
    """Retried and clipped transcript rows per stream and clipped pattern, with subtotals.

    ``pattern`` is null on a stream's subtotal and both keys are null on the total;
    ``level`` tells them apart (0 pattern, 1 stream, 3 all).
    """
    return (
        log.select("stream_id", "prompt_retry", F.explode_outer("repetition_patterns_clipped").alias("pattern"))
        .rollup("stream_id", "pattern")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("prompt_retry")).alias("retried"),
            F.count("pattern").alias("clipped"),
            F.grouping_id().cast("int").alias("level"),
        )
    )
