"""Sample chunks to fixed count windows, scoring, resampling and progress.

Chunks carry ``start_sample``, so every step places samples by position: no scan over a
stream is needed, and a stream spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.operators.ordering import running_total


def with_offsets(chunks: DataFrame) -> DataFrame:
    """Add ``start_sample`` to chunks that only know their order."""
    sized = chunks.withColumn("_size", F.size("samples").cast("long"))
    return running_total(sized, "stream_id", "chunk_seq", "_size", "start_sample").drop("_size")


def frame(chunks: DataFrame, size: int = 512, rate: int = 16000, aligned: bool = False) -> DataFrame:
    """Tumbling windows of ``size`` samples across chunk borders; an incomplete last one is dropped.

    Windows that lie inside one chunk are cut in place. Only the pieces at the two borders
    of a chunk are shuffled and put together. ``aligned`` says that no window lies across two chunks, as
    in the chunks of a ``WavCorpus``: then the chunks are read once and nothing is shuffled.
    """
    start = F.col("start_sample")
    end = start + F.size("samples")
    filled = chunks.filter(F.size("samples") > 0).select("stream_id", "start_sample", "samples")
    first_inside, after_inside = F.floor((start + (size - 1)) / size), F.floor(end / size)
    # A chunk shorter than two windows may hold none completely.
    inside = F.when(first_inside < after_inside, F.sequence(first_inside, after_inside - 1))
    whole = filled.select(
        "stream_id", "start_sample", "samples", F.explode(inside).alias("window_idx")
    ).select(
        "stream_id", "window_idx",
        F.slice("samples", (F.col("window_idx") * size - start + 1).cast("int"), F.lit(size)).alias("samples"),
    )
    placed = ["stream_id", "window_idx", (F.col("window_idx") * size).alias("start_sample"),
              (F.col("window_idx") * size / rate).alias("ts"), "samples"]
    if aligned:
        return whole.select(*placed)
    borders = _border_windows(start, end, size)
    joined = (
        filled.select("stream_id", "start_sample", "samples", F.explode(borders).alias("window_idx"))
        .withColumn("_at", F.greatest(F.col("window_idx") * size, start))
        .withColumn("_n", F.least((F.col("window_idx") + 1) * size, end) - F.col("_at"))
        .select(
            "stream_id", "window_idx", "_at",
            F.slice("samples", (F.col("_at") - start + 1).cast("int"), F.col("_n").cast("int")).alias("samples"),
        )
        .groupBy("stream_id", "window_idx")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "samples"))).alias("_parts"))
        .select(
            "stream_id", "window_idx",
            F.flatten(F.transform("_parts", lambda p: p["samples"])).alias("samples"),
        )
        .filter(F.size("samples") == size)
    )
    return whole.unionByName(joined).select(*placed)


def _border_windows(start: Column, end: Column, size: int) -> Column:
    """The windows that a chunk fills in part only."""
    low, high = F.floor(start / size), F.floor((end - 1) / size)
    return F.array_distinct(F.array_compact(F.array(
        F.when((low * size < start) | ((low + 1) * size > end), low),
        F.when((high * size < start) | ((high + 1) * size > end), high),
    )))


def dropped_samples(chunks: DataFrame, size: int = 512) -> DataFrame:
    """Samples per stream in windows that are not full: the last one, and those that touch a gap between chunks.

    Only lengths are shuffled, and only of the windows at chunk borders.
    """
    start = F.col("start_sample")
    end = start + F.size("samples")
    filled = F.when(F.size("samples") > 0, _border_windows(start, end, size))
    pieces = chunks.select("stream_id", "start_sample", end.alias("_end"), F.explode_outer(filled).alias("_w")).select(
        "stream_id", "_w",
        (F.least((F.col("_w") + 1) * size, "_end") - F.greatest(F.col("_w") * size, "start_sample")).alias("_n"),
    )
    return (
        pieces.groupBy("stream_id", "_w").agg(F.sum("_n").alias("_n")).groupBy("stream_id")
        .agg(F.coalesce(F.sum(F.when(F.col("_n") < size, F.col("_n"))), F.lit(0)).cast("long").alias("dropped_samples"))
    )


def score_windows(
    windows: DataFrame,
    scorer: Callable[[np.ndarray], np.ndarray] | Column,
    size: int = 512,
) -> DataFrame:
    """Add ``speech_prob`` from a column, or from a function on a (windows x size) batch.

    A window of another length raises.
    """
    exact = F.when(F.size("samples") == size, F.col("samples")).otherwise(
        F.raise_error(F.concat(
            F.lit("window length "), F.size("samples").cast("string"), F.lit(f" is not {size}")
        )).cast("array<float>")
    )
    checked = windows.withColumn("samples", exact)
    if isinstance(scorer, Column):
        return checked.withColumn("speech_prob", scorer)

    @F.pandas_udf(T.DoubleType())
    def score(samples: pd.Series) -> pd.Series:
        if not len(samples):
            return pd.Series([], dtype="float64")
        return pd.Series(np.asarray(scorer(np.stack(samples.to_numpy())), dtype="float64"))

    return checked.withColumn("speech_prob", score("samples"))


def resample_series(chunks: DataFrame, source_rate: int, target_rate: int) -> DataFrame:
    """Linear interpolation of each stream at ``target_rate``; ``int(n * target / source)`` samples.

    Positions are computed on one index per stream, so chunk borders cause no drift. Each
    chunk borrows the first sample of its successor, found by an equi-join on the position
    where the chunk ends. What a chunk has to know of the others is put together in narrow rows first, so
    samples are shuffled once.
    """
    if source_rate == target_rate:
        return chunks.select("stream_id", "start_sample", "samples")
    start = F.col("start_sample")
    full = chunks.filter(F.size("samples") > 0)
    heads = full.select(
        "stream_id", F.col("start_sample").alias("_end"), F.col("samples")[0].alias("_next")
    )
    ends = full.select("stream_id", (start + F.size("samples")).alias("_end")).distinct()
    totals = ends.groupBy("stream_id").agg(F.max("_end").alias("_n"))
    edges = ends.join(heads, ["stream_id", "_end"], "left").join(totals, "stream_id")
    padded = full.withColumn("_end", start + F.size("samples")).join(edges, ["stream_id", "_end"])

    def first_output(position: Column) -> Column:
        """Smallest output index whose source position is not before ``position``."""
        return F.floor((position * target_rate + source_rate - 1) / source_rate)

    outputs = F.floor(F.col("_n") * target_rate / source_rate)

    def value(j: Column) -> Column:
        at = F.floor(j * source_rate / target_rate)
        part = (j * source_rate - at * target_rate) / target_rate
        k = (at - start).cast("int")
        left = F.get("samples", k).cast("double")
        right = F.when(k + 1 < F.size("samples"), F.get("samples", k + 1)).otherwise(
            F.coalesce("_next", F.get("samples", k))
        ).cast("double")
        return (left + (right - left) * part).cast("float")

    low = first_output(start)
    high = F.least(first_output(F.col("_end")), outputs) - 1
    return (
        padded.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
        # The planner may test the array before the filter above, so a range must never run backwards.
        .withColumn("_out", F.transform(F.sequence("_low", F.greatest("_low", "_high")), value))
        .select("stream_id", F.col("_low").alias("start_sample"), F.col("_out").alias("samples"))
    )


def progress(chunks: DataFrame, every: int = 1000, size: int = 512, rate: int = 16000) -> DataFrame:
    """One report per ``every`` chunks: chunks read so far and the media clock of whole windows."""
    end = F.col("start_sample") + F.size("samples")
    return (
        chunks.filter((F.col("chunk_seq") + 1) % every == 0)
        .select(
            "stream_id",
            (F.col("chunk_seq") + 1).alias("chunks_read"),
            (F.floor(end / size) * size / rate).alias("clock_s"),
        )
    )
