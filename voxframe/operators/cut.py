"""Range cut: the samples of each segment, as an interval join on position buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT_BUCKET = 1 << 18


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def cut_pieces(segments: DataFrame, chunks: DataFrame, bucket: int = CUT_BUCKET) -> DataFrame:
    """One row per (segment, chunk) overlap: ``start_sample`` of the piece and its samples.

    Both sides are spread over buckets of ``bucket`` samples and joined on (stream,
    bucket), so a hot stream is as many join keys as it has buckets. A pair that shares
    several buckets is kept in the first one only.
    """
    left = segments.filter("n_samples > 0").select(
        "stream_id", "segment_idx", F.col("start_sample").alias("_s"),
        (F.col("start_sample") + F.col("n_samples")).alias("_e"),
    ).select("*", _buckets(F.col("_s"), F.col("_e"), bucket).alias("_bucket"))
    right = chunks.filter(F.size("samples") > 0).select(
        "stream_id", F.col("start_sample").alias("_c"),
        (F.col("start_sample") + F.size("samples")).alias("_d"), "samples",
    ).select("*", _buckets(F.col("_c"), F.col("_d"), bucket).alias("_bucket"))
    low, high = F.greatest("_s", "_c"), F.least("_e", "_d")
    return (
        left.join(right, ["stream_id", "_bucket"])
        .filter((low < high) & (F.col("_bucket") == F.floor(low / bucket)))
        .select(
            "stream_id", "segment_idx", low.alias("start_sample"),
            F.slice("samples", (low - F.col("_c") + 1).cast("int"), (high - low).cast("int")).alias("samples"),
        )
    )


def assemble(pieces: DataFrame) -> DataFrame:
    """One row per segment. A segment is bounded by its hard limit, and so is the array."""
    return (
        pieces.groupBy("stream_id", "segment_idx")
        .agg(F.array_sort(F.collect_list(F.struct("start_sample", "samples"))).alias("_p"))
        .select(
            "stream_id", "segment_idx",
            F.col("_p")[0]["start_sample"].alias("start_sample"),
            F.flatten(F.transform("_p", lambda x: x["samples"])).alias("samples"),
        )
    )


def cut_segments(segments: DataFrame, chunks: DataFrame, bucket: int = CUT_BUCKET) -> DataFrame:
    return assemble(cut_pieces(segments, chunks, bucket))


def segments_at_rate(segments: DataFrame, rate: int) -> DataFrame:
    """Segment bounds in samples of another rate, truncated from seconds at both ends.

    Ends beyond the available samples need no clamping here: the cut keeps what overlaps.
    """
    low = F.greatest((F.col("start_s") * rate).cast("long"), F.lit(0))
    high = ((F.col("start_s") + F.col("duration_s")) * rate).cast("long")
    return segments.select(
        "stream_id", "segment_idx", low.alias("start_sample"), (high - low).alias("n_samples")
    )


def cut_segments_at_rate(
    segments: DataFrame, chunks: DataFrame, rate: int, bucket: int = CUT_BUCKET
) -> DataFrame:
    return cut_segments(segments_at_rate(segments, rate), chunks, bucket)
