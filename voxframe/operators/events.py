"""The event log: transcript, boundary and marker records in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import clip_repetitions
from voxframe.functions.timefmt import event_id, fmt_ts, to_ms, to_ms_trunc
from voxframe.schemas import EVENT_LOG

SORT_KEYS = ("stream_id", "phase", "segment_idx", "kind", "chunk_idx")


def transcript_events(
    transcripts: DataFrame, clip: bool = False, epoch_ms: Column | None = None
) -> DataFrame:
    """One record per transcript row; with ``clip`` degenerate repetition is cut here, and only here."""
    if clip:
        text = clip_repetitions(F.col("text"))
        rows = transcripts.withColumn("_clip", text)
        text, patterns = F.col("_clip.text"), F.col("_clip.patterns")
    else:
        rows, text, patterns = transcripts, F.col("text"), F.array().cast("array<string>")
    when = F.unix_millis(F.current_timestamp()) if epoch_ms is None else epoch_ms
    # A missing start time cannot be placed on the time line, so such a row is no event.
    return rows.filter(F.col("start_s").isNotNull()).select(
        "stream_id",
        F.lit("transcript").alias("type"),
        event_id(when, F.col("stream_id"), F.col("segment_idx"), F.col("chunk_idx")).alias("id"),
        to_ms(F.col("start_s")).alias("start_ms"),
        fmt_ts(F.col("start_s")).alias("start_formatted"),
        text.alias("text"),
        to_ms(F.col("end_s")).alias("end_ms"),
        fmt_ts(F.col("end_s")).alias("end_formatted"),
        F.col("prompt_retry"),
        patterns.alias("repetition_patterns_clipped"),
        F.lit(1).alias("phase"), "segment_idx", F.lit(1).alias("kind"),
        F.col("chunk_idx").cast("int").alias("chunk_idx"),
    )


def marker_events(streams: DataFrame) -> DataFrame:
    """Start and end of each distinct stream."""
    return streams.select("stream_id").distinct().select(
        "stream_id",
        F.explode(F.array(
            F.struct(F.lit("stream_start").alias("type"), F.lit(0).alias("phase")),
            F.struct(F.lit("stream_end").alias("type"), F.lit(2).alias("phase")),
        )).alias("m"),
    ).select(
        "stream_id", "m.type", "m.phase", F.lit(0).cast("long").alias("segment_idx"),
        F.lit(0).alias("kind"), F.lit(0).alias("chunk_idx"),
    )


def boundary_events(segments: DataFrame) -> DataFrame:
    end = F.col("start_s") + F.col("duration_s")
    return segments.select(
        "stream_id", "segment_idx",
        F.explode(F.array(
            F.struct(F.lit("segment_start").alias("type"), F.lit(0).alias("kind"), F.col("start_s").alias("at")),
            F.struct(F.lit("segment_end").alias("type"), F.lit(2).alias("kind"), end.alias("at")),
        )).alias("b"),
    ).select(
        "stream_id", "b.type", to_ms(F.col("b.at")).alias("timestamp_ms"),
        fmt_ts(F.col("b.at")).alias("timestamp_formatted"),
        F.lit(1).alias("phase"), "segment_idx", "b.kind", F.lit(0).alias("chunk_idx"),
    )


def event_log(
    streams: DataFrame,
    segments: DataFrame,
    transcripts: DataFrame | None = None,
    clip: bool = False,
    epoch_ms: Column | None = None,
) -> DataFrame:
    """All records of all streams with their sort keys (see ``SORT_KEYS``)."""
    log = marker_events(streams).unionByName(boundary_events(segments), allowMissingColumns=True)
    if transcripts is not None:
        log = log.unionByName(transcript_events(transcripts, clip, epoch_ms), allowMissingColumns=True)
    for field in EVENT_LOG:
        if field.name not in log.columns:
            log = log.withColumn(field.name, F.lit(None).cast(field.dataType))
    return log.select(*[f.name for f in EVENT_LOG])


def json_lines(log: DataFrame) -> DataFrame:
    """Each record as one JSON line holding only the fields of its type, plus the sort keys."""
    fields = [f.name for f in EVENT_LOG if f.name not in ("stream_id", *SORT_KEYS)]
    return log.select(*SORT_KEYS, F.to_json(F.struct(*fields)).alias("value"))


def base_name(source: Column) -> Column:
    """File name without folder and last extension; a leading dot is no extension."""
    name = F.regexp_extract(source, r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*\z", "")


def segment_names(segments: DataFrame, extension: str = "wav") -> DataFrame:
    """Add ``name``: index and truncated milliseconds of start and end."""
    if extension not in ("wav", "opus"):
        raise ValueError(f"Unsupported output format: {extension}")
    return segments.withColumn("name", F.format_string(
        "segment_%04d_%dms_%dms." + extension,
        F.col("segment_idx").cast("long"),
        to_ms_trunc(F.col("start_s")),
        to_ms_trunc(F.col("start_s") + F.col("duration_s")),
    ))
