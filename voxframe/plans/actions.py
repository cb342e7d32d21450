"""The two user actions as DataFrame jobs: an event log of a corpus, or its segments as files.

``transcribe_jobs`` runs a manifest: each job names a source, a recognizer family and its settings, and all jobs go through one pass.
``transcribe`` and ``split`` take chunk rows and one set of options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.signal import SPEECH_THRESHOLD, TARGET_RATE, flag_speech
from voxframe.operators import cut, events, framing, lookups, recognize, segmentation
from voxframe.operators.fold import SegmentOptions
from voxframe.session import materialize
from voxframe.sources import jobs as manifests
from voxframe.sources import wav
from voxframe.sources.corpus import WavCorpus


def detect(
    chunks: DataFrame, scorer, options: SegmentOptions | None = None, threshold: float = SPEECH_THRESHOLD
) -> DataFrame:
    """Segments of chunk rows at 16 kHz. Only flags reach the fold; samples stay where they are."""
    options = options or SegmentOptions()
    return _segments_of(framing.frame(chunks, options.window, options.rate), scorer, options, threshold)


def transcribe(
    chunks: DataFrame, scorer, recognizer, options: SegmentOptions | None = None,
    threshold: float = SPEECH_THRESHOLD, clip: bool = False, epoch_ms: Column | None = None, **recognition,
) -> DataFrame:
    """The event log of all streams."""
    segments = detect(chunks, scorer, options, threshold)
    cuts = cut.cut_segments(segments, chunks)
    placed = cuts.drop("start_sample").join(
        segments.select("stream_id", "segment_idx", "start_s"), ["stream_id", "segment_idx"]
    )
    # Written once: a log is read several times on its way to a file, and the recognizer must not run again for it.
    transcripts = materialize(recognize.transcribe_segments(placed, recognizer, **recognition).filter("start_s is not null"))
    return events.event_log(chunks.select("stream_id"), segments, transcripts, clip, epoch_ms)


def split(
    chunks: DataFrame, scorer, options: SegmentOptions | None = None,
    threshold: float = SPEECH_THRESHOLD, rate: int = TARGET_RATE,
) -> DataFrame:
    """One WAV per segment: ``stream_id, segment_idx, start_s, duration_s, name, wav``.

    With another ``rate`` the chunks keep it: detection runs on a 16 kHz copy, and the
    segments are cut again from the original samples.
    """
    if rate == TARGET_RATE:
        segments = detect(chunks, scorer, options, threshold)
        samples = cut.cut_segments(segments, chunks)
    else:
        segments = detect(framing.resample_series(chunks, rate, TARGET_RATE), scorer, options, threshold)
        samples = cut.cut_segments_at_rate(segments, chunks, rate)
    placed = samples.drop("start_sample").join(
        segments.select("stream_id", "segment_idx", "start_s", "duration_s"), ["stream_id", "segment_idx"]
    )
    return wav.export_segments(events.segment_names(placed), rate)


def split_corpus(
    corpus: WavCorpus, folder: str, scorer, options: SegmentOptions | None = None,
    threshold: float = SPEECH_THRESHOLD, rate: int | None = TARGET_RATE,
) -> DataFrame:
    """The same for a folder of files of any rate, written below ``folder``; ``rate`` None keeps the rate of each file.

    Detection reads each file once at the rate of the options, the export reads the segments; no samples are shuffled.
    """
    options = options or SegmentOptions()
    frames = framing.frame(corpus.chunks(options.rate, _aligned_chunk(options.window)), options.window, options.rate, aligned=True)
    return corpus.export(_segments_of(frames, scorer, options, threshold), folder, rate)


def _aligned_chunk(window: int) -> int:
    """Samples of about a second in whole windows."""
    return window * max(1, TARGET_RATE // window)


def _segments_of(frames: DataFrame, scorer, options: SegmentOptions, threshold: float) -> DataFrame:
    scored = framing.score_windows(frames, scorer, options.window)
    flags = scored.select("stream_id", "window_idx", flag_speech(F.col("speech_prob"), threshold).alias("is_speech"))
    return segmentation.segment_activity(flags, options)


class ChunkTable:
    """Chunk rows of a table as the source of jobs."""

    def __init__(self, rows: DataFrame, aligned: bool = False):
        self.rows, self.aligned = rows, aligned

    def only(self, streams: DataFrame) -> ChunkTable:
        return ChunkTable(self.rows.join(streams, "stream_id", "left_semi"), self.aligned)

    def chunks(self, rate: int, chunk_samples: int) -> DataFrame:
        return self.rows

    def cut(self, segments: DataFrame, rate: int, source: str, deal) -> DataFrame:
        """Segments with their samples; a sample range that belongs to segments of several jobs is cut once."""
        place = ["start_sample", "n_samples"]
        asked = segments.select(F.col(source).alias("stream_id"), *place).distinct().withColumn("segment_idx", F.struct(*place))
        samples = cut.cut_segments(asked, self.rows).select(F.col("stream_id").alias(source), "segment_idx.*", "samples")
        return deal(segments.join(samples, [source, *place]))


def plan_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The jobs that can run, with ``options`` and ``job`` (see ``recognize.JOB_FIELDS``), and the others with ``errors``."""
    good, bad = manifests.validate_jobs(jobs)
    known = lookups.map_languages(lookups.with_limits(lookups.resolve_models(good)))
    wrong = F.array_compact(F.array("model_error", "limit_error", "language_error"))
    # The families that take a prompt from the line before, the one that gives times within a segment,
    # the ones that remember texts before script conversion, and the one whose languages lose inner spaces.
    conditioned = F.col("backend").isin("whisper", "qwen-asr-rs", "qwen-asr-mlx")
    job = F.struct(
        "backend", "resolved_model", "language_param", "prompt", "device",
        (conditioned & F.coalesce("condition", F.lit(True))).alias("condition"),
        ((F.col("backend") == "whisper") & F.coalesce("sub_timestamps", F.lit(True))).alias("sub_timestamps"),
        F.col("backend").isin("qwen-asr-rs", "qwen-asr-mlx").alias("raw_memory"),
        ((F.col("backend") == "moonshine") & F.coalesce(F.col("language_param").isin("zh", "ja", "ko"), F.lit(False))).alias("strip_spaces"),
        (F.col("script") if "script" in jobs.columns else F.lit(None).cast("string")).alias("script"),
    )
    options = F.struct(F.col("hard_s").cast("double").alias("hard_limit_s"), F.col("soft_s").alias("soft_limit_s"))
    planned = known.withColumn("errors", wrong)
    accepted = planned.filter(F.size("errors") == 0).select("job_id", "source", options.alias("options"), job.alias("job"))
    rejected = bad.select("job_id", "errors").unionByName(planned.filter(F.size("errors") > 0).select("job_id", "errors"))
    return accepted, rejected


def transcribe_jobs(
    jobs: DataFrame, samples: WavCorpus | ChunkTable, scorer, recognizer, threshold: float = SPEECH_THRESHOLD,
    clip: bool = False, epoch_ms: Column | None = None, scripts: dict[str, tuple[str, str]] | None = None,
    rate: int = TARGET_RATE, **options,
) -> tuple[DataFrame, DataFrame]:
    """(event log, rejected jobs) of a manifest ``job_id, source, backend, ...``; the streams of the log are the jobs.

    Every source is framed, scored and packed once, however many jobs name it. Its blocks of flags meet the limits that its jobs have, as
    data of one segmentation: jobs with the same source and limits share their segments. A sample range is cut once, and recognized for each job: the
    transcripts are a table before the log is put together. Jobs whose source has no samples get an empty log of their own.
    ``scorer`` and ``recognizer`` are as in ``framing.score_windows`` and ``recognize.transcribe_jobs``; ``options`` are further
    fields of ``SegmentOptions``, the same for all jobs.
    """
    default = SegmentOptions(rate=rate, **options)
    accepted, rejected = plan_jobs(jobs)
    accepted = materialize(accepted)
    plans = materialize(accepted.select("source", "options").distinct().withColumn("plan", F.monotonically_increasing_id()))
    same = (F.col("a.source") == F.col("p.source")) & F.col("a.options").eqNullSafe(F.col("p.options"))
    planned = materialize(accepted.alias("a").join(plans.alias("p"), same).select("plan", F.col("job_id").alias("stream_id"), "a.source", "job"))
    aligned = samples.aligned if isinstance(samples, ChunkTable) else True
    named = accepted.select(F.col("source").alias("stream_id")).distinct()
    chunks = samples.only(named).chunks(rate, _aligned_chunk(default.window))
    frames = framing.score_windows(framing.frame(chunks, default.window, rate, aligned=aligned), scorer, default.window)
    flags = frames.select("stream_id", "window_idx", flag_speech(F.col("speech_prob"), threshold).alias("is_speech"))
    shared = segmentation.segment_activity(flags, default, plans=plans.withColumnRenamed("source", "stream_id"))
    segments = shared.withColumnRenamed("stream_id", "plan").join(planned, "plan").drop("plan")
    placed = segments.select("stream_id", "segment_idx", "start_s", "start_sample", "n_samples", "source", "job")
    read = samples.cut(placed, rate, source="source", deal=recognize.dealt)
    transcripts = materialize(recognize.transcribe_jobs(read, recognizer, rate, scripts))
    streams = accepted.select(F.col("job_id").alias("stream_id"))
    return events.event_log(streams, segments, transcripts.filter("start_s is not null"), clip, epoch_ms), rejected
