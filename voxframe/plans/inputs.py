"""Operator inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators.fold import SegmentOptions
from voxframe.operators.framing import frame
from voxframe.operators.ordering import index_rows
from voxframe.operators.segmentation import activity_runs
from voxframe.functions.signal import flag_speech, rms
from voxframe.session import table
from voxframe.sources.tables import read_samples

# Options of the event queries, in whole windows of 32 ms: 3 minimum, 10 soft, 16 hard, 2 silent, 2 look-back.
EVENT_OPTIONS = SegmentOptions(
    min_speech_s=0.096, soft_limit_s=0.32, hard_limit_s=0.512, min_silence_ms=64, look_back_s=0.064
)
EVENT_THRESHOLD = 0.4
# Options of the sample queries: windows of 48 samples.
FRAME_SIZE = 48
FRAME_THRESHOLD = 0.125

# Shared by Spark and the checking SQL: one job per document.
JOB_COLUMNS = [
    "doc_id AS job_id",
    "CASE WHEN doc_id % 5 = 0 THEN concat('https://host/', source, '/', CAST(doc_id AS STRING), '.wav') "
    "WHEN doc_id % 5 = 1 THEN concat('/data/', source, '/file.', CAST(doc_id AS STRING), '.ogg') "
    "WHEN doc_id % 5 = 2 THEN concat(source, '/', CAST(doc_id AS STRING)) "
    "WHEN doc_id % 5 = 3 THEN concat('rtsp://', source) ELSE concat('a/.', source) END AS source",
    "doc_id % 5 <> 2 OR doc_id % 3 <> 0 AS file_exists",
    "CASE WHEN doc_id % 5 <> 3 OR n_chars % 2 = 0 THEN CAST(n_chars AS DOUBLE) / 16 END AS duration_s",
    "CASE doc_id % 9 WHEN 0 THEN 'whisper' WHEN 1 THEN 'nvidia-whisper' WHEN 2 THEN 'moonshine' "
    "WHEN 3 THEN 'moonshine' WHEN 4 THEN 'qwen-asr-rs' WHEN 5 THEN 'qwen-asr-mlx' WHEN 6 THEN 'glm-asr' "
    "WHEN 7 THEN 'glm-asr-mlx' ELSE source END AS backend",
    "CASE n_chars % 7 WHEN 0 THEN NULL WHEN 1 THEN upper(lang) WHEN 2 THEN 'yue' WHEN 3 THEN 'zh' "
    "WHEN 4 THEN 'xx' ELSE lang END AS language",
    "CASE WHEN doc_id % 9 = 0 THEN CASE n_chars % 3 WHEN 0 THEN NULL WHEN 1 THEN 'tiny' "
    "ELSE 'alvanlii/whisper-small-cantonese' END "
    "WHEN doc_id % 9 IN (2, 3) THEN CASE n_chars % 4 WHEN 0 THEN 'Tiny' WHEN 1 THEN 'base' WHEN 2 THEN NULL "
    "ELSE 'huge' END END AS model",
    "CASE n_chars % 3 WHEN 0 THEN true WHEN 1 THEN false END AS condition",
    "n_chars % 4 <> 0 AS sub_timestamps",
    "CASE WHEN n_chars % 6 = 0 THEN 'cuda' END AS device",
    "CASE doc_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 44100 ELSE 8000 END AS rate",
]

# Shared by Spark and the checking SQL: one file header per document.
HEADER_COLUMNS = [
    "concat(source, '/', CAST(doc_id AS STRING)) AS path",
    "CASE WHEN doc_id % 11 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 44100 ELSE 8000 END END AS sample_rate",
    "CAST(CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1 + doc_id % 2 END AS INT) AS channels",
    "CASE WHEN doc_id % 2 = 0 THEN 16 ELSE 32 END AS bits_per_sample",
    "CASE WHEN doc_id % 7 <> 0 THEN n_chars * 8 END AS data_size",
]


#: What resets the detector in the query on control rows.
RESET_EVENT = "signup"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order as the windows of a stream, ``value`` in percent as score."""
    return event_controls(spark, sf_dir).drop("is_reset")


def event_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with a control flag."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return index_rows(events, "user_id", ["ts", "event_id"], "window_idx").select(
        F.col("user_id").alias("stream_id"), "window_idx", (F.col("value") / 100).alias("speech_prob"),
        flag_speech(F.col("value") / 100, EVENT_THRESHOLD).alias("is_speech"), (F.col("event_type") == RESET_EVENT).alias("is_reset"),
    )


def event_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of a user's events that count as activity."""
    return table(spark, sf_dir, "events").filter(F.col("value") / 100 > EVENT_THRESHOLD).select(F.col("user_id").alias("stream_id"), "ts")


# The lines of orders as streams without pauses; a third of all rows is one stream.
LINE_STREAM = "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 20 END"
LINE_FLAG = "l_linenumber % 2 = 1"
LINE_OPTIONS = SegmentOptions(min_speech_s=0.096, soft_limit_s=1.28, hard_limit_s=3.2, min_silence_ms=128, look_back_s=0.064)
LINE_BLOCK = 256


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        f"CAST({LINE_STREAM} AS BIGINT) AS stream_id", "l_orderkey", "l_linenumber", f"{LINE_FLAG} AS is_speech")
    return index_rows(lines, "stream_id", ["l_orderkey", "l_linenumber"], "window_idx").select("stream_id", "window_idx", "is_speech")


# The lines of a supplier as a recording of 500 samples a second in windows of 64 ms, nearly always loud: limits of 9 and 30 s
# fall inside windows.
LINE_RATE, LINE_WINDOW = 500, 32
LINE_LOUD = "l_partkey % 150 <> 0"


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_orderkey", "l_linenumber", f"{LINE_LOUD} AS loud", "l_partkey")
    level = F.when(F.col("loud"), 0.5).otherwise(0.0).cast("float")
    return index_rows(lines, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "chunk_seq").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("stream_id"), "chunk_seq",
        (F.col("chunk_seq") * LINE_WINDOW).alias("start_sample"), F.array_repeat(level, LINE_WINDOW).alias("samples"))


def line_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    return jobs(spark, sf_dir).crossJoin(F.broadcast(suppliers)).withColumn(
        "source", F.concat(F.lit("s"), (1 + F.col("job_id") % F.col("n")).cast("string"))).drop("n")


def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight embeddings in a row are the chunks of a stream."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("stream"), (F.col("vec_id") % 8).alias("seq"),
        (F.col("vec_id") % 8 * 64).alias("start"), "embedding",
    )
    return read_samples(rows, "stream", "embedding", "seq", "start")


def frame_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = frame(sample_chunks(spark, sf_dir), FRAME_SIZE)
    return windows.select(
        "stream_id", "window_idx", flag_speech(rms(F.col("samples")), FRAME_THRESHOLD).alias("is_speech")
    )


def frame_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = activity_runs(frame_flags(spark, sf_dir), 1, FRAME_SIZE)
    return runs.withColumn("segment_idx", F.col("first_window"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*JOB_COLUMNS)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*HEADER_COLUMNS)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document as the segments of a stream."""
    return table(spark, sf_dir, "documents", spread=True).select(
        F.col("doc_id").alias("stream_id"), F.posexplode(F.split("text", "\n")).alias("_i", "text")
    ).select("stream_id", F.col("_i").cast("long").alias("segment_idx"), "text")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a line as the timed chunks of a segment, two seconds each; the last end is open."""
    return doc_lines(spark, sf_dir).select(
        "stream_id", "segment_idx", F.split("text", "\\. ").alias("_s")
    ).select(
        "stream_id", "segment_idx", F.size("_s").alias("_n"), F.posexplode("_s").alias("chunk_idx", "text")
    ).select(
        "stream_id", "segment_idx", "chunk_idx", "text", (F.col("chunk_idx") * 2.0).cast("double").alias("t0"),
        F.when(F.col("chunk_idx") < F.col("_n") - 1, ((F.col("chunk_idx") + 1) * 2.0).cast("double")).alias("t1"),
    )


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line gets a place of 30 s on its stream."""
    return doc_lines(spark, sf_dir).select(
        "stream_id", "segment_idx", (F.col("segment_idx") * 30.0).cast("double").alias("start_s"),
        F.lit(30.0).alias("duration_s"), F.lit(480000).cast("long").alias("n_samples"),
    )


def doc_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript row per line; lines at even positions of odd documents count as retried."""
    return doc_lines(spark, sf_dir).select(
        "stream_id", "segment_idx", F.lit(0).alias("chunk_idx"), "text",
        (F.col("segment_idx") * 30.0).cast("double").alias("start_s"),
        (F.col("segment_idx") * 30.0 + 29.9995).cast("double").alias("end_s"),
        ((F.col("stream_id") % 2 == 1) & (F.col("segment_idx") % 2 == 0)).alias("prompt_retry"),
    )
