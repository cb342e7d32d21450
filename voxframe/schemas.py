"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

SAMPLE_CHUNKS = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("chunk_seq", T.LongType()),
    T.StructField("start_sample", T.LongType()),
    T.StructField("rate", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])

TRANSCRIPTS = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("segment_idx", T.LongType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("start_s", T.DoubleType()),
    T.StructField("end_s", T.DoubleType()),
    T.StructField("prompt_retry", T.BooleanType()),
])

WAV_HEADER = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("audio_format", T.IntegerType()),
    T.StructField("bits_per_sample", T.IntegerType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("data_size", T.LongType()),
    T.StructField("data_offset", T.LongType()),
    T.StructField("error", T.StringType()),
])

EVENT_LOG = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("start_formatted", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("end_formatted", T.StringType()),
    T.StructField("prompt_retry", T.BooleanType()),
    T.StructField("repetition_patterns_clipped", T.ArrayType(T.StringType())),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("timestamp_formatted", T.StringType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("segment_idx", T.LongType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("chunk_idx", T.IntegerType()),
])
