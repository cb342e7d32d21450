"""The registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import signal, text, timefmt
from voxframe.operators import cut, events, framing, lookups, recognize, scan, segmentation
from voxframe.plans import actions, inputs
from voxframe.plans.inputs import EVENT_OPTIONS, FRAME_SIZE
from voxframe.session import materialize, table
from voxframe.sources import jobs as job_source
from voxframe.sources import tables, wav

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A fixed time for identifiers, so that queries repeat exactly.
EPOCH_MS = 1_700_000_000_000
# Columns of the prior-state queries.
STATE_COLUMNS = ("stream_id", "segment_idx", "line", "last_chunk", "prior_line", "prior_last_chunk")
# A small test mapping for the script conversion query.
SCRIPT_SOURCE, SCRIPT_TARGET = "aeiou", "一二三四五"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _samples(df: DataFrame, *keys: str) -> DataFrame:
    """One row per sample, as doubles."""
    return df.select(*keys, F.posexplode("samples").alias("pos", "_v")).select(
        *keys, "pos", F.col("_v").cast("double").alias("value")
    )


# --- segmentation ---------------------------------------------------------------------

@query
def activity_segments(spark, sf_dir):
    return segmentation.segment_activity(inputs.event_windows(spark, sf_dir), EVENT_OPTIONS)


@query
def activity_segments_default(spark, sf_dir):
    return segmentation.segment_activity(inputs.event_windows(spark, sf_dir))


@query
def activity_segments_unpaused(spark, sf_dir):
    """Streams that hardly pause, over many blocks: their states come out of the composition alone."""
    return segmentation.segment_activity(inputs.line_windows(spark, sf_dir), inputs.LINE_OPTIONS, inputs.LINE_BLOCK)


@query
def live_state(spark, sf_dir):
    return segmentation.live_state(inputs.event_windows(spark, sf_dir), EVENT_OPTIONS).select(
        "stream_id", "window_idx", "in_speech", F.round("segment_seconds", 6).alias("segment_seconds"),
        "pending_window_s",
    )


@query
def activity_runs(spark, sf_dir):
    return segmentation.activity_runs(inputs.event_windows(spark, sf_dir), max_gap_windows=2)


@query
def activity_segments_resets(spark, sf_dir):
    return segmentation.segment_activity_with_resets(inputs.event_controls(spark, sf_dir), EVENT_OPTIONS)


#: Activity in event time: events at most six hours apart are one run.
SESSION_GAP_S = 21600


@query
def activity_sessions(spark, sf_dir):
    return segmentation.activity_sessions(inputs.event_marks(spark, sf_dir), f"{SESSION_GAP_S} seconds").select(
        "stream_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("first_ts", "first_us"), ("last_ts", "last_us"))], "marks",
        F.round("duration_s", 6).alias("duration_s"))


@query
def segment_gaps(spark, sf_dir):
    return segmentation.gap_metrics(activity_segments(spark, sf_dir))


@query
def segment_counts(spark, sf_dir):
    return segmentation.segment_counts(activity_segments(spark, sf_dir)).select(
        "stream_id", "segments", F.round("speech_s", 6).alias("speech_s")
    )


@query
def window_flags(spark, sf_dir):
    return inputs.event_windows(spark, sf_dir)


# --- framing and signal ---------------------------------------------------------------

@query
def read_samples(spark, sf_dir):
    return tables.samples_by_value(inputs.sample_chunks(spark, sf_dir)).select(
        "stream_id", "sample_idx", F.col("value").cast("double").alias("value")
    )


@query
def read_values(spark, sf_dir):
    chunks = tables.read_values(
        table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"], chunk_size=16
    )
    return _samples(chunks, "stream_id", "chunk_seq", "start_sample")


@query
def chunk_offsets(spark, sf_dir):
    chunks = inputs.sample_chunks(spark, sf_dir).drop("start_sample")
    ragged = chunks.withColumn("samples", F.slice("samples", 1, (F.col("chunk_seq") + 40).cast("int")))
    return framing.with_offsets(ragged).select(
        "stream_id", "chunk_seq", "start_sample", F.size("samples").alias("n")
    )


@query
def frames(spark, sf_dir):
    windows = framing.frame(inputs.sample_chunks(spark, sf_dir), FRAME_SIZE)
    return _samples(windows, "stream_id", "window_idx", "start_sample", "ts")


@query
def frame_rms(spark, sf_dir):
    windows = framing.frame(inputs.sample_chunks(spark, sf_dir), FRAME_SIZE)
    return framing.score_windows(windows, signal.rms(F.col("samples")), FRAME_SIZE).select(
        "stream_id", "window_idx", F.round("speech_prob", 6).alias("speech_prob")
    )


@query
def frame_scores_vectorized(spark, sf_dir):
    def root_mean_square(batch):
        return (batch.astype("float64") ** 2).mean(axis=1) ** 0.5

    windows = framing.frame(inputs.sample_chunks(spark, sf_dir), FRAME_SIZE)
    return framing.score_windows(windows, root_mean_square, FRAME_SIZE).select(
        "stream_id", "window_idx", F.round("speech_prob", 6).alias("speech_prob")
    )


@query
def dropped_samples(spark, sf_dir):
    return framing.dropped_samples(inputs.sample_chunks(spark, sf_dir), FRAME_SIZE)


@query
def progress(spark, sf_dir):
    return framing.progress(inputs.sample_chunks(spark, sf_dir), every=3, size=FRAME_SIZE)


@query
def downmix(spark, sf_dir):
    mixed = table(spark, sf_dir, "embeddings").select(
        "vec_id", signal.downmix(F.col("embedding"), 2).alias("samples")
    )
    return _samples(mixed, "vec_id").withColumn("value", F.round("value", 6))


@query
def resample_down(spark, sf_dir):
    out = framing.resample_series(inputs.sample_chunks(spark, sf_dir), 44100, 16000)
    return tables.samples_by_value(out).select("stream_id", "sample_idx", F.round(F.col("value").cast("double"), 5).alias("value"))


@query
def resample_up(spark, sf_dir):
    out = framing.resample_series(inputs.sample_chunks(spark, sf_dir), 8000, 11025)
    return tables.samples_by_value(out).select("stream_id", "sample_idx", F.round(F.col("value").cast("double"), 5).alias("value"))


@query
def quantize_pcm16(spark, sf_dir):
    loud = F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))
    out = table(spark, sf_dir, "embeddings").select("vec_id", signal.quantize_pcm16(loud).alias("_q"))
    return out.select("vec_id", F.posexplode("_q").alias("pos", "_v")).select(
        "vec_id", "pos", F.col("_v").cast("int").alias("value")
    )


@query
def window_sizes(spark, sf_dir):
    return inputs.jobs(spark, sf_dir).groupBy(
        "rate", signal.window_size(F.col("rate")).alias("window_size")
    ).agg(F.count(F.lit(1)).alias("jobs"))


# --- range cut ------------------------------------------------------------------------

@query
def cut_segments(spark, sf_dir):
    out = cut.cut_segments(
        inputs.frame_segments(spark, sf_dir), inputs.sample_chunks(spark, sf_dir), bucket=100
    )
    return _samples(out, "stream_id", "segment_idx", "start_sample")


@query
def cut_segments_at_rate(spark, sf_dir):
    out = cut.cut_segments_at_rate(
        inputs.frame_segments(spark, sf_dir), inputs.sample_chunks(spark, sf_dir), 22050, bucket=100
    )
    return _samples(out, "stream_id", "segment_idx", "start_sample")


# --- dimension joins ------------------------------------------------------------------

@query
def validate_jobs(spark, sf_dir):
    good, bad = job_source.validate_jobs(inputs.jobs(spark, sf_dir))
    kept = good.select("job_id", "is_url", F.lit(True).alias("accepted"), F.lit("").alias("reasons"))
    return kept.unionByName(bad.select(
        "job_id", "is_url", F.lit(False).alias("accepted"), F.array_join("errors", " | ").alias("reasons")
    ))


@query
def wav_properties(spark, sf_dir):
    return wav.wav_properties(inputs.headers(spark, sf_dir)).withColumn("duration_s", F.round("duration_s", 6))


@query
def resolve_models(spark, sf_dir):
    return lookups.resolve_models(inputs.jobs(spark, sf_dir)).select(
        "job_id", "backend", "resolved_model", "arch", "streaming", "url", "model_error"
    )


@query
def limits_join(spark, sf_dir):
    return lookups.with_limits(lookups.resolve_models(inputs.jobs(spark, sf_dir))).select(
        "job_id", "backend", "mode", "hard_s", "soft_s", "limit_error"
    )


@query
def map_languages(spark, sf_dir):
    return lookups.map_languages(inputs.jobs(spark, sf_dir)).select(
        "job_id", "backend", "language", "language_param", "prompt", "language_warning", "language_error"
    )


@query
def detokenize(spark, sf_dir):
    # Orders as token rows: the parts of an order are its tokens, part names the vocabulary.
    tokens = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("stream_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
            lambda x: (x["l_partkey"] - 5).cast("int"),
        ).alias("tokens")
    )
    vocab = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("token_id"),
        F.encode(
            F.when(F.col("p_partkey") % 50 == 0, F.lit("<pad>"))
            .otherwise(F.concat(F.lit("▁"), F.col("p_name"))), "UTF-8",
        ).alias("token"),
    )
    return lookups.detokenize(tokens, vocab)


# --- ordered text scan ----------------------------------------------------------------

@query
def segment_line(spark, sf_dir):
    return scan.segment_line(inputs.doc_chunks(spark, sf_dir)).drop("block")


@query
def prior_state(spark, sf_dir):
    return scan.prior_state(scan.segment_line(inputs.doc_chunks(spark, sf_dir))).select(*STATE_COLUMNS)


@query
def prior_state_with_silent_segments(spark, sf_dir):
    chunks = inputs.doc_chunks(spark, sf_dir).filter(F.length("text") > 40)
    return scan.prior_state(scan.segment_line(chunks), inputs.doc_segments(spark, sf_dir)).select(*STATE_COLUMNS)


def _state(spark, sf_dir):
    return scan.prior_state(scan.segment_line(inputs.doc_chunks(spark, sf_dir)))


@query
def conditioning_prompts(spark, sf_dir):
    return scan.conditioning_prompts(_state(spark, sf_dir)).select("stream_id", "segment_idx", "prior_line", "prompt")


@query
def conditioning_prompts_equal(spark, sf_dir):
    return scan.conditioning_prompts(_state(spark, sf_dir), threshold=1.0).select(
        "stream_id", "segment_idx", "prior_line", "prompt"
    )


@query
def retry_plan_single(spark, sf_dir):
    return scan.plan_retries_single(_state(spark, sf_dir))


@query
def retry_plan_single_equal(spark, sf_dir):
    return scan.plan_retries_single(_state(spark, sf_dir), 1.0)


def _chunk_plans(spark, sf_dir, threshold):
    state = scan.prior_state(scan.segment_line(inputs.doc_chunks(spark, sf_dir), keep=["t0"]))
    return scan.plan_retries_chunks(None, state, threshold=threshold)


@query
def retry_plan_chunks(spark, sf_dir):
    return _chunk_plans(spark, sf_dir, text.NEAR_DUPLICATE_RATIO)


@query
def retry_plan_chunks_equal(spark, sf_dir):
    return _chunk_plans(spark, sf_dir, 1.0)


def _spliced(spark, sf_dir):
    """Splicing where the planned rest of a segment came back as other text, one second per chunk."""
    chunks = inputs.doc_chunks(spark, sf_dir)
    plans = materialize(_chunk_plans(spark, sf_dir, 1.0))  # narrow, and read three times
    again = chunks.join(plans, ["stream_id", "segment_idx"]).filter("chunk_idx >= repeat_idx").select(
        "stream_id", "segment_idx", (F.col("chunk_idx") - F.col("repeat_idx")).alias("chunk_idx"),
        F.concat(F.lit("again "), "text").alias("text"),
        (F.col("chunk_idx") - F.col("repeat_idx")).cast("double").alias("t0"),
        F.when(F.col("t1").isNotNull(), (F.col("chunk_idx") - F.col("repeat_idx") + 1).cast("double")).alias("t1"),
    )
    return scan.splice_retries(chunks, plans, again)


@query
def splice_retries(spark, sf_dir):
    return _spliced(spark, sf_dir)


@query
def absolute_times(spark, sf_dir):
    return scan.to_absolute_times(_spliced(spark, sf_dir), inputs.doc_segments(spark, sf_dir))


@query
def whole_segment_times(spark, sf_dir):
    return scan.whole_segment_times(
        scan.segment_line(inputs.doc_chunks(spark, sf_dir)), inputs.doc_segments(spark, sf_dir)
    )


@query
def retried_flags(spark, sf_dir):
    return scan.flag_retried(inputs.doc_chunks(spark, sf_dir), _chunk_plans(spark, sf_dir, 1.0)).select(
        "stream_id", "segment_idx", "chunk_idx", "prompt_retry"
    )


@query
def concat_results(spark, sf_dir):
    results = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"), F.lit(0).cast("long").alias("segment_idx"),
        F.col("turn").alias("result_idx"),
        F.when(F.col("role") == "system", F.array().cast("array<string>"))
        .otherwise(F.array("text", "role")).alias("alternatives"),
    )
    return scan.concat_results(results)


@query
def token_budget(spark, sf_dir):
    segments = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") * 8).cast("long").alias("n_samples"),
        F.when(F.col("l_returnflag") == "A", "streaming").when(F.col("l_returnflag") == "N", "non_streaming")
        .otherwise("fixed").alias("family"),
    )
    return scan.token_budget(segments)


@query
def recovery_audit(spark, sf_dir):
    return scan.recovery_audit(events.transcript_events(
        inputs.doc_transcripts(spark, sf_dir), clip=True, epoch_ms=F.lit(EPOCH_MS)
    ))


@query
def recovery_audit_retries(spark, sf_dir):
    log = events.transcript_events(inputs.doc_transcripts(spark, sf_dir), epoch_ms=F.lit(EPOCH_MS))
    return scan.recovery_audit(log)


def _stub_recognizer():
    """Deterministic text from all samples, a word per run of seven; with a prompt, the first one repeats its end."""

    def recognize_samples(samples, prompt):
        words = ["loud" if max(abs(float(x)) for x in samples[i:i + 7]) > 0.12 else "soft" for i in range(0, len(samples), 7)]
        if prompt and words:
            words[0] = prompt.split()[-1]
        return [
            {"text": " ".join(words[i:i + 3]), "t0": i / 1000, "t1": None if i + 3 >= len(words) else (i + 3) / 1000}
            for i in range(0, len(words), 3)
        ]

    return recognize_samples


@query
def transcribe_segments(spark, sf_dir):
    pieces = cut.cut_segments(inputs.frame_segments(spark, sf_dir), inputs.sample_chunks(spark, sf_dir))
    placed = pieces.withColumn("start_s", F.col("start_sample") / signal.TARGET_RATE)
    return recognize.transcribe_segments(placed, _stub_recognizer)


def _spelling_recognizer(job):
    """A stand-in that says a letter by the length of the segment, another kind of sign without a prompt."""
    def recognize_samples(samples, prompt):
        sign = chr((97 + len(samples) % 5) if prompt else (48 + len(samples) % 3))
        return [{"text": sign * 5, "t0": 0.0, "t1": None}]

    return recognize_samples


@query
def transcribe_jobs(spark, sf_dir):
    """A manifest from validation to the log: limits of each family, prompts, retries."""
    log, _ = actions.transcribe_jobs(
        inputs.line_jobs(spark, sf_dir), actions.ChunkTable(inputs.line_chunks(spark, sf_dir), aligned=True),
        signal.rms(F.col("samples")), _spelling_recognizer, threshold=0.1, epoch_ms=F.lit(EPOCH_MS),
        rate=inputs.LINE_RATE, window=inputs.LINE_WINDOW)
    return log.drop("id", "repetition_patterns_clipped")


@query
def transcribe_segments_unconditioned(spark, sf_dir):
    pieces = cut.cut_segments(inputs.frame_segments(spark, sf_dir), inputs.sample_chunks(spark, sf_dir))
    placed = pieces.withColumn("start_s", F.col("start_sample") / signal.TARGET_RATE)
    return recognize.transcribe_segments(placed, _stub_recognizer, condition=False)


# --- text and time functions ----------------------------------------------------------

@query
def repetitive_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", spread=True).select(
        "doc_id", text.is_repetitive_words(F.col("text")).alias("by_words"),
        text.is_repetitive_cjk(F.col("text")).alias("by_ideographs"),
    )


@query
def repetitive_ideographs(spark, sf_dir):
    marked = F.translate("text", SCRIPT_SOURCE, SCRIPT_TARGET)
    return inputs.doc_lines(spark, sf_dir).select(
        "stream_id", "segment_idx", text.is_repetitive_cjk(marked).alias("repetitive")
    )


def _line_pairs(spark, sf_dir):
    lines = inputs.doc_lines(spark, sf_dir).withColumnRenamed("text", "line").withColumn("last_chunk", F.lit(""))
    return scan.prior_state(lines)


@query
def near_dup_lines(spark, sf_dir):
    return scan.near_duplicate_lines(_line_pairs(spark, sf_dir))


@query
def near_dup_lines_equal(spark, sf_dir):
    return scan.near_duplicate_lines(_line_pairs(spark, sf_dir), 1.0)


@query
def clip_docs(spark, sf_dir):
    clipped = text.clip_repetitions(F.col("text"))
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", clipped.alias("c")).select(
        "doc_id", F.col("c.text").alias("text"), F.coalesce(F.get("c.patterns", F.lit(0)), F.lit("")).alias("pattern")
    )


@query
def convert_script(spark, sf_dir):
    return table(spark, sf_dir, "documents", spread=True).select(
        "doc_id", text.convert_script(F.col("text"), SCRIPT_SOURCE, SCRIPT_TARGET, "simplified").alias("text")
    )


@query
def strip_cjk_spaces(spark, sf_dir):
    marked = F.translate("text", SCRIPT_SOURCE, SCRIPT_TARGET)
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", text.strip_cjk_spaces(marked).alias("text"))


def _seconds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 7).alias("s")
    )


@query
def fmt_ts(spark, sf_dir):
    return _seconds(spark, sf_dir).select("*", timefmt.fmt_ts(F.col("s")).alias("formatted"))


@query
def fmt_ts_seconds(spark, sf_dir):
    return _seconds(spark, sf_dir).select("*", timefmt.fmt_ts(F.col("s"), decimals=False).alias("formatted"))


@query
def fmt_ts_trunc(spark, sf_dir):
    return _seconds(spark, sf_dir).select("*", timefmt.fmt_ts_trunc(F.col("s")).alias("formatted"))


@query
def event_ids(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ids = table(spark, sf_dir, "events").select(
        timefmt.event_id(ms, F.col("event_id")).alias("id"), ms.alias("ms")
    )
    return ids.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"),
        F.count_if(F.substring("id", 15, 1) == "7").alias("version_7"),
        F.count_if(F.substring("id", 20, 1).isin("8", "9", "a", "b")).alias("variant_ok"),
        F.count_if(
            F.conv(F.concat(F.substring("id", 1, 8), F.substring("id", 10, 4)), 16, 10).cast("long") == F.col("ms")
        ).alias("time_ok"),
    )


# --- event log ------------------------------------------------------------------------

@query
def transcript_events(spark, sf_dir):
    return events.transcript_events(
        inputs.doc_transcripts(spark, sf_dir), epoch_ms=F.lit(EPOCH_MS)
    ).select("stream_id", "segment_idx", "type", "start_ms", "start_formatted", "text", "end_ms",
             "end_formatted", "prompt_retry", F.size("repetition_patterns_clipped").alias("clipped"))


@query
def marker_events(spark, sf_dir):
    return events.marker_events(table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id")))


@query
def boundary_events(spark, sf_dir):
    return events.boundary_events(activity_segments(spark, sf_dir))


@query
def event_log(spark, sf_dir):
    return events.event_log(
        table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id")),
        activity_segments(spark, sf_dir),
    ).select("stream_id", "type", "timestamp_ms", "timestamp_formatted", "phase", "segment_idx", "kind", "chunk_idx")


@query
def transcript_log(spark, sf_dir):
    """Whole log of the documents, with repetition clipped; ids are checked by ``event_ids``."""
    return events.event_log(
        inputs.doc_lines(spark, sf_dir), inputs.doc_segments(spark, sf_dir),
        inputs.doc_transcripts(spark, sf_dir), clip=True, epoch_ms=F.lit(EPOCH_MS),
    ).drop("id").withColumn(
        "repetition_patterns_clipped",
        F.when(F.col("type") == "transcript", F.array_join("repetition_patterns_clipped", "|")),
    )


@query
def jsonl_records(spark, sf_dir):
    log = events.event_log(
        table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id")),
        activity_segments(spark, sf_dir),
    )
    return events.json_lines(log)


@query
def segment_names(spark, sf_dir):
    return events.segment_names(activity_segments(spark, sf_dir)).select("stream_id", "segment_idx", "name")


@query
def base_names(spark, sf_dir):
    return inputs.jobs(spark, sf_dir).select("job_id", events.base_name(F.col("source")).alias("folder"))


def _exported(spark, sf_dir):
    pieces = cut.cut_segments(inputs.frame_segments(spark, sf_dir), inputs.sample_chunks(spark, sf_dir))
    placed = pieces.withColumn("start_s", F.col("start_sample") / signal.TARGET_RATE).withColumn(
        "duration_s", F.size("samples") / signal.TARGET_RATE
    )
    return wav.export_segments(events.segment_names(placed), truncate=True)


@query
def export_segments(spark, sf_dir):
    return _exported(spark, sf_dir).select(
        "stream_id", "segment_idx", "name", F.octet_length("wav").alias("n_bytes"),
        F.hex(F.substring("wav", 1, 4)).alias("magic"),
    )


def _wav_files(spark, sf_dir):
    return _exported(spark, sf_dir).select(
        F.concat_ws("/", F.col("stream_id").cast("string"), "name").alias("path"), F.col("wav").alias("content")
    )


@query
def wav_corpus_profile(spark, sf_dir):
    """Exported segments, every seventh stream's files cut off inside the header, profiled as a corpus."""
    files = _wav_files(spark, sf_dir).withColumn("content", F.when(
        F.split("path", "/")[0].cast("int") % 7 == 0, F.substring("content", 1, 40)
    ).otherwise(F.col("content")))
    return wav.wav_corpus_profile(wav.wav_headers_of(files)).withColumn("hours", F.round("hours", 9))


@query
def wav_round_trip(spark, sf_dir):
    files = _wav_files(spark, sf_dir)
    chunks = wav.decode_pcm(wav.wav_headers_of(files), files, chunk_samples=50)
    return tables.samples_by_value(chunks).select(
        F.split("stream_id", "/")[0].cast("long").alias("stream_id"),
        F.split("stream_id", "/")[1].alias("name"), "sample_idx", F.col("value").cast("double").alias("value"),
    )
